"""Conversation repair: the cheapest edits that make every conversation an alternation of user and assistant.

Rows are dealt by conversation and sorted by turn inside the tasks; ``mapInPandas`` streams over them and carries
the state of the conversation it is in across Arrow batches, so no conversation is ever held whole. Output roles
follow an automaton (nothing yet, after system, after user, after assistant); the dynamic programme keeps, for each
of its four states, the least cost, the order of the least edit strings and the running digest of the repaired text.
Those rows of the programme repeat (costs relative to the least, orders, class of the row), so each is worked out
once and looked up afterwards.

Edit strings end in a letter that takes a row, so of two that have taken equally many rows neither begins with the
other: comparing orders and then the new letters is comparing the strings. What leads back to the start is one byte
a state and row. Conversations of up to ``HELD`` rows trace back at once; longer ones spill blocks of these bytes as
rows of the written table, which a second stream reads from the last to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from audience_lens.llm.common import equip, saved, table

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT for a truncated row that stays
HELD = 1 << 18  # rows whose way back a task holds
SPACES = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # initials that may follow
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
COMPLETE = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LETTERS = "DIKR"
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)  # first faults
LEGAL = ("su", "ua", "au")


def _insertions(state: int) -> Iterator[tuple[int, str]]:
    """States behind up to two inserted rows, with the initials inserted; a third would repeat the first."""
    made = ""
    for _ in range(3):
        yield state, made
        initial = "a" if state == USER else "u"
        state, made = AFTER[initial], made + initial


@lru_cache(1 << 16)
def step(costs: tuple[int | None, ...], orders: tuple[int, ...], initial: str, fault: int):
    """One row of the programme: (least cost, costs above it, orders, way back as 4 bytes, makings).

    ``costs`` are relative to the least one, None where a state can't be reached; ``orders`` rank the states' edit
    strings. A byte of the way back holds the state before, the number of insertions and the row's letter. A making
    is (state, state before, initials inserted, what becomes of the row: "" deleted, "k" kept, or its new initial).
    """
    best: dict[int, tuple] = {}
    for before, cost in enumerate(costs):
        if cost is None:
            continue
        for state, made in _insertions(before):
            spent, letters = cost + INSERT * len(made), "I" * len(made)
            ways = [(state, DELETE, "D", "")]
            if fault not in (BLANK, DUPLICATE):
                cut = CUT * (fault == TRUNCATED)
                if initial and initial in NEXT[state]:
                    ways.append((AFTER[initial], KEEP + cut, "K", "k"))
                ways += [(AFTER[i], REROLE + cut, "R", i) for i in NEXT[state] if i in ROLES]
            for after, own, letter, fate in ways:
                way = (spent + own, orders[before], letters + letter, before, made, fate)
                if after not in best or way[:3] < best[after][:3]:
                    best[after] = way
    least = min(w[0] for w in best.values())
    ranks = {key: i for i, key in enumerate(sorted({w[1:3] for w in best.values()}))}
    return (least, tuple(best[s][0] - least if s in best else None for s in range(4)),
            tuple(ranks[best[s][1:3]] if s in best else 0 for s in range(4)),
            bytes(best[s][3] | len(best[s][4]) << 2 | LETTERS.index(best[s][2][-1]) << 4 if s in best else 255 for s in range(4)),
            tuple((s, w[3], w[4], w[5]) for s, w in best.items()))


def finish(costs: tuple[int | None, ...], orders: tuple[int, ...]) -> tuple[int, int, str]:
    """(cost above the least, state, initials inserted at the end) of the cheapest complete sequence."""
    ways = [(cost + INSERT * len(made), orders[before], len(made), before, made)
            for before, cost in enumerate(costs) if cost is not None
            for state, made in _insertions(before) if state in COMPLETE]
    cost, _, _, state, made = min(ways)
    return cost, state, made


def trace(back: bytes, state: int) -> tuple[str, int]:
    """Edit letters of the rows whose way back this is, reached in ``state``, and the state before them."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        byte = back[at + state]
        out.append("I" * (byte >> 2 & 3) + LETTERS[byte >> 4])
        state = byte & 3
    return "".join(reversed(out)), state


class Text:
    """Digest of newline-joined lines, copied where ways part."""

    __slots__ = ("lines", "hash")

    def __init__(self, lines: int = 0, digest=None) -> None:
        self.lines, self.hash = lines, digest or sha256()

    def copy(self) -> Text:
        return Text(self.lines, self.hash.copy())

    def add(self, line: bytes) -> None:
        self.hash.update(b"\n" + line if self.lines else line)
        self.lines = 1


class Conversation:
    """What is carried from row to row of one conversation."""

    def __init__(self, key: str | None, held: int) -> None:
        self.key, self.held, self.blocks = key, held, 0
        self.low = self.high = self.last_turn = None
        self.distinct, self.counts, self.illegal, self.last_initial = 0, [0, 0, 0, 0], 0, None
        self.cost, self.costs, self.orders = 0, (0, None, None, None), (0, 0, 0, 0)
        self.back, self.texts = bytearray(), [Text(), None, None, None]

    def add(self, turn: str | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.low = int(turn) if self.low is None else self.low
            self.high, self.last_turn, self.distinct = int(turn), turn, self.distinct + 1
        self.counts[fault] += 1
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in LEGAL:
            self.illegal += 1
        self.last_initial = initial
        least, self.costs, self.orders, back, makings = step(self.costs, self.orders, initial if initial in AFTER else "", fault)
        self.cost += least
        self.back += back
        kept = f"{role}:{text}".encode()
        texts: list[Text | None] = [None] * 4
        for state, before, made, fate in makings:
            own = self.texts[before].copy()
            for i in made:
                own.add(f"{ROLES[i]}:".encode())
            if fate == "k":
                own.add(kept)
            elif fate:
                own.add(f"{ROLES[fate]}:{text}".encode())
            texts[state] = own
        self.texts = texts

    def full(self) -> bool:
        return len(self.back) >= 4 * self.held

    def spill(self) -> tuple:
        """The way back so far as a row; it is no longer held."""
        row = (self.key, self.blocks, *[None] * 9, 0, "", bytes(self.back))
        self.back, self.blocks = bytearray(), self.blocks + 1
        return row

    def end(self) -> tuple:
        over, state, made = finish(self.costs, self.orders)
        text = self.texts[state]
        for i in made:
            text.add(f"{ROLES[i]}:".encode())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        audit, back = None, bytes(self.back)
        if not self.blocks:
            audit, back = trace(back, state)[0] + "I" * len(made), None
        _, blank, duplicate, truncated = self.counts
        return (self.key, self.blocks, gaps, blank, duplicate, truncated, self.illegal, self.cost + over, audit,
                text.hash.hexdigest(), sum(self.counts), state, "I" * len(made), back)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
STREAMED = ("key string, block long, " + "".join(f"{c} string, " for c in COUNTS)  # pandas has no null integers
            + "audit string, repaired_sha256 string, n_rows string, state int, ending string, back binary")
NAMES = [field.split()[0] for field in STREAMED.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([[*r[:2], *map(_text, r[2:8]), *r[8:10], _text(r[10]), *r[11:]] for r in rows], columns=NAMES)


def _text(count: int | str | None) -> str | None:
    return None if count is None else str(count)


def _streamed(held: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Conversation | None = None
        for batch in batches:
            out: list[tuple] = []
            for key, gone, turn, role, text, fault in zip(*(batch[c] for c in ("key", "gone", "turn", "role", "text", "fault"))):
                if now is None or key != now.key:
                    if now is not None:
                        out.append(now.end())
                    now = Conversation(key, held)
                if not gone:
                    now.add(turn, role, text, fault)
                    if now.full():
                        out.append(now.spill())
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame([now.end()])

    return task


def _traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audits of spilled conversations, whose blocks come last first; the first one holds the counts."""
    row, state, parts = None, START, []

    def whole() -> pd.DataFrame:
        return _frame([(*row[:8], "".join(reversed(parts)), *row[9:13], None)])

    for batch in batches:
        for one in batch.itertuples(index=False, name=None):
            if one[2] is not None:
                if row is not None:
                    yield whole()
                row, state, parts = one, int(one[11]), [one[12]]
            letters, state = trace(one[13], state)
            parts.append(letters)
    if row is not None:
        yield whole()


def _with_faults(rows: DataFrame) -> DataFrame:
    """First fault of each row. Copies are found by sorting each task's conversations, so no task remembers texts."""
    bare = F.rtrim("text", F.lit(SPACES))
    seen = F.row_number().over(Window.partitionBy("key", "gone", "role", "text").orderBy("turn_number")) > 1
    fault = F.when(bare == "", BLANK).when(seen, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    return rows.withColumn("fault", F.coalesce(fault, F.lit(CLEAN)))


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           gone: Column | None = None, held: int = HELD) -> DataFrame:
    """One row a conversation: ``key``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows.

    ``gone`` marks rows that only say that their conversation exists. Rows follow their turn (nulls first), then role
    and text; repeated rows follow each other. Null roles and texts count as one space; null keys are one conversation;
    null turns neither make gaps nor close any. Roles that begin with none of s, u, a can only be renamed or deleted.
    A conversation without rows has zeros, an empty audit and the digest of the empty text. Other columns are ignored;
    no rows give no result.
    """
    equip(rows.sparkSession)
    kind = rows.schema[key].dataType
    narrow = rows.select(
        F.col(key).cast("string").alias("key"), F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("gone"),
        F.col(turn).cast("long").alias("turn_number"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    dealt = _with_faults(narrow.repartition("key")).sortWithinPartitions("key", "turn_number", "role", "text")
    cells = dealt.withColumn("turn", F.col("turn_number").cast("string")).drop("turn_number")  # pandas has no null integers
    done = saved(cells.mapInPandas(_streamed(held), STREAMED), "conversations")
    long_ones = done.filter("audit IS NULL").repartition("key").sortWithinPartitions("key", F.col("block").desc())
    whole = done.filter("audit IS NOT NULL").unionByName(long_ones.mapInPandas(_traced, STREAMED))
    counts = {c: F.col(c).cast("long") for c in (*COUNTS, "n_rows")}
    return whole.withColumns(counts).select(F.col("key").cast(kind).alias(key), *NAMES[2:11])


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the row's own hash: ``gone`` rows are dropped, copies follow their row."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    mark = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    return (rows.withColumn("fate", F.crc32(mark.cast("binary")) % 20).select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (F.col("fate") == 0).alias("gone"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone")).drop("n_rows")
