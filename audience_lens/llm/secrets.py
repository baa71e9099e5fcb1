"""Secret scans: base patterns, and formats inferred from them by merging prefix-tree states.

Every kind's credentials are learnt as a probabilistic automaton. Strings that the base patterns label,
a bounded sample of each kind, form a prefix tree over character classes; states are merged from the
start outwards where Hoeffding bounds can't tell their ending and next-class frequencies apart, along
with all that follows them, and the lengths still to come are alike too: deep in a tree classes alone
are too rare to keep states apart, and a format would lose its length. Of several states that fit, the
one with the nearest mean length to come takes the merge. Every other run of credential characters in
every text is then a candidate, whole or what a base span leaves of it: it is added as kind ``format``
if some credential automaton explains it better than ordinary writing does by more than MIN_ODDS. Ordinary writing is a fixed chain over letters, digits and signs; nothing
of it is fitted to unlabelled runs, so credentials no base pattern knows can't pass for ordinary by
being frequent.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.llm.common import arrow_map, record, saved, small, table, texts

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
SHORTEST = 8  # characters of a candidate, as of the shortest labelled string
RUN = re.compile(r"[A-Za-z0-9+/_.-]{8,}(?:={1,2}(?![A-Za-z0-9+/_.=-]))?")  # "=" parts a name from its value, or pads the end
KINDS = ("assign", "access", "hex")
SAMPLE = 600  # distinct strings of each kind, by hash, to which automata are fitted
LONGEST = 128  # characters of a string that is learnt from or remembered; all are scored whole
ALPHA = 0.05  # chance of keeping two states apart that are alike
LEFT = log(1 / 12)  # of a class, or of the end, once a string has left an automaton: 11 classes and the end
MIN_ODDS = log(1e4)
# ordinary writing: chances of the next type of character, or of the end, after a type; "" is the start, "caps"
# a capital after another
ORDINARY = {"": {"lower": 0.55, "upper": 0.2, "digit": 0.15, "sign": 0.1},
            "lower": {"lower": 0.92, "upper": 0.01, "digit": 0.01, "sign": 0.02, "end": 0.04},
            "upper": {"lower": 0.6, "caps": 0.3, "digit": 0.03, "sign": 0.03, "end": 0.04},
            "caps": {"lower": 0.01, "caps": 0.92, "digit": 0.01, "sign": 0.02, "end": 0.04},
            "digit": {"lower": 0.02, "upper": 0.02, "digit": 0.7, "sign": 0.16, "end": 0.1},
            "sign": {"lower": 0.45, "upper": 0.15, "digit": 0.25, "sign": 0.1, "end": 0.05}}
# the type of a class, and its chance within the type
TYPES = {"a": ("lower", 0.35), "g": ("lower", 0.65), "A": ("upper", 0.35), "G": ("upper", 0.65), "0": ("digit", 1.0),
         ".": ("sign", 0.35), "-": ("sign", 0.25), "/": ("sign", 0.15), "_": ("sign", 0.1), "=": ("sign", 0.1), "+": ("sign", 0.05)}
CLASSES = {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"),
           **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G")}
_CLASSES = str.maketrans(CLASSES)
MEMO = 300_000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of the base patterns, in order; spans are whole matches,
    leftmost and non-overlapping within a kind, in code points."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of credential characters, cut where base spans cover them; parts under SHORTEST are none."""
    out, i, reach = [], 0, 0
    for m in RUN.finditer(text):
        at = max(m.start(), reach)
        while i < len(base) and base[i][0] < m.end():
            if base[i][0] - at >= SHORTEST:
                out.append((at, base[i][0], text[at:base[i][0]]))
            reach = max(reach, base[i][2])  # spans of different kinds may overlap
            at = max(at, reach)
            i += 1
        if m.end() - at >= SHORTEST:
            out.append((at, m.end(), text[at:m.end()]))
    return out


class Automaton:
    """A probabilistic automaton inferred from strings of character classes."""

    def __init__(self, strings: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]  # where a class leads
        self.count: list[dict[str, int]] = [{}]  # how often it is read
        self.ends, self.total = [0], [0]
        self.to_come: list[dict[int, int]] = [{}]  # how often a string goes on for so many classes
        for s in strings:
            at = 0
            for i, c in enumerate(s):
                self.total[at] += 1
                self.to_come[at][len(s) - i] = self.to_come[at].get(len(s) - i, 0) + 1
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.to_come.append({})
                    self.ends.append(0)
                    self.total.append(0)
                at = self.next[at][c]
            self.total[at] += 1
            self.ends[at] += 1
            self.to_come[at][0] = self.to_come[at].get(0, 0) + 1
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.factor * (1 / sqrt(n1) + 1 / sqrt(n2))

    def _lengths_differ(self, a: int, b: int) -> bool:
        """Whether at some length the shares of strings that are over by then differ by more than the bounds."""
        n, m = self.total[a], self.total[b]
        f = g = 0
        for length in sorted(self.to_come[a].keys() | self.to_come[b].keys()):
            f += self.to_come[a].get(length, 0)
            g += self.to_come[b].get(length, 0)
            if self._differ(f, n, g, m):
                return True
        return False

    def _mean(self, a: int) -> float:
        return sum(k * n for k, n in self.to_come[a].items()) / self.total[a]

    def _alike(self, a: int, b: int) -> bool:
        """Whether the two states pass the tests, and all states behind them those of classes and endings."""
        if self._lengths_differ(a, b):
            return False
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b or not self.total[a] or not self.total[b]:
                continue
            if self._differ(self.ends[a], self.total[a], self.ends[b], self.total[b]):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), self.total[a], self.count[b].get(c, 0), self.total[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Adds a tree's counts to a state and to all that the tree's strings reach from it."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for k, n in self.to_come[b].items():
                self.to_come[a][k] = self.to_come[a].get(k, 0) + n
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _infer(self) -> None:
        self.factor = sqrt(0.5 * log(2 / ALPHA))
        red, known = [0], {0}
        while True:
            blue = [(-self.total[q], p, c, q) for p in red for c, q in self.next[p].items() if q not in known]
            if not blue:
                break
            _, parent, c, state = min(blue)
            mean = self._mean(state)
            for r in sorted(red, key=lambda r: (abs(self._mean(r) - mean), r)):
                if self._alike(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                known.add(state)
        self.red = red

    def log_likelihood(self, classes: str) -> float:
        """A class never seen in a state gets a small chance and counts as put in between: the state stays. Where every
        learnt string ends, a class leaves the automaton; from there on every class and the end are as likely as one another."""
        at, out = 0, 0.0
        for i, c in enumerate(classes):
            out += log((self.count[at].get(c, 0) + 0.02) / (self.total[at] + 1.0))
            if not self.next[at]:
                return out + LEFT * (len(classes) - i)
            at = self.next[at].get(c, at)
        return out + log((self.ends[at] + 0.02) / (self.total[at] + 1.0))


def _steps() -> dict[tuple[str, str], tuple[float, str]]:
    """(type read last, class) -> log of the class's chance, type to go on from."""
    out = {}
    for last, chances in ORDINARY.items():
        for c, (kind, share) in TYPES.items():
            to = "caps" if kind == "upper" and last in ("upper", "caps") else kind
            out[last, c] = (log(chances[to] * share), to)
    return out


_STEPS = _steps()


def ordinary(classes: str) -> float:
    """Log of the chance of a string of classes, not empty, in ordinary writing."""
    at, out = "", 0.0
    for c in classes:
        chance, at = _STEPS[at, c]
        out += chance
    return out + log(ORDINARY[at]["end"])


class Scorer:
    def __init__(self, learnt: dict[str, list[str]]) -> None:
        classes = {k: [s.translate(_CLASSES) for s in v] for k, v in learnt.items() if v}
        self.automata = {k: Automaton(v) for k, v in sorted(classes.items())}
        self.memo: dict[str, float] = {}

    def odds(self, classes: str) -> float:
        """Log of how much better the best credential automaton explains the string."""
        known = self.memo.get(classes)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            best = max((a.log_likelihood(classes) for a in self.automata.values()), default=float("-inf"))
            known = best - ordinary(classes)
            if len(classes) <= LONGEST:
                self.memo[classes] = known
        return known

    def added(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
        return [(a, b) for a, b, run in candidates(text, base) if self.odds(run.translate(_CLASSES)) > MIN_ODDS]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each kind, the task's SAMPLE distinct strings with the smallest hashes."""
    heaps: dict[str, list[tuple[int, str]]] = {k: [] for k in KINDS}
    held: dict[str, set[str]] = {k: set() for k in KINDS}

    def offer(kind: str, s: str) -> None:
        heap, own = heaps[kind], held[kind]
        if s in own or len(s) > LONGEST:
            return
        key = -xxhash.xxh3_64_intdigest(s)
        if len(heap) < SAMPLE:
            heapq.heappush(heap, (key, s))
            own.add(s)
        elif key > heap[0][0]:
            own.discard(heapq.heapreplace(heap, (key, s))[1])
            own.add(s)

    for batch in small(batches):
        for text in texts(batch, "_text"):
            for _, kind, _, s in base_spans(text):
                offer(KINDS[kind], s)
    rows = [(k, s, -key) for k in KINDS for key, s in heaps[k]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                      pa.array([r[2] >> 1 for r in rows], pa.int64())], ["kind", "value", "hash"])


def learn(docs: DataFrame) -> Scorer:
    """Automata from the whole table's labelled strings: the sample is of all rows, by hash, so it does
    not depend on their order."""
    found = saved(arrow_map(docs.select("_text"), _labelled, "kind string, value string, hash long").distinct(), "labelled")
    return Scorer({k: [r.value for r in found.filter(F.col("kind") == k).orderBy("hash", "value").limit(SAMPLE).collect()]
                   for k in KINDS})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "format")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format), one row per input row.

    Null and empty texts have no spans (empty string, digest of it). Null ids stay null, repeated rows
    are scanned each, other columns are ignored, an empty table gives no rows. Without any labelled
    credential in the table nothing is added to the base.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    scorer = own.sparkSession.sparkContext.broadcast(learn(own))  # automata of SAMPLE strings a kind
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_format", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for doc, text in zip(batch.column("_id").to_pylist(), texts(batch, "_text")):
                base = base_spans(text)
                added = scorer.value.added(text, base)
                plain = [(a, k, b) for a, k, b, _ in base]
                kinds = [k for _, k, _, _ in base]
                rows.append((doc, *(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(plain).encode()).hexdigest(),
                             _joined(plain + [(a, 3, b) for a, b in added]), len(added)))
            yield record(schema, list(zip(*rows)))

    return arrow_map(own, task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            if a >= at:
                out += [text[at:a], mask]
            at = b
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, mask: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every secret in their texts replaced by ``mask``; all columns stay.

    No row goes. Null and empty texts stay as they are; spans that overlap are masked as one; repeated rows are masked alike; an
    empty table gives no rows.
    """
    names = docs.columns
    held = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"),
                       F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]).alias("_row"))
    scorer = docs.sparkSession.sparkContext.broadcast(learn(held))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for text in batch.column("_text").to_pylist():
                if text:
                    base = base_spans(text)
                    spans = [(a, b) for a, _, b, _ in base] + scorer.value.added(text, base)
                    text = masked(text, spans, mask) if spans else text
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], ["_row", "_clean"])

    row_type = held.schema["_row"].dataType.simpleString()
    out = arrow_map(held.select("_row", "_text"), task, f"_row {row_type}, _clean string")
    return out.select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"_row._{i}").alias(c) for i, c in enumerate(names)])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
