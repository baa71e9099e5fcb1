"""Token files: static range asymmetric numeral system over interleaved blocks.

One frequency table, counted over the whole corpus and scaled to ``1 << SCALE_BITS``, is shared by all
blocks and written beside them. A block holds whole documents, at least ``BLOCK`` ids (a longer document
is one block), and needs nothing but the table to be decoded: its ids are dealt round-robin to ``LANES``
coder states that share one word stream. Every ``STRIDE`` steps a checkpoint keeps the states and the
place in the stream, so the stretches between checkpoints decode side by side; here as one wide array.
Checksums cover each block's payload and each block's ids. Blocks are rows of a Parquet table (a
container that every store Spark reads can hold), ordered by file and number.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from audience_lens.llm.common import arrow_map, record, saved, small, table, texts

SCALE_BITS = 18
LANES = 1024
STRIDE = 128  # steps between checkpoints: 131,072 ids
BLOCK = 1 << 19  # ids of a block, at least
PART = 1 << 22  # ids of a file, about
FILES = 1 << 16  # files at most; beyond, they get larger
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sHHIQIIII")  # magic, lanes, scale bits, stride, ids, documents, words, payload crc, ids crc
MAGIC = b"RANS"


class Table:
    """Frequencies that sum to ``1 << SCALE_BITS``, each counted id at least 1."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        total = 1 << SCALE_BITS
        seen = np.flatnonzero(counts)
        if len(seen) > total // 2:
            raise ValueError(f"{len(seen)} different ids don't fit a table of {total}")
        freq = np.zeros(len(counts), np.int64)
        exact = counts[seen] * (total / max(1, counts.sum()))
        freq[seen] = np.maximum(1, exact.astype(np.int64))
        over = int(freq.sum()) - total if len(seen) else 0
        while over:  # the most frequent ids bear the rounding, in proportion
            room = np.flatnonzero(freq > 1) if over > 0 else seen
            room = room[np.argsort(-freq[room], kind="stable")]
            step = np.maximum(1, np.abs(over) * freq[room] // freq[room].sum())
            step = np.minimum(step, freq[room] - 1) if over > 0 else step
            step = np.minimum(step, np.maximum(0, abs(over) - (np.cumsum(step) - step)))
            freq[room] -= np.sign(over) * step
            over = int(freq.sum()) - total
        return cls(freq)


def encode_block(ids: np.ndarray, docs: list[int | None], lengths: list[int], own: Table, pad: int) -> bytes:
    """One block: header, document ids and lengths, checkpoints, word stream."""
    n, steps = len(ids), -(-len(ids) // LANES)
    symbols = np.full(steps * LANES, pad, np.int64)
    symbols[:n] = ids
    symbols = symbols.reshape(steps, LANES)
    x = np.full(LANES, LOW, np.uint64)
    bits, shift, word = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS), np.uint64(32)
    out: list[np.ndarray] = []
    states, written, marks = [], 0, []
    for t in range(steps - 1, -1, -1):
        f, c = own.freq[symbols[t]], own.start[symbols[t]]
        full = x >= (f << shift)
        if full.any():
            out.append(x[full].astype(np.uint32))
            written += len(out[-1])
            x = np.where(full, x >> word, x)
        q = x // f
        x = (q << bits) + (x - q * f) + c
        if t % STRIDE == 0:
            states.append(x)
            marks.append(written)
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    offsets = written - np.array(marks[::-1], np.uint32)  # words that the steps before have read
    flags = np.array([d is None for d in docs], np.uint8)
    body = b"".join([np.array([d or 0 for d in docs], "<i8").tobytes(), np.packbits(flags).tobytes(),
                     np.array(lengths, "<u4").tobytes(), offsets.astype("<u4").tobytes(),
                     np.array(states[::-1], "<u8").tobytes(), words.astype("<u4").tobytes()])
    return HEAD.pack(MAGIC, LANES, SCALE_BITS, STRIDE, n, len(docs), len(words), zlib.crc32(body),
                     zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(frame: bytes, own: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a block; raises ValueError where a checksum doesn't hold."""
    magic, lanes, scale, stride, n, n_docs, n_words, crc, ids_crc = HEAD.unpack_from(frame)
    body = memoryview(frame)[HEAD.size:]
    if magic != MAGIC or scale != SCALE_BITS or zlib.crc32(body) != crc:
        raise ValueError("not a block of this format, or damaged")
    steps = -(-n // lanes)
    marks = -(-steps // stride)
    sizes = [8 * n_docs, -(-n_docs // 8), 4 * n_docs, 4 * marks, 8 * marks * lanes, 4 * n_words]
    at = np.concatenate(([0], np.cumsum(sizes)))
    part = [body[a:b] for a, b in zip(at, at[1:])]
    null = np.unpackbits(np.frombuffer(part[1], np.uint8))[:n_docs]
    docs = [None if x else int(d) for d, x in zip(np.frombuffer(part[0], "<i8"), null)]
    lengths = np.frombuffer(part[2], "<u4").astype(np.int64)
    place = np.frombuffer(part[3], "<u4").astype(np.int64)
    x = np.frombuffer(part[4], "<u8").reshape(marks, lanes).astype(np.uint64)
    words = np.append(np.frombuffer(part[5], "<u4"), np.uint32(0)).astype(np.uint64)
    out = np.zeros((marks, stride, lanes), np.uint32)
    bits, mask, word = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
    for t in range(min(stride, steps)):
        live = marks if (marks - 1) * stride + t < steps else marks - 1  # the last stretch may be shorter
        y = x[:live]
        slot = y & mask
        s = own.symbol[slot]
        out[:live, t] = s
        y = own.freq[s] * (y >> bits) + slot - own.start[s]
        short = y < LOW
        read = np.cumsum(short, axis=1)
        fresh = words[np.minimum(place[:live, None] + read - 1, n_words)]
        x[:live] = np.where(short, (y << word) | fresh, y)
        place[:live] += read[:, -1]
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the decoded ids don't have the block's checksum")
    return docs, lengths, ids


@lru_cache(1)
def _tokenizer(path: str) -> Tokenizer:
    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    return own


LATIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")  # characters that no normalisation but lower case touches
TRICKY = re.compile(r"[!-/:-@\[-`{-~]{2}|'")  # runs of signs, and possible contractions
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
ALONE = [chr(c) for c in range(33, 127) if not chr(c).isalpha()]  # signs and digits: pre-tokens on their own


@lru_cache(1)
def _merges(path: str) -> tiktoken.Encoding:
    """The file's merges, with a space for the sign of a pre-token's end. Ids follow the order of the
    merges, so they are the ranks. Tests hold the result against the library, whose way through a word
    that it has not met is several times longer."""
    model = json.loads(_tokenizer(path).to_str())["model"]
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in signs)}
    suffix, ranks = model["end_of_word_suffix"], {}
    for piece, i in model["vocab"].items():
        if all(c in of_char for c in piece.removesuffix(suffix)):
            ranks[bytes(of_char[c] for c in piece.removesuffix(suffix)) + b" " * piece.endswith(suffix)] = i
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def word_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text. In plain Latin text every pre-token gets a space behind it and the merges run;
    texts with other characters, or what may be a special string, are left to the library."""
    if not LATIN.fullmatch(text) or "<|" in text:
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    text = text.lower()
    if TRICKY.search(text):
        text = PRE_TOKEN.sub(r"\g<0> ", text)
    else:
        for c in ALONE:
            if c in text:
                text = text.replace(c, f" {c} ")
    for c in "\t\n\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    return _merges(path).encode_to_numpy(text + " ")


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids as unsigned 16-bit integers) of (doc_id, text)."""
    if _tokenizer(path).get_vocab_size() > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u2").tobytes()
        for batch in small(batches):
            ids = [word_ids(t, path).astype("<u2").tobytes() + end for t in texts(batch)]
            yield record(schema, [batch.column("doc_id"), [len(x) // 2 for x in ids], ids])

    return arrow_map(docs, task, "doc_id long, n long, ids binary")


def frequencies(coded: DataFrame, size: int) -> tuple[Table, int]:
    """The shared table and the number of ids. Tasks count on their own; the driver gets one row for
    each id of the vocabulary, at most."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in small(batches):
            for ids in batch.column("ids").to_pylist():
                counts += np.bincount(np.frombuffer(ids, "<u2"), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in arrow_map(coded.select("ids"), task, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return Table.from_counts(counts), int(counts.sum())


def write_files(docs: DataFrame, path: str, end_id: int = 2,
                id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the ids of all documents in ascending id order; returns (blocks, frequency table), both
    written. Null text is the end id alone; null ids come first; repeated ids follow each other in the
    order of their ids; other columns are ignored; an empty table gives no blocks."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded = saved(tokenized(narrow, path, end_id), "ids")
    own, total = frequencies(coded, _tokenizer(path).get_vocab_size())
    freq = spark.createDataFrame([(int(i), int(own.freq[i])) for i in np.flatnonzero(own.freq)], "id long, freq long")
    freq = saved(freq.coalesce(1), "table")
    shared = spark.sparkContext.broadcast(own)  # as long as the vocabulary
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, inside = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ids_held, lengths, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            frame = encode_block(ids, ids_held, lengths, shared.value, end_id)
            return record(schema, [[part], [seq], [inside], [len(ids)], [frame]])

        for batch in small(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held.append(np.frombuffer(ids, "<u2").astype(np.int64))
                ids_held.append(doc)
                lengths.append(len(held[-1]))
                size += lengths[-1]
                if size >= BLOCK:
                    yield flush()
                    held, ids_held, lengths, size, seq, inside = [], [], [], 0, seq + 1, inside + size
        if held:
            yield flush()

    parts = max(1, -(-total // max(PART, -(-total // FILES))))
    dealt = coded.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    return saved(arrow_map(dealt, task, "part int, seq int, inside long, n_tokens long, frame binary"), "blocks"), freq


def read_files(blocks: DataFrame, freq: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; ``start`` counts the
    ids of all documents before it. The running sum is taken inside each file; only one total for each
    file is summed across files."""
    spark = blocks.sparkSession
    size = max((r.id for r in freq.agg(F.max("id").alias("id")).collect() if r.id is not None), default=0) + 1
    table_ = np.zeros(size, np.int64)
    for row in freq.collect():  # bounded by the vocabulary
        table_[row.id] = row.freq
    shared = spark.sparkContext.broadcast(Table(table_))
    totals = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    first = np.zeros(max(totals, default=0) + 1, np.int64)  # one number a file, FILES at most
    for part, n in totals.items():
        first[part] = n
    before = spark.sparkContext.broadcast(np.cumsum(first) - first)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            part, inside, frame = (batch.column(c)[0].as_py() for c in ("part", "inside", "frame"))
            docs, lengths, ids = decode_block(frame, shared.value)
            starts = np.cumsum(lengths) - lengths
            own = [ids[a:a + n].astype("<u4") for a, n in zip(starts, lengths)]
            columns = [docs, starts + inside + before.value[part], lengths, [zlib.crc32(x.tobytes()) for x in own]]
            yield record(schema, columns + [[x.astype(np.int32) for x in own]] * with_ids)

    return arrow_map(blocks.select("part", "inside", "frame"), task,
                     "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, freq = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_files(blocks, freq, with_ids=False)
