"""Suffix-array dedup: bytes covered by strings of WIDTH bytes that also start anywhere else are removed.

A suffix for every byte would be many times the corpus, so the suffix array is sparse. Every window of
WIDTH bytes has an anchor, the place of its smallest K-byte hash; equal windows have their anchors at
the same offset, so suffixes that start at anchors (about one byte in 77) find every match. Consecutive
windows with one anchor form a segment.

1. Segments are range-partitioned by the hash of the anchor's leading K bytes and then by a hash of the
   segment, at sampled splitters, so a leading string of any frequency spreads over several buckets.
   Buckets sort locally; a segment is compared with its neighbours, the outermost ones of each bucket
   with those of the next bucket. Equal segments are resolved: all their windows repeat. Segments that
   share only the leading bytes with another one (at the ends of a match) are open. Copies inside one
   task are resolved there and send one row.
2. For open segments, and one of each resolved class that they meet, the bytes are fetched. Windows
   are sorted by multikey quicksort, word by word, only where a group still holds different words;
   windows equal in all their bytes repeat. Leading strings with more than HOT open segments are
   compared window by window through step 1 instead, so no task holds an unbounded group.
3. Spans of a document are united and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.llm.common import Scratch, arrow_map, mix64, record, saved, small, table, texts, union_spans

WIDTH = 200
K = 48
HOT = 20_000  # open segments of one leading string that one task compares
STRETCH = 2 << 20  # bytes hashed at a time
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
LOCAL_BIT, OFF_BITS = 16, 17  # packed: window start, flag, windows after the first, anchor offset


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position."""
    h, width, by_width = _TABLE[raw], 1, {}
    while width <= K:
        by_width[width] = h
        if width * 2 > K:
            break
        h = h[:-width] * _power(width) + h[width:]
        width *= 2
    rest, done = K - width, width
    while rest:
        part = 1 << (rest.bit_length() - 1)
        tail = by_width[part][done:]
        h = h[:len(tail)] * _power(part) + tail[:len(h)]
        done, rest = done + part, rest - part
    return mix64(h)


def segments(data: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, hash of the anchor's bytes) of every segment;
    places count from the document's start."""
    none = np.zeros(0, np.int64)
    lengths = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    if len(raw) < width:
        return none, none, none, none, none.astype(np.uint64)
    grams = gram_hashes(raw)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach, span = width - K + 1, 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:len(low) - (reach - span)], low[reach - span:])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    doc = np.repeat(np.arange(len(data)), np.maximum(0, lengths - width + 1))
    if not len(doc):
        return none, none, none, none, none.astype(np.uint64)
    count = np.maximum(0, lengths - width + 1)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    anchor = anchor[at]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    doc, anchor = doc[first], anchor[first]
    return doc, at[first] - starts[doc], at[last] - starts[doc], anchor - starts[doc], grams[anchor]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.int64)


SORTED = "kg long, seg long, rk long, packed long"
SORTED_ARROW = pa.schema([(c, pa.int64()) for c in ("kg", "seg", "rk", "packed")])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Keys, offsets and bytes of the texts, up to STRETCH bytes at a time. Longer texts come in pieces
    that overlap by less than a window, so every window is in exactly one piece."""
    rks, bases, data, size = [], [], [], 0
    for batch in small(batches):
        for rk, text in zip(batch.column("rk").to_pylist(), texts(batch)):
            whole = text.encode()
            for base in range(0, max(1, len(whole) - WIDTH + 1), STRETCH):
                rks.append(rk)
                bases.append(base)
                data.append(whole[base:base + STRETCH + WIDTH - 1])
                size += len(data[-1])
                if size >= STRETCH:
                    yield rks, bases, data
                    rks, bases, data, size = [], [], [], 0
    if data:
        yield rks, bases, data


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a task. Equal ones inside the task are resolved: one goes on with a flag, the spans of
    the others go along as rows with a negative ``packed`` (their end), ``seg`` being the start."""
    kept: list[tuple[np.ndarray, ...]] = []
    for rks, bases, data in _stretches(batches):
        doc, lo, hi, anchor, grams = segments(data)
        if not len(doc):
            continue
        digest = np.fromiter((xxhash.xxh3_64_intdigest(data[d][a:b + WIDTH]) for d, a, b in
                              zip(doc.tolist(), lo.tolist(), hi.tolist())), np.uint64, len(doc))
        start = lo + np.array(bases, np.int64)[doc]
        kept.append((_signed(grams), _signed(digest), np.array(rks, np.int64)[doc],
                     start << OFF_BITS | (hi - lo) << 8 | (anchor - lo)))
    if not kept:
        return
    kg, seg, rk, packed = (np.concatenate(x) for x in zip(*kept))
    kept.clear()
    order = np.lexsort((seg, kg))
    kg, seg, rk, packed = kg[order], seg[order], rk[order], packed[order]
    same = (kg[1:] == kg[:-1]) & (seg[1:] == seg[:-1])
    before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
    packed = np.where(before | after, packed | 1 << LOCAL_BIT, packed)
    for a in range(0, len(kg), 1 << 16):
        own = slice(a, a + (1 << 16))
        keep = ~before[own]
        yield record(SORTED_ARROW, [x[own][keep] for x in (kg, seg, rk, packed)])
    rk, lo = rk[before], packed[before] >> OFF_BITS
    end = lo + ((packed[before] >> 8) & 0xFF) + WIDTH
    docs, inverse = np.unique(rk, return_inverse=True)
    far = np.int64(1) << np.int64(40)  # spans of one document stay together, those of two apart
    start, stop = union_spans(inverse * far + lo, inverse * far + end)
    rk = docs[start // far]
    for a in range(0, len(rk), 1 << 16):
        own = slice(a, a + (1 << 16))
        yield record(SORTED_ARROW, [_signed(mix64(rk[own].astype(np.uint64) + np.uint64(a))), start[own] % far, rk[own],
                                    -(stop[own] % far)])


FOUND = "part int, side int, kind int, kg long, seg long, rk long, packed long, flags int"
FOUND_ARROW = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("kind", pa.int32()), ("kg", pa.int64()),
                         ("seg", pa.int64()), ("rk", pa.int64()), ("packed", pa.int64()), ("flags", pa.int32())])
SPAN, OPEN, EDGE = 0, 1, 2  # a resolved span; a segment whose bytes are needed; a bucket's outermost row
SEG_BEFORE, SEG_AFTER, KG_BEFORE, KG_AFTER = 1, 2, 4, 8


def _judge(packed: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are resolved, and which need their bytes compared."""
    is_span = packed < 0
    done = is_span | (packed >> LOCAL_BIT & 1 > 0) | (flags & (SEG_BEFORE | SEG_AFTER) > 0)
    meets_before = (flags & KG_BEFORE > 0) & (flags & SEG_BEFORE == 0)
    meets_after = (flags & KG_AFTER > 0) & (flags & SEG_AFTER == 0)
    return done, ~is_span & (meets_before | meets_after)


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    carry: tuple[np.ndarray, ...] | None = None  # the row not yet told, with its flags
    first = True

    def told(rows: tuple[np.ndarray, ...], flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        kg, seg, rk, packed = rows
        done, fetch = _judge(packed, flags)
        for kind, which in ((SPAN, done), (OPEN, fetch)):
            if which.any():
                n = int(which.sum())
                yield record(FOUND_ARROW, [np.full(n, part, np.int32), np.zeros(n, np.int32), np.full(n, kind, np.int32),
                                           kg[which], seg[which], rk[which], packed[which], flags[which].astype(np.int32)])

    def edge(rows: tuple, side: int) -> pa.RecordBatch:
        kg, seg, rk, packed, flags = (int(x) for x in rows)
        return record(FOUND_ARROW, [[part], [side], [EDGE], [kg], [seg], [rk], [packed], [flags]])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(batch.column(c).to_numpy() for c in ("kg", "seg", "rk", "packed"))
        flags = np.zeros(batch.num_rows, np.int64)
        if carry is not None:
            rows = tuple(np.concatenate((c, x)) for c, x in zip(carry[:4], rows))
            flags = np.concatenate((carry[4], flags))
        kg, seg = rows[0], rows[1]
        same_kg = kg[1:] == kg[:-1]
        same_seg = same_kg & (seg[1:] == seg[:-1])
        flags[1:] |= same_kg * KG_BEFORE | same_seg * SEG_BEFORE
        flags[:-1] |= same_kg * KG_AFTER | same_seg * SEG_AFTER
        if first and len(kg) > 1:  # its flag for the row after is known, not that for the row before
            yield edge((*(x[0] for x in rows), flags[0]), 0)
            rows, flags, first = tuple(x[1:] for x in rows), flags[1:], False
        if len(flags) > 1:
            yield from told(tuple(x[:-1] for x in rows), flags[:-1])
        carry = (*(x[-1:] for x in rows), flags[-1:])
    if carry is not None:
        yield edge(tuple(x[0] for x in carry), 2 if first else 1)  # 2: the bucket's only row


def _repeated(rows: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """Sample-sorts (kg, seg, rk, packed) rows and tells which are resolved or open."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange("kg", "seg").sortWithinPartitions("kg", "seg")
    found = scratch.saved(arrow_map(dealt, _compare_neighbours, FOUND), name)
    edges = sorted(found.filter(F.col("kind") == EDGE).collect(), key=lambda r: (r.part, r.side))  # two a bucket
    flags = [r.flags for r in edges]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if a.part != b.part and a.kg == b.kg:
            flags[i] |= KG_AFTER | (SEG_AFTER if a.seg == b.seg else 0)
            flags[i + 1] |= KG_BEFORE | (SEG_BEFORE if a.seg == b.seg else 0)
    done, fetch = _judge(np.array([r.packed for r in edges], np.int64), np.array(flags, np.int64))
    late = [(k, r.kg, r.seg, r.rk, r.packed) for r, d, o in zip(edges, done.tolist(), fetch.tolist())
            for k, yes in ((SPAN, d), (OPEN, o)) if yes]
    own = found.filter(F.col("kind") != EDGE).select("kind", "kg", "seg", "rk", "packed")
    return own.unionByName(spark.createDataFrame(late, "kind int, kg long, seg long, rk long, packed long"))


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kg", pa.int64()), ("rk", pa.int64()), ("packed", pa.int64()), ("context", pa.binary())])
    for batch in small(batches, 256):
        out: list[tuple] = []
        for text, rk, wanted in zip(texts(batch), batch.column("rk").to_pylist(), batch.column("wanted").to_pylist()):
            data = text.encode()
            for one in wanted:
                lo = one["packed"] >> OFF_BITS
                out.append((one["kg"], rk, one["packed"], data[lo:lo + (one["packed"] >> 8 & 0xFF) + WIDTH]))
        yield record(schema, list(zip(*out)) if out else [[]] * 4)


def equal_windows(buffer: bytes, starts: np.ndarray, group: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which windows equal, in all their bytes, another one of their group: multikey quicksort on words
    of 8 bytes, taken from both ends inwards. Groups whose words agree aren't sorted again."""
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    places = [*range(0, width - 7, 8)] + ([width - 8] if width % 8 else [])
    places = [places[k // 2] if k % 2 == 0 else places[-1 - k // 2] for k in range(len(places))]
    index = np.argsort(group, kind="stable")
    label = group[index]

    def regroup(new: np.ndarray) -> None:
        """``new`` marks group heads; windows alone in a group are told apart and go."""
        nonlocal index, label
        label = np.cumsum(new)
        alone = new & np.concatenate((new[1:], [True]))
        index, label = index[~alone], label[~alone]

    if len(index):
        regroup(np.concatenate(([True], label[1:] != label[:-1])))
    for place in places:
        if not len(index):
            break
        word = words[starts[index] + place]
        head = np.concatenate(([True], label[1:] != label[:-1]))
        differs = ~head & np.concatenate(([False], word[1:] != word[:-1]))
        if not differs.any():
            continue
        split = np.isin(label, np.unique(label[differs]))
        own = np.flatnonzero(split)
        order = own[np.lexsort((word[own], label[own]))]
        index[own], word[own] = index[order], word[order]
        regroup(np.concatenate(([True], (label[1:] != label[:-1]) | (word[1:] != word[:-1]))))
    out = np.zeros(len(starts), bool)
    out[index] = True
    return out


def _open_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that repeat among segments with the same leading bytes."""
    schema = pa.schema([("rk", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def spans(kg: np.ndarray, rk: np.ndarray, packed: np.ndarray, contexts: list[bytes]) -> pa.RecordBatch:
        count = (packed >> 8 & 0xFF) + 1
        offset, lo = packed & 0xFF, packed >> OFF_BITS
        size = np.array([len(c) for c in contexts], np.int64)
        row = np.repeat(np.arange(len(kg)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = (np.cumsum(size) - size)[row] + step
        _, rank = np.unique(kg, return_inverse=True)
        twice = equal_windows(b"".join(contexts), place, rank[row] * 256 + (offset[row] - step))
        row, step = row[twice], step[twice]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)))[:len(row)]
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(row)]))[:len(first)] - 1
        return record(schema, [rk[row[first]], lo[row[first]] + step[first], lo[row[first]] + step[last] + WIDTH])

    held: list[pa.RecordBatch] = []
    for batch in small(batches, 4096):
        held.append(batch)
        if sum(b.num_rows for b in held) < 8192:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        kg = whole.column("kg").to_numpy()
        cut = int(np.searchsorted(kg, kg[-1]))  # sorted: the last group may go on in the next batch
        if cut:
            own = whole.slice(0, cut)
            yield spans(kg[:cut], own.column("rk").to_numpy(), own.column("packed").to_numpy(),
                        own.column("context").to_pylist())
        held = whole.slice(cut).to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        if whole.num_rows:
            yield spans(*(whole.column(c).to_numpy() for c in ("kg", "rk", "packed")), whole.column("context").to_pylist())


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every window of an open segment; ``seg`` is the window's hash."""
    for batch in small(batches, 256):
        out: list[tuple] = []
        for kg, rk, packed, data in zip(*(batch.column(c).to_pylist() for c in ("kg", "rk", "packed", "context"))):
            lo = packed >> OFF_BITS
            for step in range((packed >> 8 & 0xFF) + 1):
                h = xxhash.xxh3_128_intdigest(data[step:step + WIDTH])
                # the upper half leads, so windows of one leading string spread over all buckets
                out.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), rk, (lo + step) << OFF_BITS))
        yield record(SORTED_ARROW, list(zip(*out)) if out else [[]] * 4)


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(rk, spans) for documents (rk, text) with repeated spans; a document's spans may overlap."""
    scratch = Scratch()
    found = _repeated(arrow_map(docs.select("rk", "text"), _segment_rows, SORTED), "segments", scratch)
    lo = F.shiftright("packed", OFF_BITS)
    is_span = F.col("packed") < 0
    resolved = found.filter(F.col("kind") == SPAN).select(
        "rk", F.when(is_span, F.col("seg")).otherwise(lo).alias("start"),
        F.when(is_span, -F.col("packed")).otherwise(lo + F.shiftright("packed", 8).bitwiseAND(0xFF) + WIDTH).alias("end"))
    opened = found.filter(F.col("kind") == OPEN)
    wanted = opened.groupBy("rk").agg(F.collect_list(F.struct("kg", "packed")).alias("wanted"))
    contexts = scratch.saved(arrow_map(docs.join(wanted, "rk").select("rk", "text", "wanted"), _context_rows,
                               "kg long, rk long, packed long, context binary"), "contexts")
    many = contexts.groupBy("kg").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("kg")
    many = scratch.saved(many, "hot")
    near = contexts.join(many, "kg", "left_anti").repartitionByRange("kg").sortWithinPartitions("kg")
    spans = resolved.unionByName(arrow_map(near, _open_spans, "rk long, start long, end long"))
    if not many.isEmpty():
        windows = _repeated(arrow_map(contexts.join(many, "kg", "left_semi"), _window_rows, SORTED), "windows", scratch)
        spans = spans.unionByName(windows.filter(F.col("kind") == SPAN).select(
            "rk", lo.alias("start"), (lo + WIDTH).alias("end")))
    out = saved(spans.groupBy("rk").agg(F.array_distinct(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    scratch.clear()
    return out


def _united(spans: list | None) -> tuple[list[int], list[int]]:
    pairs = np.array([(s["start"], s["end"]) for s in spans or ()], np.int64).reshape(-1, 2)
    start, end = union_spans(pairs[:, 0], pairs[:, 1])
    return start.tolist(), end.tolist()


def _cut(data: bytes, start: list[int], end: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *end], [*start, len(data)]))


def _with_spans(docs: DataFrame, hot: int) -> DataFrame:
    """``docs`` (which has ``_text``) with ``spans``. A row's key is a hash of its id and text, so rows
    that repeat an id with another text stay apart."""
    keyed = docs.withColumn("rk", F.xxhash64("_id", "_text"))
    own = keyed.select("rk", F.col("_text").alias("text"))
    return keyed.join(repeated_spans(own, hot), "rk", "left")


def dedup_digests(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, bytes, removed bytes, removed runs, digest of what remains.

    Null text counts as empty. A text that another row repeats is removed whole if it has WIDTH bytes;
    so is a row repeated with its id. Null ids stay null, other columns are ignored, an empty table
    gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for doc, text, spans in zip(batch.column("_id").to_pylist(), texts(batch, "_text"),
                                        batch.column("spans").to_pylist()):
                data = text.encode()
                start, end = _united(spans)
                rows.append((doc, len(data), sum(end) - sum(start), len(start),
                             hashlib.sha256(_cut(data, start, end)).hexdigest()))
            yield record(schema, list(zip(*rows)))

    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return arrow_map(_with_spans(narrow, hot).select("_id", "_text", "spans"), task,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept_text(texts_: pa.Array, spans: pa.Array) -> list[str | None]:
    """Texts without their spans; a character of which only some bytes go is dropped whole."""
    out = []
    for text, own in zip(texts_.to_pylist(), spans.to_pylist()):
        out.append(text if text is None or not own else _cut(text.encode(), *_united(own)).decode(errors="ignore"))
    return out


def without_repeats(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated spans taken out of their texts; all columns stay.

    No row goes: a text that repeats elsewhere in full, as that of a repeated row of 200 bytes or more, becomes an empty one. Null
    and shorter texts stay as they are, null ids too; an empty table gives no rows.
    """
    names = docs.columns
    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"),
                       F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names) if c != text_col]).alias("_row"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(_kept_text(batch.column("_text"), batch.column("spans")), pa.string())],
                ["_row", "_kept"])

    joined = _with_spans(held, hot).select("_row", "_text", "spans")
    row_type = joined.schema["_row"].dataType.simpleString()
    out = arrow_map(joined, task, f"_row {row_type}, _kept string")
    return out.select(*[F.col("_kept").alias(c) if c == text_col else F.col(f"_row._{i}").alias(c)
                        for i, c in enumerate(names)])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))
