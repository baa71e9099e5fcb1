"""Best-fit packing with large-item matching.

Sizes are whole numbers up to the capacity, so all that decides a packing is how many items there are
of each size: at most ``capacity`` counts, whatever the corpus. The driver plans on those counts alone.
Items above a third of the capacity fit at most twice into a bin: they are matched greedily, the
largest with the largest that still fits. Smaller items, largest first, go to the smallest gap that
holds them, whole classes of equal bins at a time. The plan is a list of slot ranges ("the i-th to
j-th item of size s are put at this offset of these bins"), bounded by the capacity; every task looks
its items up by size and rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from audience_lens.llm.byte_bpe import ids_of
from audience_lens.llm.common import arrow_map, record, saved, small, table, texts

Slot = tuple[int, int, int, int]  # size, first rank, first bin, offset


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Slot ranges for ``counts`` items of each size, and the number of bins."""
    left = {s: n for s, n in counts.items() if n}
    used: dict[int, int] = defaultdict(int)  # ranks given out, by size
    slots: list[Slot] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges (first bin, how many)

    def put(size: int, n: int, first: int, offset: int) -> None:
        slots.append((size, used[size], first, offset))
        used[size] += n
        left[size] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    rising = large[::-1]
    for size in large:
        while left[size]:
            k = bisect.bisect_right(rising, min(capacity - size, size)) - 1
            while k >= 0 and not left[rising[k]]:
                k -= 1
            mate = rising[k] if k >= 0 else None
            if mate == size and left[size] < 2:
                k -= 1
                while k >= 0 and not left[rising[k]]:
                    k -= 1
                mate = rising[k] if k >= 0 else None
            n = left[size] if mate is None else left[size] // 2 if mate == size else min(left[size], left[mate])
            put(size, n, bins, 0)
            if mate is not None:
                put(mate, n, bins, size)
            gaps[capacity - size - (mate or 0)].append((bins, n))
            bins += n

    open_gaps = sorted(g for g in gaps if g)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            k = bisect.bisect_left(open_gaps, size)
            if k == len(open_gaps):  # new bins, as full of this size as they get, by the same rule
                n = -(-left[size] // (capacity // size))
                gap = capacity
                gaps[gap].append((bins, n))
                bins += n
                bisect.insort(open_gaps, gap)
                continue
            gap = open_gaps[k]
            first, n = gaps[gap].pop()
            take = min(n, left[size])
            if take < n:
                gaps[gap].append((first + take, n - take))
            if not gaps[gap]:
                open_gaps.pop(k)
            put(size, take, first, capacity - gap)
            if gap > size:
                if not gaps[gap - size]:
                    bisect.insort(open_gaps, gap - size)
                gaps[gap - size].append((first, take))
    return slots, bins


def pieces(docs: DataFrame, capacity: int, end_id: int = 2) -> DataFrame:
    """Token pieces of (doc_id, text): only documents over the capacity are cut, the first piece takes
    the remainder. ``part`` and ``place`` number the pieces of one size within the task that made them."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()),
                        ("place", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in small(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = np.append(ids_of(text), np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(head, len(ids), capacity)]):
                    own = ids[start:head if not start else start + capacity]
                    rows.append((doc, k, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            yield record(schema, list(zip(*rows)))

    return arrow_map(docs, task, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to items that have ``length``, ``part`` and ``place``
    (their rank among the part's items of that length). ``items`` must be a written table."""
    spark = items.sparkSession
    per_part = items.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(counts, capacity)
    by_size: dict[int, list[Slot]] = defaultdict(list)
    for slot in slots:
        by_size[slot[0]].append(slot)
    rows = [(s, [x[1] for x in own], [x[2] for x in own], [x[3] for x in own]) for s, own in by_size.items()]
    # at most one row for each size up to the capacity
    ranges = spark.createDataFrame(rows, "length long, _rank array<long>, _bin array<long>, _off array<long>")
    ranked = items.join(first, ["length", "part"]).withColumn("_r", F.col("first") + F.col("place"))
    k = F.expr("size(filter(_rank, x -> x <= _r))")
    return (ranked.join(F.broadcast(ranges), "length").withColumn("_k", k)
            .withColumn("sequence_id", F.expr("element_at(_bin, _k) + _r - element_at(_rank, _k)"))
            .withColumn("offset", F.expr("element_at(_off, _k)"))
            .drop("_r", "_k", "_rank", "_bin", "_off", "first"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents, each with ``end_id`` behind it, into sequences of ``capacity`` tokens.

    Null text is empty: one piece that is the end id alone. Null ids stay null, repeated rows are packed
    each, other columns are ignored, an empty table gives no rows. Sequence numbers and offsets are
    whole and gapless; which of several equal pieces goes where follows the input's partitions.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = saved(pieces(narrow, capacity, end_id), "pieces")
    return best_fit(items, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
