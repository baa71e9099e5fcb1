"""Nearest vectors by inner product: multiprobe p-stable hashing with exact reranking.

Vectors are scaled by the largest norm and given one more component that makes all norms 1, so the
largest inner product is the smallest Euclidean distance. A table hashes a vector to the slots, SLOT
wide, into which its projections on Gaussian (2-stable) directions fall. The projections of a neighbour
at distance r spread normally around the query's, which gives the chance that the neighbour lies in any
other bucket: a query visits the perturbed buckets in falling order of that chance until the tables
together reach TARGET. r first comes from a bounded sample and is one for all; a query whose k-th found
neighbour is farther than that goes on with its own distance, which no true neighbour exceeds, and one that
found fewer than k visits every bucket of a table. Every row is indexed. Large buckets are split
into blocks of about BLOCK rows that the probes visit one by one, so no task holds a hot bucket.
Candidates are reranked by inner products in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from audience_lens.llm.common import arrow_map, record, saved, table

TABLES = 2
HASHES = 5
SLOT = 2.5
REACH = 3  # slots on either side of the middle; farther ones count as the outermost
TARGET = 0.95
SAMPLE = 2000  # rows to which the neighbour distance is fitted
BLOCK = 4096
_erf = np.vectorize(erf)


class Hasher:
    def __init__(self, dim: int, norm: float, radius: float) -> None:
        rng = np.random.default_rng(2024)
        self.dim, self.norm = dim, norm
        self.directions = rng.standard_normal((TABLES, dim + 1, HASHES))
        self.shift = rng.uniform(0, SLOT, (TABLES, HASHES))
        self.cos = 1 - min(radius, 1.9) ** 2 / 2

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])

    def codes(self, x: np.ndarray, t: int) -> np.ndarray:
        """Bucket numbers of index vectors: slots as digits."""
        slots = np.floor((self.lifted(x) @ self.directions[t] + self.shift[t]) / SLOT).astype(np.int64)
        digits = np.clip(slots, -REACH, REACH) + REACH
        return digits @ (2 * REACH + 1) ** np.arange(HASHES)

    def probes(self, q: np.ndarray, t: int, codes: np.ndarray, cos: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query the positions in ``codes`` to visit, likeliest first, for neighbours at its ``cos``."""
        unit = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
        cos = np.full((len(q), 1), self.cos) if cos is None else np.clip(cos, -1 + 1e-9, 1 - 1e-9)[:, None]
        mean, spread = cos * (unit @ self.directions[t]), np.sqrt(1 - cos ** 2)
        log_p = np.zeros((len(q), len(codes)))
        edges = np.arange(-REACH, REACH + 2) * SLOT
        for k in range(HASHES):
            below = 0.5 * (1 + _erf((edges - self.shift[t, k] - mean[:, k:k + 1]) / (spread * sqrt(2))))
            below[:, 0], below[:, -1] = 0, 1
            slot = codes // (2 * REACH + 1) ** k % (2 * REACH + 1)
            log_p += np.log(np.diff(below, axis=1) + 1e-12)[:, slot]
        order = np.argsort(-log_p, axis=1, kind="stable")
        sure = np.cumsum(np.take_along_axis(np.exp(log_p), order, 1), axis=1)
        each = 1 - (1 - TARGET) ** (1 / TABLES)
        return [o[:n] for o, n in zip(order, (sure < each).sum(axis=1) + 1)]

    def more_probes(self, q: np.ndarray, t: int, codes: np.ndarray, kth: np.ndarray) -> list[np.ndarray]:
        """What ``probes`` left out, for queries whose k-th neighbour found has the score ``kth`` (-inf: there is none)
        and lies beyond the distance assumed there."""
        cos = kth / (self.norm * np.linalg.norm(q, axis=1))
        out = [np.zeros(0, np.int64)] * len(q)
        far = np.flatnonzero(cos < self.cos)
        for at in (far[i:i + 64] for i in range(0, len(far), 64)):
            wider = self.probes(q[at], t, codes, np.maximum(cos[at], -1))
            for i, before, now in zip(at.tolist(), self.probes(q[at], t, codes), wider):
                if np.isneginf(kth[i]):
                    now = np.arange(len(codes)) if t == 0 else now[:0]
                out[i] = np.setdiff1d(now, before)
        return out


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows that take part. Ids that are null, vectors that are null, empty, zero or hold null
    or non-finite components, and vectors of another than the most frequent length, do not."""
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(False))
                     & F.exists("vec", lambda x: x != 0))
    lengths = own.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    return own.filter(F.size("vec") == (lengths[0].dim if lengths else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(rows: DataFrame, k: int) -> Hasher | None:
    found = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("top"),
                     F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not found.n:
        return None
    sample = np.array([r.vec for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    hasher = Hasher(found.dim, sqrt(found.top) or 1.0, 1.0)
    base = hasher.lifted(sample)
    unit = np.column_stack([sample / np.linalg.norm(sample, axis=1, keepdims=True), np.zeros(len(sample))])[:200]
    near = -np.sort(-(unit @ base.T), axis=1)[:, 1:]
    rank = min(near.shape[1], max(1, round(k * len(sample) / found.n))) - 1
    radius = float(np.median(np.sqrt(np.maximum(1e-6, 2 - 2 * near[:, rank])))) if near.shape[1] else 1.0
    return Hasher(found.dim, hasher.norm, max(radius, 0.3))


def search(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by ``every`` the ``k`` nearest others
    found, by falling inner product, ties to the smaller id.

    Rows that take no part: see ``valid_vectors``. Rows repeating an id are one candidate with its best
    score; a query never finds its own id; other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    own = valid_vectors(rows, id_col, vec_col)
    hasher = fit(own, k)
    if hasher is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared, dim = spark.sparkContext.broadcast(hasher), hasher.dim

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(shared.value.codes(x, t))],
                                                 ["t", "code"])

    # at most (2 REACH + 1) ** HASHES buckets a table
    sizes = arrow_map(own.select("vec"), codes, "t int, code long").groupBy("t", "code").agg(F.count("*").alias("n")).collect()
    buckets = []
    for t in range(TABLES):
        mine = sorted((r.code, r.n) for r in sizes if r.t == t)
        buckets.append((np.array([c for c, _ in mine], np.int64), np.array([-(-n // BLOCK) for _, n in mine], np.int64)))
    plan = spark.sparkContext.broadcast(buckets)
    dealt_schema = pa.schema([("t", pa.int32()), ("code", pa.int64()), ("block", pa.int64()), ("side", pa.int32()),
                              ("id", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row as a candidate once a table, and the visits of the queries; further ones if there is a column kth."""
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x, ids, salt = _matrix(part.column("vec"), dim), part.column("id").to_numpy(), part.column("salt").to_numpy()
                asks, again = np.flatnonzero(ids % every == 0), "kth" in part.schema.names
                kth = part.column("kth").to_numpy(zero_copy_only=False)[asks] if again else None
                for t, (known, blocks) in enumerate(plan.value):
                    code = shared.value.codes(x, t)
                    yield record(dealt_schema, [np.full(len(x), t, np.int32), code, salt % blocks[np.searchsorted(known, code)],
                                                np.zeros(len(x), np.int32), ids, part.column("vec")])
                    if not len(asks):
                        continue
                    wanted = shared.value.more_probes(x[asks], t, known, kth) if again else shared.value.probes(x[asks], t, known)
                    visits = [(i, b, s) for i, own_ in zip(asks.tolist(), wanted) for b in own_.tolist() for s in range(blocks[b])]
                    if not visits:
                        continue
                    row, b, s = (np.array(v, np.int64) for v in zip(*visits))
                    yield record(dealt_schema, [np.full(len(row), t, np.int32), known[b], s, np.ones(len(row), np.int32),
                                                ids[row], part.column("vec").take(pa.array(row))])

    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block, index rows before the probes that visit them."""
        key, ids, parts = None, [], []
        index_ids, index = np.zeros(0, np.int64), np.zeros((0, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([batch.column(c).to_numpy() for c in ("t", "code", "block", "side")])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                own_ids, x = batch.column("id").to_numpy()[a:b], _matrix(batch.column("vec").slice(a, b - a), dim)
                if tuple(marks[a, :3]) != key:
                    key, ids, parts = tuple(marks[a, :3]), [], []
                    index_ids, index = np.zeros(0, np.int64), np.zeros((0, dim))
                if marks[a, 3] == 0:
                    ids.append(own_ids)
                    parts.append(x)
                    continue
                if parts:
                    index_ids, index = np.concatenate([index_ids, *ids]), np.concatenate([index, *parts])
                    ids, parts = [], []
                for c in range(0, len(x), 256):
                    yield from best(own_ids[c:c + 256], x[c:c + 256], index_ids, index)

    def best(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        near = q @ x.T
        out: list[tuple[np.ndarray, ...]] = []
        for one, vec, row in zip(asked, q, near):
            row = np.where(ids == one, -np.inf, row)
            bound = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            picked = np.flatnonzero((row >= bound - 1e-9 * (1 + abs(bound))) & (row > -np.inf))
            score = (x[picked] * vec).sum(axis=1)  # the same order of additions for every row: equal vectors tie
            order = np.lexsort((ids[picked], -score))[:k]
            out.append((np.full(len(order), one), ids[picked][order], score[order]))
        yield record(found_schema, [np.concatenate(c) for c in zip(*out)])

    def visited(rows_: DataFrame) -> DataFrame:
        dealt = arrow_map(rows_.withColumn("salt", F.expr("pmod(xxhash64(id), 1000003)")), deal,
                          "t int, code long, block long, side int, id long, vec array<double>")
        ordered = dealt.repartition("t", "code", "block").sortWithinPartitions("t", "code", "block", "side", "id")
        return arrow_map(ordered, rerank, "query_id long, vec_id long, score double")

    def nearest(found: DataFrame) -> DataFrame:
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = saved(nearest(visited(own)), "neighbours")  # at most k rows a query
    last = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    kth = F.when(F.col("id") % every == 0, F.coalesce("kth", F.lit(float("-inf"))))
    further = own.join(last, F.col("id") == F.col("query_id"), "left").select("id", "vec", kth.alias("kth"))
    return nearest(first.select("query_id", "vec_id", "score").unionByName(visited(further)))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
