"""Toxicity by the nearest labelled examples: exact cosine of weighed TF-IDF vectors.

The index is fitted on a bounded sample of labelled documents (EXAMPLES, by hash of the id). Its terms are
all words and word beginnings of the sample, and every example with a letter is in it; document
frequencies are counted over all documents. A term's TF-IDF weight is multiplied by how clearly it tells
toxic examples from others (``relevance``, never 0), as plain TF-IDF lets the many words of a long text
hide its few telling ones. Every query is compared with every example: terms that many examples have by a
matrix product, the others by their postings. Votes are weighted by similarity, then mapped to chances by a
monotone table fitted to left-out votes of the examples.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.llm.common import arrow_map, record, saved, small, table, texts

EXAMPLES = 12_000
OFTEN = 8  # terms that more than one example in OFTEN has are compared by a matrix product
TOGETHER = 128  # queries compared at once
FLOOR = 0.01  # relevance of a term that tells nothing
NEIGHBOURS = 15
PRIOR_WEIGHT = 0.15  # similarity that speaks for the share of toxic examples
WORD = re.compile(r"[^\W\d_]+")
MEMO = 500_000
AT_ONCE = 1 << 20  # characters counted at once


def terms_of(word: str) -> tuple[str, ...]:
    """The word, and its beginnings of 4 and 5 letters (marked, so they differ from words)."""
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))


def relevance(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Squared number of standard errors between the log odds of a term in toxic and in clean examples and 0."""
    ratio = np.log(((pos + 0.5) / (toxic + 1)) / ((neg + 0.5) / (clean + 1)))
    return FLOOR + ratio ** 2 / (1 / (pos + 0.5) + 1 / (neg + 0.5))


def packed(terms: dict[str, int]) -> bytes:
    """Terms in the order of their ids; none has a line break."""
    return zlib.compress("\n".join(sorted(terms, key=terms.__getitem__)).encode(), 1)


def unpacked(data: bytes) -> dict[str, int]:
    text = zlib.decompress(data).decode()
    return {t: i for i, t in enumerate(text.split("\n"))} if text else {}


Vector = tuple[np.ndarray, np.ndarray]  # terms and weights


def _arrays(counts: dict[int, int]) -> Vector:
    return np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))


class Index:
    """Examples (id, label, counts by term) as unit vectors over the terms; postings by term, sorted by example."""

    def __init__(self, terms: dict[str, int], idf: np.ndarray, examples: Iterable[tuple[int, int, dict[int, int] | Vector]]) -> None:
        self.terms, self.idf, self.dense = terms, idf, None
        held, blank = [], []
        for d, y, counts in examples:
            t, n = _arrays(counts) if isinstance(counts, dict) else counts
            if norm := self._norm(t, n):
                held.append((d, y, t.astype(np.int32), n.astype(np.int32), norm))
            else:
                blank.append(y)
        self.blank = (sum(blank) + 0.5 * 0.02) / (len(blank) + 0.5)
        self.ids = np.array([d for d, *_ in held], np.int64)
        self.labels = np.array([y for _, y, *_ in held], float)
        self.norms = np.array([norm for *_, norm in held], float)
        self.prior = float(self.labels.mean()) if len(held) else self.blank
        own = np.concatenate([np.zeros(0, np.int32), *(t for _, _, t, _, _ in held)])
        order = np.argsort(own, kind="stable")
        self.rows = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for _, _, t, _, _ in held])[order]
        self.counts = np.concatenate([np.zeros(0, np.int32), *(n for _, _, _, n, _ in held)])[order]
        self.sizes = np.bincount(own, minlength=len(idf)).astype(np.int32)
        del own, order
        self._weigh()
        self.steps = np.array([[0.0, 1.0], [0.0, 1.0]])
        self._calibrate([(t, n) for _, _, t, n, _ in held])
        self.dense = None

    def _weigh(self) -> None:
        """What follows from terms, counts and norms."""
        self.first = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        self.weights = (1 + np.log(self.counts)) * np.repeat(self.idf, self.sizes) / self.norms[self.rows]
        often = self.sizes.astype(np.int64) * OFTEN > len(self.ids)
        self.often = np.where(often, np.cumsum(often) - 1, -1)  # row in the matrix, or -1

    def __getstate__(self) -> dict:
        """Small, as every executor gets a copy; the rest is made again there."""
        out = {k: v for k, v in self.__dict__.items() if k not in ("dense", "first", "weights", "often")}
        width = np.int16 if len(self.ids) < 1 << 15 else np.int32
        return {**out, "terms": packed(self.terms), "rows": zlib.compress(self.rows.astype(width).tobytes(), 1),
                "counts": zlib.compress(self.counts.tobytes(), 1), "width": width}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, dense=None, terms=unpacked(state["terms"]))
        self.rows = np.frombuffer(zlib.decompress(state["rows"]), state["width"]).astype(np.int64)  # as bincount wants them
        self.counts = np.frombuffer(zlib.decompress(state["counts"]), np.int32)
        self._weigh()

    @property
    def vectors(self) -> list[dict[int, float]]:
        out: list[dict[int, float]] = [{} for _ in self.ids]
        for t, (a, b) in enumerate(zip(self.first, self.first[1:])):
            for i, w in zip(self.rows[a:b], self.weights[a:b]):
                out[i][t] = float(w)
        return out

    def _norm(self, t: np.ndarray, n: np.ndarray) -> float:
        return float(np.sqrt((((1 + np.log(n)) * self.idf[t]) ** 2).sum()))

    def _unit(self, t: np.ndarray, n: np.ndarray) -> Vector:
        w = (1 + np.log(n)) * self.idf[t]
        norm = float(np.sqrt((w ** 2).sum()))
        return (t, w / norm) if norm else (t[:0], np.zeros(0))

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        t, w = self._unit(*_arrays(counts))
        return dict(zip(t.tolist(), w.tolist()))

    def _matrix(self) -> np.ndarray:
        if self.dense is None:
            chosen = np.flatnonzero(self.often >= 0)
            self.dense = np.zeros((len(chosen), len(self.ids)))
            for k, t in enumerate(chosen):
                part = slice(self.first[t], self.first[t + 1])
                self.dense[k, self.rows[part]] = self.weights[part]
        return self.dense

    def search(self, queries: list[Vector], skip: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each unit vector rows and cosines of the K nearest examples, ties to the earlier row; the k-th query
        leaves out row ``skip`` + k."""
        matrix, out = self._matrix(), []
        for start in range(0, len(queries), TOGETHER):
            part = queries[start:start + TOGETHER]
            known = np.zeros((len(part), len(matrix)))
            for k, (t, w) in enumerate(part):
                at = self.often[t]
                known[k, at[at >= 0]] = w[at >= 0]
            sums = known @ matrix
            for k, (t, w) in enumerate(part):
                rare = self.often[t] < 0
                t, w = t[rare], w[rare]
                score = sums[k]
                if len(t):  # whole runs are copied, as that takes a fraction of the time that picking postings one by one does
                    runs = list(map(slice, self.first[t].tolist(), self.first[t + 1].tolist()))
                    weights = np.concatenate([self.weights[run] for run in runs])
                    weights *= np.repeat(w, self.sizes[t])
                    rows = np.concatenate([self.rows[run] for run in runs], dtype=np.int64)
                    score = score + np.bincount(rows, weights, len(self.ids))
                if skip is not None:
                    score[skip + start + k] = 0
                if len(score) > NEIGHBOURS:
                    near = np.flatnonzero(score >= np.partition(score, -NEIGHBOURS)[-NEIGHBOURS])
                else:
                    near = np.arange(len(score))
                near = near[score[near] > 0]
                near = near[np.lexsort((near, -score[near]))][:NEIGHBOURS]
                out.append((near, score[near]))
        return out

    def nearest(self, q: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        return self.search([(np.array([*q], np.int64), np.array([*q.values()], float))])[0]

    def votes(self, rows: np.ndarray, scores: np.ndarray) -> float:
        weight = scores ** 2  # near examples count more
        return float(((weight * self.labels[rows]).sum() + PRIOR_WEIGHT * self.prior) / (weight.sum() + PRIOR_WEIGHT))

    def _calibrate(self, examples: list[Vector]) -> None:
        """Monotone steps from votes to the share of toxic examples, on votes without the example itself."""
        if len(self.labels) < 20:
            return
        votes = np.array([self.votes(*near) for i in range(0, len(examples), TOGETHER)
                          for near in self.search([self._unit(*x) for x in examples[i:i + TOGETHER]], skip=i)])
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # pool adjacent violators: sum of labels, size, largest vote
        for v, y in zip(votes[order], self.labels[order]):
            pools.append([y, 1.0, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], last[2]]
        self.steps = np.array([[p[2] for p in pools], [(p[0] + 0.1) / (p[1] + 0.2) for p in pools]])

    def score(self, texts_: list[dict[int, int] | Vector]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Chances of label 1 with the neighbours that speak for it; texts without a term have none."""
        out = []
        for rows, scores in self.search([self._unit(*(_arrays(x) if isinstance(x, dict) else x)) for x in texts_]):
            if not len(rows):
                out.append((self.blank, rows, scores))
                continue
            vote = self.votes(rows, scores)
            chance = float(np.interp(vote, *self.steps))
            for_it = self.labels[rows] > 0
            out.append((min(1.0, max(0.0, 0.98 * chance + 0.02 * vote)), rows[for_it], scores[for_it]))
        return out


class _TermIds(dict):
    """Ids of a word's terms."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        self[word] = ids = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        return ids


def _counts(text: str, ids: _TermIds) -> dict[int, int]:
    """One text's terms; ``_Words.counted`` gives those of many."""
    return Counter(chain.from_iterable(map(ids.__getitem__, WORD.findall(text.lower()))))


class _Words(dict):
    """Numbers of the words met so far; ``table`` has the ids of their terms, -1 for those that aren't known."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms
        self.table = np.full((1 << 12, 3), -1, np.int32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        if at == len(self.table):
            self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        ids = [self.terms.get(t, -1) for t in terms_of(word)]
        self.table[at] = ids + [-1] * (3 - len(ids))
        return at

    def _together(self, part: list[str]) -> list[Vector]:
        if len(self) > MEMO:
            self.clear()
        words = [WORD.findall(text.lower()) for text in part]
        sizes = [len(w) for w in words]
        own = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        terms = self.table[own].astype(np.int64)
        terms += np.repeat(np.arange(len(part)) * len(self.terms), sizes)[:, None]
        keys, n = np.unique(terms[self.table[own] >= 0], return_counts=True)
        cut = np.searchsorted(keys, np.arange(len(part) + 1) * len(self.terms)).tolist()
        return [(keys[a:b] - i * len(self.terms), n[a:b]) for i, (a, b) in enumerate(zip(cut, cut[1:]))]

    def counted(self, texts_: Iterable[str]) -> list[Vector]:
        """Terms, in order, and their counts of each text."""
        out: list[Vector] = []
        part: list[str] = []
        size = 0
        for text in texts_:
            part.append(text)
            size += len(text)
            if size > AT_ONCE:
                out += self._together(part)
                part, size = [], 0
        return out + self._together(part) if part else out


def learn(docs: DataFrame, labels: DataFrame) -> Index:
    """The index for documents (_id, _text), from labels (doc_id, toxic) whose id's crc32 mod 4 isn't 2."""
    spark = docs.sparkSession
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()
                           & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    chosen = (usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES))  # the bound of everything fitted
    sample = saved(docs.join(F.broadcast(chosen), docs["_id"] == chosen["doc_id"])
                   .dropDuplicates(["doc_id"]).select("doc_id", "toxic", "_text"), "examples")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [(t, y) for text, y in zip(texts(batch, "_text"), batch.column("toxic").to_pylist())
                    for t in {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())],
                                             ["term", "toxic"])

    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), sum(n for y, n in totals.items() if y)
    seen = arrow_map(sample, distinct, "term string, toxic int").groupBy("term").agg(
        F.sum((F.col("toxic") != 0).cast("int")).alias("pos"), F.sum((F.col("toxic") == 0).cast("int")).alias("neg"))
    held = seen.toArrow().sort_by("term")  # the terms of EXAMPLES documents
    ids = {t: i for i, t in enumerate(held["term"].to_pylist())}
    weight = relevance(held["pos"].to_numpy(), held["neg"].to_numpy(), toxic, clean)
    del held
    shared = spark.sparkContext.broadcast(packed(ids))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(unpacked(shared.value))
        n = np.zeros(len(known.terms) + 1, np.int64)
        for batch in small(batches):
            n[-1] += batch.num_rows
            own = [t for t, _ in known.counted(texts(batch, "_text"))]
            n += np.bincount(np.concatenate(own), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["t", "n"])

    found = arrow_map(docs.select("_text"), frequencies, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(len(ids) + 1, np.int64)
    often[found["t"].to_numpy()] = found["n"].to_numpy()
    idf = (np.log((1 + often[-1]) / (1 + often[:-1])) + 1) * weight

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(unpacked(shared.value))
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("t", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
        for batch in small(batches):
            own = known.counted(texts(batch, "_text"))
            yield record(schema, [batch.column("doc_id"), batch.column("toxic"), [t for t, _ in own], [n for _, n in own]])

    examples = arrow_map(sample, sparse, "doc_id long, toxic int, t array<int>, n array<int>").toArrow()  # EXAMPLES at most
    shared.destroy()
    doc, label, t, n = (examples[c] for c in ("doc_id", "toxic", "t", "n"))
    order = np.argsort(doc.to_numpy(), kind="stable").tolist()
    return Index(ids, idf, ((doc[i].as_py(), int(bool(label[i].as_py())), (t[i].values.to_numpy(), n[i].values.to_numpy()))
                            for i in order))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, similarity), one row per input row.

    ``evidence`` are ids of the neighbours labelled toxic, nearest first. Null and empty texts, like all
    without a term of the index, get the share of toxic ones among such examples. A null id is not held
    out; labels that are null or repeated count once, toxic if any says so; repeated rows are scored
    each; other columns are ignored; an empty table gives no rows, no labels give one low score.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    index = own.sparkSession.sparkContext.broadcast(learn(own, labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64())),
                        ("similarity", pa.list_(pa.float64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        known = _Words(held.terms)
        for batch in small(batches):
            out = held.score(known.counted(texts(batch, "_text")))
            yield record(schema, [batch.column("_id"), [s for s, _, _ in out], [held.ids[r].tolist() for _, r, _ in out],
                                  [c.tolist() for _, _, c in out]])

    scored = arrow_map(own, task, "doc_id long, score double, evidence array<long>, similarity array<double>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "similarity")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
