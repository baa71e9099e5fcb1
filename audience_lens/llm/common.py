"""Helpers shared by the corpus operators: written tables, Arrow maps, span arithmetic."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.sources.workspace import shuffles_go, workspace

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{workspace(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it again: lineage is cut, and a lost
    executor costs only the tasks it ran."""
    return _written(df, name)[0]


class Scratch:
    """Written tables of one operator that its result does not read: ``clear`` removes them."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_go(df.sparkSession):
            out, path = _written(df, name)
        self.paths.append((df.sparkSession, path))
        return out

    def clear(self) -> None:
        for spark, path in self.paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths.clear()


def equip(spark: SparkSession) -> None:
    """Python workers find this package wherever the driver found it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def arrow_map(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` on equipped workers."""
    equip(df.sparkSession)
    return df.mapInArrow(task, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, to bound what a task holds decoded."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def record(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema)


def union_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans; spans that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((first[1:], [True]))
    return starts[first], reach[last]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


HEAVY = 1024


def lookup(rows: DataFrame, key: str, values: DataFrame, spread: str) -> DataFrame:
    """``rows`` (written: they are read twice) with the columns of ``values``, which has one row a ``key``, or nulls.

    A text key with more than one row in ``HEAVY`` would land in one task; there are fewer than ``HEAVY`` of them, so
    their values are broadcast. Their rows, and those without a key, are dealt by ``spread`` instead, which differs
    from row to row; the optimizer picks the join by the size of ``values``.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).count()
    few = counts.filter(F.col("count") * HEAVY > F.lit(rows.count())).select(key)
    names = [c for c in values.columns if c != key]
    hot = values.join(F.broadcast(few), key, "left_semi").select(F.col(key).alias("_hot"), F.struct(*names).alias("_near"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = F.when(F.col("_hot").isNull(), F.col(key))
    met = met.withColumn("_dealt", F.coalesce(F.concat(F.lit("="), dealt), F.concat(F.lit("-"), F.col(spread).cast("string"))))
    far = values.select(F.concat(F.lit("="), F.col(key)).alias("_dealt"), F.struct(*names).alias("_far"))
    met = met.join(far, "_dealt", "left").withColumn("_value", F.coalesce("_near", "_far"))
    return met.select(*rows.columns, *[F.col(f"_value.{n}").alias(n) for n in names])
