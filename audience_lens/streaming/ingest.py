"""Incremental file ingest: each landed file is read exactly once."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.operators import expectations as ex
from audience_lens.operators.silver import TYPERS
from audience_lens.schemas import SOURCES
from audience_lens.sources import headers
from audience_lens.sources.tables import csv_options
from audience_lens.sources.workspace import in_parallel

BATCH = "batch_id"


def ingest_stream(spark: SparkSession, landing: str, source: str, checkpoint: str, out: str,
                  max_files: int = 1000) -> None:
    """Append the files that arrived since the last run to the Bronze table, then stop.

    Progress lives in ``checkpoint``, so a restarted driver neither skips nor repeats a file. Each micro-batch has a
    folder of its own in the table, named by its number, and two beside the checkpoint for the layouts of its files and
    the counts of its expectations: a batch that is run again replaces its first writing, and nothing counts twice.
    """
    def land(batch: DataFrame, number: int) -> None:
        rows = headers.matched(batch, source, csv_options(), f"{checkpoint}_headers/{BATCH}={number}")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{BATCH}={number}")
        written = rows.sparkSession.read.schema(rows.schema).parquet(f"{out}/{BATCH}={number}")
        counts = ex.expectation_counts(TYPERS[source](written), source)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}_expectations/{BATCH}={number}")

    (headers.lines(spark.readStream.option("maxFilesPerTrigger", str(max_files)).text(landing))
     .writeStream.foreachBatch(land)
     .option("checkpointLocation", checkpoint)
     .trigger(availableNow=True)
     .start()
     .awaitTermination())


def stream_expectations(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows checked and rows failing by rule, over all batches that the stream has landed."""
    counts = spark.read.schema(f"{ex.COUNTS_DDL}, {BATCH} long").parquet(f"{checkpoint}_expectations")
    return counts.groupBy("source", "kind", "rule").agg(F.sum("checked").alias("checked"), F.sum("failed").alias("failed"))


def ingest_all(spark: SparkSession, landing: str, state: str, bronze: str) -> None:
    """All five sources from ``landing/<source>`` to ``bronze/<source>``."""
    in_parallel(spark, [
        partial(ingest_stream, spark, f"{landing}/{s}", s, f"{state}/{s}", f"{bronze}/{s}") for s in SOURCES])
