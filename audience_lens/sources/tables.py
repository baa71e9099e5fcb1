"""File and table sources/sinks of the batch path."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audience_lens.schemas import CORRUPT
from audience_lens.sources import headers


def with_lineage(df: DataFrame) -> DataFrame:
    """Adds the source file and the ingest time; works on batch and stream reads."""
    return df.select("*", F.col("_metadata.file_path").alias("_source_file"),
                     F.current_timestamp().alias("_ingested_at"))


def csv_options() -> dict[str, str]:
    """All-string permissive read: malformed lines land in the corrupt-record column.

    Without column pruning a line is checked in full, whichever columns a query needs.
    """
    return {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
            "columnPruning": "false"}


def ingest_batch(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Full read of one source folder with lineage, columns by header name, rescued fields and lines.

    The headers are looked up when this is called; the rows are read with the result.
    """
    return headers.matched(headers.read_lines(spark, path), source, csv_options())


def rescue_malformed(bronze: DataFrame) -> DataFrame:
    """Lines that did not fit the schema, kept verbatim."""
    return bronze.filter(F.col(CORRUPT).isNotNull())


VERSIONS, KEPT = "_versions", 2


def _folder(spark: SparkSession, path: str):
    """A folder on whatever store it lies, as the store's client and the folder's name."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a table, oldest first; a version is complete once its commit is marked."""
    store, folder = _folder(spark, f"{path}/{VERSIONS}")
    if not store.exists(folder):
        return []
    found = sorted(status.getPath().toString() for status in store.listStatus(folder))
    return [v for v in found if store.exists(_folder(spark, f"{v}/_SUCCESS")[1])]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Writes a new version beside the current one. Readers see it when its commit is marked complete, a
    failed write leaves the table as it was, and the last KEPT versions stay readable."""
    spark = df.sparkSession
    version = f"{path}/{VERSIONS}/{time.time_ns():020d}"
    df.write.format(fmt).partitionBy(*partition_by).save(version)
    for old in versions(spark, path)[:-KEPT]:
        store, folder = _folder(spark, old)
        store.delete(folder, True)


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str],
               partitions: int = 16) -> None:
    """Truncate-and-load of an operational table, in parallel over few connections."""
    (df.coalesce(partitions).write.mode("overwrite").option("truncate", "true")
     .option("batchsize", "1000").jdbc(url, table, properties=dict(properties)))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """The current version of a table, or the folder itself if it was not written by ``write_table``."""
    reader = spark.read.format(fmt) if schema is None else spark.read.format(fmt).schema(schema)
    return reader.load((versions(spark, path) or [path])[-1])
