"""Shared work folder and tables written once per application and input version."""

from __future__ import annotations

import hashlib
import tempfile
import threading
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

FORCE_SPLIT = "spark.sql.adaptive.forceOptimizeSkewedJoin"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_folder: str | None = None
_written: set[str] = set()
_guards_lock = threading.Lock()


_guards: defaultdict[str, threading.RLock] = defaultdict(threading.RLock)


def guard(path: str) -> threading.RLock:
    """Lock of one folder: of two threads that need a layer, one writes it and the other waits."""
    with _guards_lock:
        return _guards[path]


def workspace(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables: the one the cluster names.

    Only a local-mode session without the setting (tests) gets a temporary folder.
    """
    global _local_folder
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        _local_folder = _local_folder or tempfile.mkdtemp(prefix="audience_lens_")
        named = _local_folder
    return f"{named.rstrip('/')}/audience_lens/{spark.sparkContext.applicationId}"


def input_version(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of names, sizes and times of the input files; reads no file content."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(list(paths)).select("path", "length", "modificationTime"))
    mark = F.xxhash64("path", "length", "modificationTime")
    n, digest = files.agg(F.count("*"), F.bit_xor(mark)).first()
    return f"{n}:{digest}"


def version_tag(version: str) -> str:
    return hashlib.sha256(version.encode()).hexdigest()[:16]


def materialize_path(spark: SparkSession, name: str, version: str,
                     build: Callable[[], DataFrame], fmt: str = "parquet", **options: str) -> str:
    """Write ``build()`` once per application and input version; returns the folder."""
    path = f"{workspace(spark)}/{name}/{version_tag(version)}"
    if fmt == "parquet":
        options = {"compression": "zstd"} | options
    with guard(path):
        if path not in _written:
            build().write.mode("overwrite").format(fmt).options(**options).save(path)
            _written.add(path)
    return path


def materialize(spark: SparkSession, name: str, version: str,
                build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once for this input version, then read the written table."""
    return spark.read.parquet(materialize_path(spark, name, version, build))


@contextmanager
def hot_keys_split(spark: SparkSession) -> Iterator[None]:
    """Plans made inside split a hot key of a join even where rows must then be dealt once more behind it."""
    before = spark.conf.get(FORCE_SPLIT, None)
    spark.conf.set(FORCE_SPLIT, "true")
    try:
        yield
    finally:
        spark.conf.set(FORCE_SPLIT, before or "false")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """A query run inside leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before or "false")


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], T]]) -> list[T]:
    """Run independent Spark jobs at the same time, so that small ones fill the gaps of large ones."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [f.result() for f in futures]
