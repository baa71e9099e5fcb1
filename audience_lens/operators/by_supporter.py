"""Serving tables laid out for looking single supporters up.

Rows are dealt by the supporter's hash, sorted by supporter inside a bucket, and each row group has a Bloom filter of its
supporters: a lookup of a few ids reads the footers of their buckets and the row groups that may hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audience_lens.operators import analytics, serving
from audience_lens.sources.lake import Run, Snapshot

BUCKET, BUCKETS = "bucket", 64
KEY = "supporter_id"
PROFILE, ACTIONS, FEED = "serving.supporter_profile", "serving.next_best_action", "serving.activity_feed"
MOST_IDS = 1000  # ids of one lookup; more of them are a join


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


def publish(run: Run, name: str, rows: DataFrame, buckets: int = BUCKETS, **options: str) -> None:
    """Writes a whole table in this layout; ``options`` go to the Parquet writer, besides those of the Bloom filter."""
    bloom = {f"parquet.bloom.filter.enabled#{KEY}": "true"} | options
    old = run.tables.get(name, {"parts": {}})
    run.replace(name, rows.withColumn(BUCKET, _bucket(F.col(KEY), buckets)), BUCKET, old["parts"], [KEY], bloom)
    run.marks[f"buckets.{name}"] = buckets


def read(snapshot: Snapshot, name: str) -> DataFrame:
    return snapshot.table(name).drop(BUCKET)


def lookup(snapshot: Snapshot, name: str, ids: Sequence[str]) -> DataFrame:
    """Rows of the given supporters, at most ``MOST_IDS``; ids that don't exist have none, repeated ones count once."""
    if len(ids) > MOST_IDS:
        raise ValueError(f"{len(ids)} ids in one lookup; join with a table of them instead")
    buckets = snapshot.marks[f"buckets.{name}"]
    of_ids = [_bucket(F.lit(i), buckets) for i in ids]
    return snapshot.table(name).filter(F.col(BUCKET).isin(*of_ids) & F.col(KEY).isin(*ids)).drop(BUCKET)


def served(snapshot: Snapshot, ids: Sequence[str] | None = None) -> DataFrame:
    """Profiles with their next best action, both of the snapshot's run; of all supporters or of some."""
    parts = [read(snapshot, t) if ids is None else lookup(snapshot, t, ids) for t in (PROFILE, ACTIONS)]
    return serving.load_serving(*parts)


def detail(snapshot: Snapshot, ids: Sequence[str]) -> DataFrame:
    """``analytics.supporter_detail`` of some supporters."""
    return analytics.supporter_detail(served(snapshot, ids), lookup(snapshot, FEED, ids))
