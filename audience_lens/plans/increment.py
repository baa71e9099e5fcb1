"""Refresh that reads what is new: late rows meet the partitions they belong to, and only these are written again.

Of events, equal rows share their period (a day or a month), so a period is compared with itself. Of keyed sources the first copy of each key is
kept in buckets of the key's hash, bad copies too (a bad first copy takes its key along, however late a good one lands);
an order whose first copy changes leaves its old period and enters its new one. Features come from the states of a
supporter and period, of which the changed ones are made again. Quarantine grows by the rejects of the new batches. Everything becomes
visible with one manifest, profile and actions included.
"""

from __future__ import annotations

from functools import partial, reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.operators import activity, by_supporter, serving
from audience_lens.operators import day_states as ds
from audience_lens.operators import expectations as ex
from audience_lens.operators import features as ft
from audience_lens.operators.silver import KEYS, TYPERS, dedup_first
from audience_lens.plans.medallion import Silver
from audience_lens.schemas import SOURCES
from audience_lens.sources import commits
from audience_lens.sources.headers import FILE
from audience_lens.sources.lake import Lake, Run, Snapshot
from audience_lens.sources.workspace import in_parallel, shuffles_go
from audience_lens.streaming.ingest import BATCH, ingest_all

BUCKETS = 64
BUCKET = "bucket"
_ORDER = {"supporters": "registration_date", "ecommerce_orders": "purchase_timestamp"}
_FRESH = "zz_fresh"


def advance(spark: SparkSession, landing: str, root: str, cfg: EngineConfig, updated_at: Column | None = None,
            buckets: int = BUCKETS, keep_landed: bool = True) -> int:
    """Ingests what has landed and brings every table up to it; returns the number of the run.

    The tables equal those of a rebuild from all files, whichever order the files came in. A run that stops is begun
    again from the last manifest: batches that no manifest counts are new. ``buckets`` is fixed by the first run. Without
    ``keep_landed`` a landed file is removed as soon as Bronze holds its rows. Shuffle files go with the query that made them.
    """
    with shuffles_go(spark):
        ingest_all(spark, landing, f"{root}/state", f"{root}/bronze")
        return _take_in(Lake(spark, f"{root}/lake").begin(), None if keep_landed else landing, root, cfg, updated_at, buckets)


def _take_in(run: Run, cleared: str | None, root: str, cfg: EngineConfig, updated_at: Column | None, buckets: int) -> int:
    spark = run.spark
    marks: dict[str, int] = {"buckets": run.marks.get("buckets", buckets)}
    touched: dict[str, list[str]] = {}

    def absorb(source: str) -> None:
        numbers = [int(n.partition("=")[2]) for n in commits.names(spark, f"{root}/bronze/{source}") if n.startswith(f"{BATCH}=")]
        new = sorted(n for n in numbers if n > run.marks.get(source, -1))
        if new:
            fresh = _batches(spark, f"{root}/bronze/{source}", new)
            if cleared:
                _clear_landed(fresh, f"{cleared}/{source}")
            touched[source] = _absorb(run, source, fresh, new, marks["buckets"])
            marks[source] = new[-1]

    in_parallel(spark, [partial(absorb, source) for source in SOURCES])
    if len(marks) > 1:
        _gold(run, cfg, touched, updated_at, marks["buckets"])
    return run.commit(marks)


def _batches(spark: SparkSession, bronze: str, numbers: list[int]) -> DataFrame:
    rows = spark.read.option("basePath", bronze).parquet(*[f"{bronze}/{BATCH}={n}" for n in numbers])
    return rows.withColumn(BATCH, F.col(BATCH).cast("string"))


def _clear_landed(fresh: DataFrame, folder: str) -> None:
    """Removes the files of a folder whose rows ``fresh`` has."""
    spark, within = fresh.sparkSession, folder.rpartition("/")[2]
    files = [unquote(r[0]).split("/")[-2:] for r in fresh.select(FILE).distinct().collect()]  # names, no rows
    for name in {name for parent, name in files if parent == within} & set(commits.names(spark, folder)):
        commits.remove(spark, f"{folder}/{name}")


def _values(df: DataFrame, column: str) -> list[str]:
    """Partitions that ``df`` touches: periods or buckets, never rows."""
    return [r[0] for r in df.select(column).distinct().collect()]


def _absorb(run: Run, source: str, fresh: DataFrame, numbers: list[int], buckets: int) -> list[str]:
    """Takes the new batches of a source in; returns the periods whose events have changed."""
    rejected = ex.quarantine(fresh, ex.quarantine_reasons(source))
    run.replace(f"quarantine.{source}", rejected, BATCH, map(str, numbers))
    typed = TYPERS[source](fresh)
    days = _absorb_keyed(run, source, typed, buckets) if source in KEYS else _absorb_events(run, source, typed)
    if source in ds.TIMES:
        rows = run.table(f"silver.{source}").filter(F.col(ds.DAY).isin(days))
        for state, make in ds.STATES[source].items():
            run.replace(f"state.{state}", make(rows), ds.DAY, days)
    return days


def _absorb_events(run: Run, source: str, typed: DataFrame) -> list[str]:
    """Rows are their own keys: what is new is compared with its periods."""
    name = f"silver.{source}"
    rows = ds.with_day(ex.expect_drop(typed, ex.drop_rules(source)), source).distinct()
    if not run.has(name):
        return run.replace(name, rows, ds.DAY, [])
    rows = run.staged(rows)
    days = _values(rows, ds.DAY)
    run.replace(name, rows.unionByName(run.table(name).filter(F.col(ds.DAY).isin(days))).distinct(), ds.DAY, days)
    run.release(rows)
    return days


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


def _absorb_keyed(run: Run, source: str, typed: DataFrame, buckets: int) -> list[str]:
    """First copies by key; ``won`` are the new ones, ``lost`` those whose place they take."""
    key, name = KEYS[source], f"first.{source}"
    rows = typed.filter(F.col(key).isNotNull()).withColumn(BUCKET, _bucket(key, buckets))
    touched = _values(rows, BUCKET)
    both, old = rows.withColumn(_FRESH, F.lit(1)), rows.limit(0)
    if run.has(name):
        old = run.table(name).filter(F.col(BUCKET).isin(touched))
        both = both.unionByName(old.withColumn(_FRESH, F.lit(0)))  # of equal copies the old one stays first
    first = run.staged(dedup_first(both.select(*rows.columns, _FRESH), key, [_ORDER[source]]))  # new and old copies at once
    run.replace(name, first.drop(_FRESH), BUCKET, touched)
    days = _move(run, source, first, old, key, touched, buckets) if source in ds.TIMES else []
    run.release(first)
    return days


def _move(run: Run, source: str, first: DataFrame, old: DataFrame, key: str, touched: list[str], buckets: int) -> list[str]:
    """Silver by period: a period that a key with a new first copy leaves or enters is made again, from the first copies
    that keep the rules; in buckets that nothing has come to these are the rows that it has."""
    name, won = f"silver.{source}", first.filter(f"{_FRESH} = 1").drop(_FRESH, BUCKET)
    lost = old.drop(BUCKET).join(won.select(key), key, "left_semi")
    days = _values(ds.with_day(won.unionByName(lost), source), ds.DAY)
    rows = ds.with_day(ex.expect_drop(first.drop(_FRESH, BUCKET), ex.drop_rules(source)), source)
    if run.has(name) and len(touched) < buckets:
        rows = rows.unionByName(run.table(name).filter(~_bucket(key, buckets).isin(touched)))
    run.replace(name, rows.filter(F.col(ds.DAY).isin(days)), ds.DAY, days)
    return days


def supporters(snapshot: Snapshot) -> DataFrame:
    """The dimension: first copies that keep the rules."""
    return ex.expect_drop(snapshot.table("first.supporters").drop(BUCKET), ex.drop_rules("supporters"))


def silver(snapshot: Snapshot) -> Silver:
    return Silver(supporters=supporters(snapshot), **{s: snapshot.table(f"silver.{s}").drop(ds.DAY) for s in ds.TIMES})


def base(snapshot: Snapshot, cfg: EngineConfig) -> DataFrame:
    """One row a supporter from the states; of events only the day is read in which the window begins."""
    def table(name: str) -> DataFrame:
        return snapshot.table(name)

    return ft.base_360(
        supporters(snapshot),
        ds.web_features(table("state.web_days"), table("state.web_sessions"), table("silver.web_events"), cfg),
        ds.ecom_features(table("state.merch_days")), ds.ticket_features(table("state.ticket_days")),
        ds.marketing_features(table("state.marketing_days"), table("silver.marketing_events"), cfg))


def _gold(run: Run, cfg: EngineConfig, touched: dict[str, list[str]], updated_at: Column | None, buckets: int) -> None:
    missing = [s for s in SOURCES if not run.has(f"{'first' if s in KEYS else 'silver'}.{s}")]
    if missing:
        raise ValueError(f"nothing has landed yet for {', '.join(missing)}")
    run.rewrite("gold.supporter_360", ft.overlay_scores(ft.score_360(base(run, cfg), cfg), None, cfg))
    gold = run.table("gold.supporter_360")

    in_parallel(run.spark, [
        lambda: by_supporter.publish(run, by_supporter.PROFILE, serving.publish_profile(gold), buckets),
        lambda: by_supporter.publish(run, by_supporter.ACTIONS, serving.publish_nba(gold, cfg, updated_at=updated_at), buckets)])
    _feed(run, touched, buckets)  # on its own, as it has most shuffle files


def _feed(run: Run, touched: dict[str, list[str]], buckets: int) -> None:
    """Latest activities from those of each channel and period, of which the touched ones are made again."""
    def again(source: str, days: list[str]) -> None:
        own = {s: run.table(f"silver.{s}").filter(F.col(ds.DAY).isin(days)) if s == source else run.nothing(f"silver.{s}") for s in ds.TIMES}
        feed = ds.with_day(activity.activity_feed(*own.values()), source, "activity_timestamp")
        run.replace(f"state.activity_{source}", ds.latest_of_days(feed), ds.DAY, days)

    in_parallel(run.spark, [partial(again, s, touched[s]) for s in ds.TIMES if s in touched] or [lambda: None])
    whole = reduce(DataFrame.unionByName, [run.table(f"state.activity_{s}") for s in ds.TIMES])
    by_supporter.publish(run, by_supporter.FEED, activity.export_activity(whole.drop(ds.DAY)), buckets)

