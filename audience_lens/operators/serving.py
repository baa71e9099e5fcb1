"""Operational tables: profile, next best action, snapshots and the activation log."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audience_lens.config import EngineConfig
from audience_lens.functions import rules
from audience_lens.schemas import ACTIVATION_SCHEMA, LOG_SCHEMA, PROFILE_COLUMNS
from audience_lens.sources import commits

_AMOUNTS = ("total_ticket_spend", "total_merchandise_spend", "total_customer_value")
_COUNTS = PROFILE_COLUMNS[PROFILE_COLUMNS.index("matches_attended"):]


def with_scores(gold: DataFrame, scores: DataFrame | None) -> DataFrame:
    """360 with the score table laid over it; a no-op without scores."""
    if scores is None:
        return gold
    return merge_scores(gold, scores, keep_null_scores=True)


def merge_scores(gold: DataFrame, scores: DataFrame, keep_null_scores: bool = False) -> DataFrame:
    """Matched rows take score and action; the reason changes only if the new one is not NULL.

    With ``keep_null_scores`` a NULL score or action also leaves the old value.
    """
    new = scores.select(
        "supporter_id", F.lit(True).alias("_hit"),
        F.col("purchase_intent_score").cast("int").alias("_score"),
        F.col("recommended_next_action").alias("_nba"), F.col("genai_reason").alias("_reason"))

    def take(new_col: str, old_col: str) -> Column:
        if keep_null_scores:
            return F.coalesce(new_col, old_col)
        return F.when(F.col("_hit"), F.col(new_col)).otherwise(F.col(old_col))

    return gold.join(new, "supporter_id", "left").withColumns({
        "purchase_intent_score": take("_score", "purchase_intent_score"),
        "recommended_next_action": take("_nba", "recommended_next_action"),
        "recommendation_reason": F.coalesce("_reason", "recommendation_reason"),
    }).select(*gold.columns)


def _profile_columns() -> list[Column]:
    typed: dict[str, Column] = {"season_ticket_holder": F.coalesce("season_ticket_holder", F.lit(False))}
    typed |= {c: F.col(c).cast("double") for c in _AMOUNTS}
    typed |= {c: F.col(c).cast("bigint") for c in _COUNTS}
    return [typed.get(c, F.col(c)).alias(c) for c in PROFILE_COLUMNS]


def _nba_columns(cfg: EngineConfig) -> list[Column]:
    action = F.col("recommended_next_action")
    return [
        action.alias("recommended_action"), F.col("recommendation_reason"),
        F.col("purchase_intent_score").cast("bigint").alias("intent_score"),
        rules.opportunity_type(action, cfg).alias("opportunity_type"),
    ]


def publish_profile(gold: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Operational profile rows; counts stay BIGINT so that no hot supporter overflows."""
    return with_scores(gold, scores).select(*_profile_columns())


def publish_nba(gold: DataFrame, cfg: EngineConfig, scores: DataFrame | None = None,
                updated_at: Column | None = None) -> DataFrame:
    at = F.current_timestamp() if updated_at is None else updated_at
    return with_scores(gold, scores).select(
        "supporter_id", *_nba_columns(cfg), at.alias("updated_at"))


def serve(gold: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Both operational tables as one view straight from Gold, without joining them again."""
    return gold.select(*_profile_columns(), *_nba_columns(cfg))


def load_serving(profile: DataFrame, nba: DataFrame) -> DataFrame:
    """Read-side view: profile with its next best action."""
    return profile.join(nba.drop("updated_at"), "supporter_id")


def export_snapshot(served: DataFrame) -> DataFrame:
    """Typed snapshot rows; missing numbers become 0."""
    fills: dict[str, Column] = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _AMOUNTS}
    fills |= {c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in _COUNTS}
    return served.withColumns(fills).select(
        *PROFILE_COLUMNS, "recommended_action", "recommendation_reason", "opportunity_type")


# ---- activation log ---------------------------------------------------------------------


APPROVAL_COLUMNS = ("supporter_id", "next_best_action", "campaign_objective", "recommended_channel",
                    "campaign_message", "approved_by_user")


def _part(c: str) -> Column:
    """A value with its length, or a dash for NULL: parts of different rows never read alike."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))


def _micros(c: str) -> Column:
    """Time of day to the microsecond, independent of any zone."""
    text = F.col(c).cast("string")
    return F.rpad(F.when(text.contains("."), text).otherwise(F.concat(text, F.lit("."))), 26, "0")


def activations(approvals: DataFrame, approved_at: Column | None = None) -> DataFrame:
    """Approved briefs as log rows with status ``queued``.

    The id is a digest of everything approved, by whom and when, to the microsecond: two approvals
    that differ in any column, NULLs included, have two ids. Needs ``APPROVAL_COLUMNS``.
    """
    at = (F.current_timestamp() if approved_at is None else approved_at).cast("timestamp_ntz")
    stamped = approvals.withColumn("approved_at", at)
    mark = F.md5(F.concat_ws("|", *map(_part, APPROVAL_COLUMNS), _micros("approved_at")))
    return stamped.select(
        F.concat(F.lit("act-"), mark).alias("activation_id"),
        "supporter_id",
        F.col("next_best_action").alias("recommended_action"),
        F.col("next_best_action").alias("selected_action"),
        F.col("campaign_objective").alias("campaign"),
        F.col("approved_at").alias("created_at"),
        F.lit("queued").alias("status"),
        "next_best_action", "campaign_objective", "recommended_channel", "campaign_message",
        "approved_by_user", "approved_at",
    )


def append_activations(log_path: str, approvals: DataFrame, batch_id: str,
                       approved_at: Column | None = None) -> bool:
    """Adds one batch, once: True if this call has added it, False if it was there already.

    Rows go to a folder of their own, which counts from the moment the batch's manifest names it. Manifests
    are never replaced: a replay of the same approvals changes nothing, and other approvals under a used id are a
    ValueError. What a stopped call leaves behind is not read, and goes when its batch is added; a call for the same
    batch at the same time may fail by that, and can be repeated. Without ``approved_at`` the time of approval is that of
    the first call, and no part of the comparison.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
        raise ValueError(f"batch id {batch_id!r} must be letters, digits, dots, dashes or underscores")
    spark, writing = approvals.sparkSession, uuid.uuid4().hex
    folder = f"{log_path}/{_ROWS}/batch_id={batch_id}"
    activations(approvals, approved_at).write.parquet(f"{folder}/{_WRITING}={writing}")
    rows = spark.read.schema(ACTIVATION_SCHEMA).parquet(f"{folder}/{_WRITING}={writing}")
    own = {"batch_id": batch_id, _WRITING: writing, **_content(rows, approved_at is not None)}
    manifest = f"{log_path}/{_BATCHES}/{batch_id}.json"
    added = commits.create_once(spark, manifest, own)
    kept = own if added else commits.read_once(spark, manifest)
    for name in commits.names(spark, folder):
        if name != f"{_WRITING}={kept[_WRITING]}" and (added or name == f"{_WRITING}={writing}"):
            commits.remove(spark, f"{folder}/{name}")
    if any(kept[c] != own[c] for c in ("rows", "digest")):
        raise ValueError(f"batch {batch_id!r} holds other approvals")
    return added


_ROWS, _BATCHES, _WRITING = "rows", "batches", "writing"


def _content(rows: DataFrame, dated: bool) -> dict:
    """Number and digest of a batch's rows in any order; sums tell repeated rows apart, and 128 bits different ones."""
    mark = F.concat_ws("|", *map(_part, APPROVAL_COLUMNS), *([_micros("approved_at")] if dated else []))

    def total(*salt: Column) -> Column:
        return F.coalesce(F.sum(F.xxhash64(mark, *salt).cast("decimal(38,0)")), F.lit(0)).cast("string")

    n, *sums = rows.agg(F.count("*"), total(), total(F.lit("again"))).first()
    return {"rows": n, "digest": ":".join([*sums, "dated" if dated else "undated"])}


def read_activations(spark: SparkSession, log_path: str) -> DataFrame:
    """Every approval of every batch, with its ``batch_id``; folders that no manifest names are pruned."""
    named = spark.read.schema(f"batch_id string, {_WRITING} string, rows long").json(f"{log_path}/{_BATCHES}").filter("rows > 0")
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField(_WRITING, T.StringType())])
    rows = spark.read.schema(schema).parquet(f"{log_path}/{_ROWS}")
    return rows.join(named, ["batch_id", _WRITING], "left_semi").select(*LOG_SCHEMA.names)


def recent_activations(log: DataFrame, limit: int = 20) -> DataFrame:
    """Latest by approval time, else by creation time."""
    return log.orderBy(F.coalesce("approved_at", "created_at").desc(), "activation_id").limit(limit)


def evolve_log_schema(log: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the missing columns as typed NULLs."""
    return log.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in log.columns})
