"""Per-supporter features and the one-row-per-supporter 360.

Every channel is aggregated to one row per supporter before any join. Partial aggregation
absorbs hot supporters, and the joins then meet unique keys on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.functions import cleaning as cl
from audience_lens.functions import rules, scoring
from audience_lens.schemas import GOLD_COLUMNS


def _total(amount: str) -> Column:
    return F.round(F.sum(cl.money(amount)), 2).cast("double")


def web_features(web: DataFrame, cfg: EngineConfig) -> DataFrame:
    recent = scoring.in_window("event_timestamp", cfg)

    def views(condition: Column) -> Column:
        return F.count(F.when(condition & recent, 1))

    def of_type(event: str) -> Column:
        return views(F.col("event_type") == event)

    return web.groupBy("supporter_id").agg(
        F.count_distinct(F.when(recent, F.col("session_id"))).alias("website_sessions_30d"),
        views(F.col("page_type") == "Store").alias("product_views_30d"),
        of_type("viewed_match_ticket").alias("ticket_views_30d"),
        of_type("abandoned_cart").alias("cart_abandons_30d"),
        of_type("viewed_membership").alias("membership_views_30d"),
        of_type("viewed_hospitality").alias("hospitality_views_30d"),
        F.max("event_timestamp").alias("last_web_event"),
    )


def ecom_features(orders: DataFrame) -> DataFrame:
    return orders.groupBy("supporter_id").agg(
        _total("revenue").alias("total_merchandise_spend"),
        F.count("*").alias("merchandise_orders"),
        F.max("purchase_timestamp").alias("last_merch_purchase"),
    )


def ticket_features(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("supporter_id").agg(
        _total("ticket_price").alias("total_ticket_spend"),
        F.count("*").alias("ticket_purchases"),
        F.count_if(F.col("attended")).alias("matches_attended"),
        F.max(F.when(F.col("attended"), F.col("purchase_timestamp"))).alias("last_match_attended"),
        F.max("purchase_timestamp").alias("last_ticket_purchase"),
    )


def marketing_features(marketing: DataFrame, cfg: EngineConfig) -> DataFrame:
    recent = scoring.in_window("event_timestamp", cfg)
    return marketing.groupBy("supporter_id").agg(
        F.count_if(F.col("opened") & recent).alias("marketing_opens_30d"),
        F.count_if(F.col("clicked") & recent).alias("marketing_clicks_30d"),
        F.max("event_timestamp").alias("last_marketing_event"),
    )


_COUNTS = (
    "matches_attended", "ticket_purchases", "merchandise_orders", "website_sessions_30d",
    "product_views_30d", "ticket_views_30d", "cart_abandons_30d", "membership_views_30d",
    "hospitality_views_30d", "marketing_opens_30d", "marketing_clicks_30d",
)


def base_360(supporters: DataFrame, web_f: DataFrame, ecom_f: DataFrame, ticket_f: DataFrame,
             marketing_f: DataFrame) -> DataFrame:
    """Dimension left-joined with the four pre-aggregates; all five share one partitioning."""
    joined = supporters
    for features in (web_f, ecom_f, ticket_f, marketing_f):
        joined = joined.join(features, "supporter_id", "left")
    return joined.select(
        *supporters.columns,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_ticket_spend", "total_merchandise_spend")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS],
        "last_match_attended",
        scoring.latest("last_merch_purchase", "last_ticket_purchase").alias("last_purchase_ts"),
        scoring.latest("last_web_event", "last_merch_purchase", "last_ticket_purchase",
                       "last_marketing_event").alias("last_activity_ts"),
    )


def score_360(base: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Value, recency, both rule scores, baseline action and reason."""
    value = cl.money("total_ticket_spend", 2) + cl.money("total_merchandise_spend", 2)
    return (
        base
        .withColumns({
            "total_customer_value": value.cast("double"),
            "days_since_last_purchase": scoring.recency_days("last_purchase_ts", cfg),
            "days_since_last_activity": scoring.recency_days("last_activity_ts", cfg),
        })
        .withColumns({
            "engagement_score": scoring.engagement_score(cfg),
            "purchase_intent_score": scoring.baseline_intent(cfg),
            "recommended_next_action": rules.baseline_nba(cfg),
            "recommendation_reason": rules.baseline_reason(cfg),
        })
    )


def overlay_scores(scored: DataFrame, ml: DataFrame | None, cfg: EngineConfig) -> DataFrame:
    """Gold 360: model score, action and reason where present, the rule baseline elsewhere."""
    if ml is not None:
        over = ml.select(
            "supporter_id",
            F.col("purchase_intent_score").alias("_score"),
            F.col("recommended_next_action").alias("_nba"),
            F.col("genai_reason").alias("_reason"),
        )
        scored = scored.join(over, "supporter_id", "left").withColumns({
            "purchase_intent_score": F.coalesce("_score", "purchase_intent_score").cast("int"),
            "recommended_next_action": F.coalesce("_nba", "recommended_next_action"),
            "recommendation_reason": F.coalesce("_reason", "recommendation_reason"),
        })
    return scored.withColumn("scored_at", scoring.ref_ts(cfg)).select(*GOLD_COLUMNS)
