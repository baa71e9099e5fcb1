"""Volumes, persona mix and behavioural cohorts of a data set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.functions import rules, scoring
from audience_lens.operators.expectations import row_counts


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 1))


def profile_volumes(tables: Mapping[str, DataFrame]) -> DataFrame:
    return row_counts(tables)


def membership_split(supporters: DataFrame) -> DataFrame:
    members = F.count_if(rules.is_member())
    return supporters.agg(F.count("*").alias("supporters"), members.alias("members")).select(
        "supporters", "members", (F.col("supporters") - F.col("members")).alias("non_members"),
        _share(F.col("members"), F.col("supporters")).alias("member_pct"))


def persona_mix(supporters: DataFrame) -> DataFrame:
    """Rows and share per persona; the total spans the few persona rows only."""
    counts = supporters.groupBy("persona").agg(F.count("*").alias("supporters"))
    whole = F.sum("supporters").over(Window.partitionBy())
    return (counts.select("persona", "supporters", _share(F.col("supporters"), whole).alias("pct"))
            .orderBy(F.desc("supporters"), "persona"))


def recent_counts(web: DataFrame, cfg: EngineConfig) -> DataFrame:
    recent = scoring.in_window("event_timestamp", cfg)

    def n(condition: Column) -> Column:
        return F.count_if(condition & recent)

    return web.groupBy("supporter_id").agg(
        n(F.col("event_type") == "viewed_match_ticket").alias("ticket_views"),
        n(F.col("event_type") == "abandoned_cart").alias("cart_abandons"),
        n(F.col("page_type") == "Store").alias("product_views"),
    )


def ticket_browsers_no_purchase(web: DataFrame, tickets: DataFrame, cfg: EngineConfig,
                                views: int = 2) -> DataFrame:
    """Supporters with recent ticket views and no ticket order; buyers shrink to one row each."""
    buyers = tickets.select("supporter_id").distinct()
    return (recent_counts(web, cfg).filter(F.col("ticket_views") >= views)
            .select("supporter_id", "ticket_views").join(buyers, "supporter_id", "left_anti"))


def frequent_non_members(tickets: DataFrame, supporters: DataFrame, matches: int = 3) -> DataFrame:
    attended = (tickets.filter("attended").groupBy("supporter_id")
                .agg(F.count("*").alias("matches_attended"))
                .filter(F.col("matches_attended") >= matches))
    outside = supporters.filter(rules.is_non_member()).select("supporter_id", "membership_tier")
    return attended.join(outside, "supporter_id")


def vip_spenders(orders: DataFrame, spend: float = 300.0) -> DataFrame:
    total = F.sum(F.col("revenue").cast("decimal(18,4)"))
    return (orders.groupBy("supporter_id").agg(total.alias("_spend"))
            .filter(F.col("_spend") >= spend)
            .select("supporter_id", F.round("_spend", 2).cast("double").alias("merch_spend")))


def cart_abandoner_cohort(web: DataFrame, cfg: EngineConfig) -> DataFrame:
    return recent_counts(web, cfg).filter(F.col("cart_abandons") >= 1).select(
        "supporter_id", "cart_abandons")


def international(supporters: DataFrame, cfg: EngineConfig) -> DataFrame:
    abroad = ~F.initcap(F.trim("country")).eqNullSafe(cfg.home_country)
    return supporters.filter(abroad).groupBy("country").agg(F.count("*").alias("supporters"))


def distinct_buyers(orders: DataFrame, tickets: DataFrame) -> DataFrame:
    """Supporters with any merchandise or any ticket order."""
    def buyers(df: DataFrame, channel: str) -> DataFrame:
        return df.agg(F.count_distinct("supporter_id").alias("buyers")).select(
            F.lit(channel).alias("channel"), "buyers")

    return buyers(orders, "merch").unionAll(buyers(tickets, "ticketing"))


def recent_share(web: DataFrame, cfg: EngineConfig) -> DataFrame:
    recent = F.count_if(scoring.in_window("event_timestamp", cfg))
    return web.agg(F.count("*").alias("events"), recent.alias("recent")).select(
        "events", "recent", _share(F.col("recent"), F.col("events")).alias("recent_pct"))
