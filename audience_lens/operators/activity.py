"""Cross-channel activity feed and its latest-n export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audience_lens.functions.cleaning import clock


def _entry(df: DataFrame, channel: str, kind: Column, detail: str, at: str) -> DataFrame:
    return df.select(
        "supporter_id", F.lit(channel).alias("channel"), kind.alias("activity_type"),
        F.col(detail).alias("activity_detail"), F.col(at).alias("activity_timestamp"),
    )


def activity_feed(web: DataFrame, orders: DataFrame, tickets: DataFrame,
                  marketing: DataFrame) -> DataFrame:
    """One row per activity; a marketing row carries its most advanced state."""
    visit = F.when(F.col("attended"), "attended").otherwise("ticket_purchase")
    state = (F.when(F.col("converted"), "converted").when(F.col("clicked"), "clicked")
             .when(F.col("opened"), "opened").otherwise("sent"))
    return reduce(DataFrame.unionByName, [
        _entry(web, "web", F.col("event_type"), "page_name", "event_timestamp"),
        _entry(orders, "merch", F.lit("purchase"), "product", "purchase_timestamp"),
        _entry(tickets, "ticketing", visit, "match", "purchase_timestamp"),
        _entry(marketing, "marketing", state, "campaign", "event_timestamp"),
    ])


def latest_activities(activity: DataFrame, n: int = 10) -> DataFrame:
    """Latest ``n`` per supporter with their rank; pruned to n per task before the shuffle."""
    w = Window.partitionBy("supporter_id").orderBy(
        F.desc_nulls_last("activity_timestamp"), "channel", "activity_type",
        F.asc_nulls_last("activity_detail"))
    return activity.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def export_activity(activity: DataFrame, n: int = 10) -> DataFrame:
    """One row per supporter with the nested list of its latest activities, newest first."""
    item = F.struct(
        "position", "channel", "activity_type", "activity_detail",
        clock("activity_timestamp").alias("activity_timestamp"))
    listed = F.array_sort(F.collect_list(item))
    return (latest_activities(activity, n).groupBy("supporter_id").agg(listed.alias("_items"))
            .select("supporter_id", F.transform("_items", lambda x: x.dropFields("position"))
                    .alias("activity")))
