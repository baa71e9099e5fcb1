"""Features of a supporter from states of a supporter and period, which merge.

A period is a day where a recent window is asked for, and a month where only totals are. A state is what a period adds:
sums, counts and maxima, and the set of sessions as rows. A refresh makes the states of the periods that have changed
again, and the features from all states; a supporter's periods are few, whatever the number of events. The recent window
may begin inside a day: that day's part is made from its events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.functions import cleaning as cl
from audience_lens.functions import scoring
from audience_lens.operators import activity

DAY = "day"  # the period's column
UNDATED = "undated"  # sorts behind every date
TIMES = {"web_events": "event_timestamp", "ecommerce_orders": "purchase_timestamp", "ticket_orders": "purchase_timestamp",
         "marketing_events": "event_timestamp"}
PERIODS = {"web_events": "yyyy-MM-dd", "ecommerce_orders": "yyyy-MM", "ticket_orders": "yyyy-MM", "marketing_events": "yyyy-MM-dd"}

_VIEWS = ("product_views_30d", "ticket_views_30d", "cart_abandons_30d", "membership_views_30d", "hospitality_views_30d")


def with_day(df: DataFrame, source: str, time: str | None = None) -> DataFrame:
    """Adds the period of a row's time, as text; rows without a time have a period of their own."""
    return df.withColumn(DAY, F.coalesce(F.date_format(time or TIMES[source], PERIODS[source]), F.lit(UNDATED)))


def web_days(web: DataFrame) -> DataFrame:
    def of_type(event: str) -> Column:
        return F.count_if(F.col("event_type") == event)

    views = (F.count_if(F.col("page_type") == "Store"), of_type("viewed_match_ticket"), of_type("abandoned_cart"),
             of_type("viewed_membership"), of_type("viewed_hospitality"))
    return web.groupBy("supporter_id", DAY).agg(*[v.alias(c) for v, c in zip(views, _VIEWS)],
                                                F.max("event_timestamp").alias("last_web_event"))


def web_sessions(web: DataFrame) -> DataFrame:
    return web.filter("session_id IS NOT NULL").select("supporter_id", "session_id", DAY).distinct()


def merch_days(orders: DataFrame) -> DataFrame:
    return orders.groupBy("supporter_id", DAY).agg(
        F.sum(cl.money("revenue")).alias("spent"), F.count("*").alias("merchandise_orders"),
        F.max("purchase_timestamp").alias("last_merch_purchase"))


def ticket_days(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("supporter_id", DAY).agg(
        F.sum(cl.money("ticket_price")).alias("spent"), F.count("*").alias("ticket_purchases"),
        F.count_if("attended").alias("matches_attended"),
        F.max(F.when(F.col("attended"), F.col("purchase_timestamp"))).alias("last_match_attended"),
        F.max("purchase_timestamp").alias("last_ticket_purchase"))


def marketing_days(marketing: DataFrame) -> DataFrame:
    return marketing.groupBy("supporter_id", DAY).agg(
        F.count_if("opened").alias("marketing_opens_30d"), F.count_if("clicked").alias("marketing_clicks_30d"),
        F.max("event_timestamp").alias("last_marketing_event"))


#: State tables of a source and how a day's rows make them.
STATES = {
    "web_events": {"web_days": web_days, "web_sessions": web_sessions},
    "ecommerce_orders": {"merch_days": merch_days},
    "ticket_orders": {"ticket_days": ticket_days},
    "marketing_events": {"marketing_days": marketing_days},
}


def latest_of_days(feed: DataFrame, n: int = 10) -> DataFrame:
    """The latest ``n`` activities of a supporter and period; the latest ``n`` of all are among them."""
    dated = activity.latest_activities(feed.withColumn("supporter_id", F.struct("supporter_id", DAY)), n)
    return dated.drop("position", DAY).withColumn(DAY, F.col("supporter_id")[DAY]).withColumn("supporter_id", F.col("supporter_id")["supporter_id"])


def _window(cfg: EngineConfig) -> tuple[str, str | None]:
    """First whole day of the recent window, and the day that it begins inside, if any."""
    start = cfg.window_start
    day = start.date()
    if start == dt.datetime.combine(day, dt.time()):
        return day.isoformat(), None
    return (day + dt.timedelta(days=1)).isoformat(), day.isoformat()


def _recent(state: DataFrame, events: DataFrame, source: str, make, cfg: EngineConfig) -> DataFrame:
    """States of the window: its whole days as they are, and the part of the day it begins in."""
    first, part = _window(cfg)
    days = state.filter((F.col(DAY) >= first) & (F.col(DAY) != UNDATED))
    if part is None:
        return days
    return days.unionByName(make(events.filter((F.col(DAY) == part) & scoring.in_window(TIMES[source], cfg))))


def web_features(days: DataFrame, sessions: DataFrame, web: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The columns of ``features.web_features``; of ``web`` only the day is read in which the window begins."""
    recent = _recent(days, web, "web_events", web_days, cfg)
    views = recent.groupBy("supporter_id").agg(*[F.sum(c).alias(c) for c in _VIEWS])
    seen = _recent(sessions, web, "web_events", web_sessions, cfg).groupBy("supporter_id").agg(
        F.count_distinct("session_id").alias("website_sessions_30d"))
    last = days.groupBy("supporter_id").agg(F.max("last_web_event").alias("last_web_event"))
    joined = last.join(views, "supporter_id", "left").join(seen, "supporter_id", "left")
    return joined.select("supporter_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("website_sessions_30d", *_VIEWS)], "last_web_event")


def _spent(name: str) -> Column:
    return F.round(F.sum("spent"), 2).cast("double").alias(name)


def ecom_features(days: DataFrame) -> DataFrame:
    return days.groupBy("supporter_id").agg(
        _spent("total_merchandise_spend"), F.sum("merchandise_orders").alias("merchandise_orders"),
        F.max("last_merch_purchase").alias("last_merch_purchase"))


def ticket_features(days: DataFrame) -> DataFrame:
    return days.groupBy("supporter_id").agg(
        _spent("total_ticket_spend"), F.sum("ticket_purchases").alias("ticket_purchases"),
        F.sum("matches_attended").alias("matches_attended"), F.max("last_match_attended").alias("last_match_attended"),
        F.max("last_ticket_purchase").alias("last_ticket_purchase"))


def marketing_features(days: DataFrame, marketing: DataFrame, cfg: EngineConfig) -> DataFrame:
    counts = ("marketing_opens_30d", "marketing_clicks_30d")
    recent = _recent(days, marketing, "marketing_events", marketing_days, cfg)
    recent = recent.groupBy("supporter_id").agg(*[F.sum(c).alias(c) for c in counts])
    last = days.groupBy("supporter_id").agg(F.max("last_marketing_event").alias("last_marketing_event"))
    return last.join(recent, "supporter_id", "left").select(
        "supporter_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "last_marketing_event")
