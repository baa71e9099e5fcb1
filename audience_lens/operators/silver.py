"""Silver: raw rows -> typed, normalised, de-duplicated rows under the drop rules.

Each ``clean_*`` takes a raw frame whose columns may be strings (CSV) or already typed
(parquet); redundant casts are removed by the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audience_lens.functions import cleaning as cl
from audience_lens.operators.expectations import drop_rules, expect_drop
from audience_lens.schemas import DEALT


def dedup_first(df: DataFrame, key: str, order: Sequence[Column | str], dealt: Sequence[str] = ()) -> DataFrame:
    """First row per key in ``order``; the remaining columns break ties.

    The rank filter is applied per map task before the shuffle, so a key that holds a large
    share of the rows reaches the reducer as one row per task. ``dealt`` are columns in which all copies
    of a key agree: a frame that lies dealt by them is not dealt again. Of rows without a key one is left
    for each of their values.
    """
    named = {c for c in order if isinstance(c, str)} | {key, *dealt}
    ties = [c for c in df.columns if c not in named]
    w = Window.partitionBy(*dealt, key).orderBy(*order, *ties)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _keep(df: DataFrame, source: str, dedup: Callable[[DataFrame], DataFrame],
          drop_first: bool) -> DataFrame:
    """Default order is dedup, then drop: a bad earliest copy removes the whole key."""
    rules = drop_rules(source)
    if drop_first:
        return dedup(expect_drop(df, rules))
    return expect_drop(dedup(df), rules)


def type_supporters(raw: DataFrame) -> DataFrame:
    return raw.select(
        cl.blank_to_null("supporter_id").alias("supporter_id"),
        cl.title_case("first_name").alias("first_name"),
        cl.default_if_blank("age_band", "Unknown").alias("age_band"),
        cl.title_case("country").alias("country"),
        cl.title_case("city").alias("city"),
        cl.default_if_blank("membership_tier", "None").alias("membership_tier"),
        F.trim("favourite_player").alias("favourite_player"),
        F.trim("favourite_product_category").alias("favourite_product_category"),
        cl.to_date_lenient("registration_date").alias("registration_date"),
        cl.to_bool("email_opt_in").alias("email_opt_in"),
        cl.to_bool("season_ticket_holder").alias("season_ticket_holder"),
    )


def clean_supporters(raw: DataFrame, drop_first: bool = False) -> DataFrame:
    return _keep(type_supporters(raw), "supporters",
                 lambda df: dedup_first(df, "supporter_id", ["registration_date"]), drop_first)


def type_web_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        cl.blank_to_null("supporter_id").alias("supporter_id"),
        cl.to_timestamp_lenient("event_timestamp").alias("event_timestamp"),
        F.trim("page_type").alias("page_type"),
        F.trim("page_name").alias("page_name"),
        cl.blank_to_null("product_id").alias("product_id"),
        cl.blank_to_null("match_id").alias("match_id"),
        F.trim("session_id").alias("session_id"),
        cl.lower_trim("event_type").alias("event_type"),
    )


def clean_web_events(raw: DataFrame) -> DataFrame:
    return _keep(type_web_events(raw), "web_events", DataFrame.distinct, drop_first=True)


def type_ecommerce_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        cl.blank_to_null("supporter_id").alias("supporter_id"),
        cl.blank_to_null("order_id").alias("order_id"),
        F.trim("product").alias("product"),
        F.trim("category").alias("category"),
        cl.to_number_lenient("quantity", "int").alias("quantity"),
        cl.to_number_lenient("revenue", "double").alias("revenue"),
        cl.to_timestamp_lenient("purchase_timestamp").alias("purchase_timestamp"),
        *[c for c in raw.columns if c == DEALT],
    )


def clean_ecommerce_orders(raw: DataFrame, drop_first: bool = False) -> DataFrame:
    """Raw rows may say by what they lie dealt (``DEALT``): equal for all copies of an order id."""
    typed = type_ecommerce_orders(raw)
    dealt = [c for c in typed.columns if c == DEALT]
    return _keep(typed, "ecommerce_orders",
                 lambda df: dedup_first(df, "order_id", ["purchase_timestamp"], dealt), drop_first).drop(DEALT)


def type_ticket_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        cl.blank_to_null("supporter_id").alias("supporter_id"),
        F.trim("match").alias("match"),
        F.trim("competition").alias("competition"),
        F.trim("ticket_type").alias("ticket_type"),
        cl.to_number_lenient("ticket_price", "double").alias("ticket_price"),
        cl.to_timestamp_lenient("purchase_timestamp").alias("purchase_timestamp"),
        cl.to_bool("attended").alias("attended"),
    )


def clean_ticket_orders(raw: DataFrame) -> DataFrame:
    return _keep(type_ticket_orders(raw), "ticket_orders", DataFrame.distinct, drop_first=True)


def type_marketing_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        cl.blank_to_null("supporter_id").alias("supporter_id"),
        F.trim("campaign").alias("campaign"),
        *[cl.to_bool(c).alias(c) for c in ("sent", "opened", "clicked", "converted")],
        cl.to_timestamp_lenient("timestamp").alias("event_timestamp"),
    )


def clean_marketing_events(raw: DataFrame) -> DataFrame:
    return _keep(type_marketing_events(raw), "marketing_events", DataFrame.distinct, drop_first=True)


TYPERS = {
    "supporters": type_supporters,
    "web_events": type_web_events,
    "ecommerce_orders": type_ecommerce_orders,
    "ticket_orders": type_ticket_orders,
    "marketing_events": type_marketing_events,
}

CLEANERS = {
    "supporters": clean_supporters,
    "web_events": clean_web_events,
    "ecommerce_orders": clean_ecommerce_orders,
    "ticket_orders": clean_ticket_orders,
    "marketing_events": clean_marketing_events,
}

#: Sources whose rows are one record per key; the others by all columns.
KEYS = {"supporters": "supporter_id", "ecommerce_orders": "order_id"}
