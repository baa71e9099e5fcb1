"""Star-schema tables mapped to the five raw channels.

customer/nation/region -> supporters, events -> click stream and campaigns, lineitem+orders ->
merchandise, orders -> tickets. Deterministic defects (blank ids, bad times, negative
amounts, replays) are added by key arithmetic, so that every quality rule has rows to catch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import lru_cache, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.config import (
    EVENT_PAGES, BaselineThresholds, EngineConfig, OverlayThresholds,
)
from audience_lens.schemas import DEALT

TABLES = ("customer", "nation", "region", "events", "orders", "lineitem")

# Orders end in 2001, events in January 2024: one shift lets both share a reference time.
ORDER_SHIFT_DAYS = 8122

STAR_CONFIG = EngineConfig(
    ref_ts=dt.datetime(2024, 1, 31),
    window_days=7,
    home_country="Nation_0",
    baseline=BaselineThresholds(max_purchases=8, hospitality_attended=5,
                                hospitality_value=4_000_000.0, upgrade_attended=5),
    overlay=OverlayThresholds(max_purchases=8, hospitality_attended=4,
                              hospitality_value=3_500_000.0, upgrade_attended=5),
)

# Product categories and campaign names.
CATEGORIES = ("Home Shirt", "Away Shirt", "Third Kit", "Training Wear", "Accessories", "Retro",
              "Kids", "Hospitality")
CAMPAIGNS = ("Season Ticket Renewal", "New Home Kit Launch", "Membership Drive",
             "Champions League Hospitality", "Black Friday Store", "Matchday Ticket Alert",
             "Stadium Tour Promo", "International Fan Club", "Re-engagement Winback")
SEGMENT_TIER = {"HOUSEHOLD": "None", "FURNITURE": "Free", "BUILDING": "Silver",
                "MACHINERY": "Gold", "AUTOMOBILE": "Red Member"}
PRIORITY_TICKET = {"1-URGENT": "Hospitality", "2-HIGH": "Club Level",
                   "3-MEDIUM": "Family Enclosure", "4-NOT SPECIFIED": "Away End",
                   "5-LOW": "General Admission"}


Tables = Callable[[str], DataFrame]


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """Table name -> frame; each file is opened once."""
    return lru_cache(maxsize=None)(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))


def _mod(key: str, n: int) -> Column:
    return F.col(key) % n


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _map(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _copies(df: DataFrame, **extra: Column) -> DataFrame:
    """Rows plus one extra copy for each flag that holds, tagged in ``_copy``; one scan."""
    nothing = F.array().cast("array<string>")
    tags = [F.when(flag, F.array(F.lit(name))).otherwise(nothing) for name, flag in extra.items()]
    return df.withColumn("_copy", F.explode(F.concat(F.array(F.lit("row")), *tags)))


def _supporter(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def raw_supporters(tables: Tables) -> DataFrame:
    nation, region = tables("nation"), tables("region")
    people = (
        tables("customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    people = _copies(
        people,
        replay=_mod("c_custkey", 89) == 4,
        empty_id=_mod("c_custkey", 422) == 7,
        null_id=_mod("c_custkey", 422) == 218,
    )
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    tier = _map(SEGMENT_TIER, F.col("c_mktsegment"))
    age = reduce(lambda chain, b: chain.when(balance < b[0], b[1]),
                 [(2000, "18-24"), (4000, "25-34"), (6000, "35-44"), (8000, "45-54")],
                 F.when(balance < 0, "")).otherwise("55-64")
    joined_on = F.date_add(F.lit(dt.date(2016, 1, 1)), (key % 2900).cast("int"))
    joined_on = F.when(F.col("_copy") == "replay", F.date_add(joined_on, 1)).otherwise(joined_on)
    return people.select(
        F.when(F.col("_copy") == "empty_id", "")
        .when(F.col("_copy") != "null_id", _supporter("c_custkey")).alias("supporter_id"),
        F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")).alias("first_name"),
        age.alias("age_band"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("city"),
        F.when(key % 307 == 3, "Platinum").when(key % 10 == 0, F.concat(F.lit("  "), tier, F.lit(" ")))
        .otherwise(tier).alias("membership_tier"),
        F.concat(F.lit("Player "), (key % 11 + 1).cast("string")).alias("favourite_player"),
        _pick(CATEGORIES, key % 8).alias("favourite_product_category"),
        F.when(key % 173 == 11, "unknown").otherwise(joined_on.cast("string"))
        .alias("registration_date"),
        F.when(key % 100 < 82, "True").otherwise("False").alias("email_opt_in"),
        F.when(tier.isin("Gold", "Red Member") & (key % 10 < 6), "true").otherwise("FALSE")
        .alias("season_ticket_holder"),
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _event_supporter(empty: Column, null: Column) -> Column:
    return F.when(empty, "").when(~null, _supporter("user_id"))


def raw_web_events(tables: Tables) -> DataFrame:
    events = _copies(tables("events"), replay=_mod("event_id", 101) == 0)
    k, kind = F.col("_k"), F.col("event_type")
    event = (
        F.when(kind == "view", F.when(k % 5 < 2, "viewed_match_ticket")
               .when(k % 5 == 2, "viewed_home_shirt").when(k % 5 == 3, "viewed_away_shirt")
               .otherwise("viewed_stadium_tour"))
        .when(kind == "click", F.when(k % 2 == 0, "viewed_membership").otherwise("added_to_cart"))
        .when(kind == "error", "abandoned_cart")
        .when(kind == "signup", "viewed_hospitality")
        .otherwise(F.when(k == 99, "???invalid").when(k % 2 == 0, "viewed_fixtures")
                   .otherwise("viewed_news"))
    )
    page = _map({e: p for e, (p, _) in EVENT_PAGES.items()}, F.col("_event"))
    name = _map({e: n for e, (_, n) in EVENT_PAGES.items()}, F.col("_event"))
    events = events.withColumn("_k", _k()).withColumn("_event", event)
    return events.select(
        _event_supporter(_mod("event_id", 503) == 3, _mod("event_id", 503) == 5).alias("supporter_id"),
        F.when(_mod("event_id", 509) != 11, F.col("ts")).alias("event_timestamp"),
        F.coalesce(page, F.lit("Unknown")).alias("page_type"),
        F.coalesce(name, F.lit("??")).alias("page_name"),
        F.when(page == "Store", F.concat(F.lit("P"), (F.col("_k") + 1000).cast("string")))
        .otherwise("").alias("product_id"),
        F.when(F.col("_event") == "viewed_match_ticket",
               F.concat(F.lit("M"), F.lpad((F.col("_k") % 12 + 1).cast("string"), 3, "0")))
        .otherwise("").alias("match_id"),
        F.concat(F.lit("SESS"), F.col("user_id").cast("string"), F.lit("-"),
                 F.regexp_replace(F.col("ts").cast("date").cast("string"), "-", "")).alias("session_id"),
        F.concat(F.lit(" "), F.upper("_event")).alias("event_type"),
    )


def raw_marketing_events(tables: Tables) -> DataFrame:
    events = _copies(tables("events"), replay=_mod("event_id", 103) == 0)

    def flag(*kinds: str, also: Column = F.lit(True)) -> Column:
        return F.when(F.col("event_type").isin(*kinds) & also, "True").otherwise("False")

    followed = _k() % 16 == 3  # few campaigns are followed, so active users of both labels exist

    return events.select(
        _event_supporter(_mod("event_id", 509) == 4, F.lit(False)).alias("supporter_id"),
        _pick(CAMPAIGNS, _k() % 9).alias("campaign"),
        F.lit("True").alias("sent"),
        flag("view", "click", "purchase").alias("opened"),
        flag("click", "purchase", also=followed).alias("clicked"),
        flag("purchase", also=followed).alias("converted"),
        F.when(_mod("event_id", 521) != 2, F.col("ts")).alias("timestamp"),
    )


def _shifted(ts: str) -> Column:
    return F.col(ts) + F.expr(f"INTERVAL {ORDER_SHIFT_DAYS} DAYS")


def raw_ecommerce_orders(tables: Tables, dealt: bool = False) -> DataFrame:
    """Line items with the owner of their order; order ids repeat for replayed lines.

    Only narrow numeric columns meet in the join; texts are built after it. A hot order key is
    split by the adaptive skew join. With ``dealt`` rows keep the number of their order, by which
    the join has dealt them: copies of an order id share it, so finding them needs no other shuffle.
    """
    lines = tables("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_shipdate")
    owners = tables("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    # Precisions whose product still fits 18 digits, which Spark computes on plain longs.
    price, discount = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    revenue = (price * (1 - discount)).cast("double")
    part = F.col("l_partkey")
    return lines.join(owners, "l_orderkey").select(
        F.when(_mod("l_orderkey", 701) == 9, "").otherwise(_supporter("o_custkey"))
        .alias("supporter_id"),
        F.when(_mod("l_orderkey", 1511) == 21, "").otherwise(
            F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                     F.col("l_linenumber").cast("string"))).alias("order_id"),
        F.concat(F.lit("Product "), part.cast("string")).alias("product"),
        _pick(CATEGORIES[:-1], part % 7).alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.when((part + F.col("l_linenumber")) % 499 == 5, -revenue)
        .when(part % 997 != 13, revenue).alias("revenue"),
        _shifted("l_shipdate").alias("purchase_timestamp"),
        *([F.col("l_orderkey").alias(DEALT)] if dealt else []),
    )


def raw_ticket_orders(tables: Tables) -> DataFrame:
    orders = _copies(tables("orders"), replay=_mod("o_orderkey", 97) == 0)
    slot = F.col("o_orderkey") % 12
    price = F.col("o_totalprice")
    # Some customers never buy tickets themselves: the one before them holds theirs.
    holder = F.col("o_custkey") - F.when(_mod("o_custkey", 5) == 2, 1).otherwise(0)
    return orders.withColumn("_holder", holder).select(
        F.when(_mod("o_orderkey", 613) == 1, "").otherwise(_supporter("_holder"))
        .alias("supporter_id"),
        F.when(_mod("o_orderkey", 401) == 7, "").otherwise(
            F.concat(F.lit("Match "), (slot + 1).cast("string"))).alias("match"),
        F.when(slot < 9, "Premier League").when(slot < 11, "Champions League")
        .otherwise("Carabao Cup").alias("competition"),
        _map(PRIORITY_TICKET, F.col("o_orderpriority")).alias("ticket_type"),
        F.when(_mod("o_orderkey", 463) == 17, -price)
        .when(_mod("o_orderkey", 1201) != 5, price).alias("ticket_price"),
        _shifted("o_orderdate").alias("purchase_timestamp"),
        F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "False")
        .alias("attended"),
    )


RAW = {
    "supporters": raw_supporters,
    "web_events": raw_web_events,
    "ecommerce_orders": raw_ecommerce_orders,
    "ticket_orders": raw_ticket_orders,
    "marketing_events": raw_marketing_events,
}

#: The same rows; those of sources that a join has dealt say by what.
RAW_DEALT = RAW | {"ecommerce_orders": partial(raw_ecommerce_orders, dealt=True)}
