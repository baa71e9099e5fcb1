"""Injected defects and their exact outcome."""

import datetime as dt

from frames import MAIL, ORDER, PERSON, TICKET, WEB, raw
from pyspark.sql import functions as F

from audience_lens.operators import expectations as ex
from audience_lens.operators import silver
from audience_lens.plans.star import Star
from audience_lens.schemas import DEALT
from audience_lens.sources import adapters
from audience_lens.sources.workspace import hot_keys_split


def reasons(spark, source, *rows):
    df = raw(spark, source, *rows)
    return [r["_reject_reason"] for r in ex.quarantine(df, ex.quarantine_reasons(source)).collect()]


def test_supporter_defects(spark):
    df = raw(spark, "supporters", PERSON, PERSON | {"supporter_id": ""}, PERSON | {"supporter_id": None},
             PERSON | {"supporter_id": "S2", "country": "UNITED KINGDOM"},
             PERSON | {"supporter_id": " S3 ", "membership_tier": "  Gold "},
             PERSON | {"supporter_id": "S4", "age_band": "", "membership_tier": " ",
                       "registration_date": "soon", "email_opt_in": None})
    rows = {r["supporter_id"]: r for r in silver.clean_supporters(df).collect()}
    assert set(rows) == {"S1", "S2", "S3", "S4"}
    assert rows["S2"]["country"] == "United Kingdom"
    assert rows["S1"]["first_name"] == "Ada"
    assert rows["S3"]["membership_tier"] == "Gold"
    assert (rows["S4"]["age_band"], rows["S4"]["membership_tier"]) == ("Unknown", "None")
    assert rows["S4"]["registration_date"] is None and rows["S4"]["email_opt_in"] is None
    assert reasons(spark, "supporters", PERSON, PERSON | {"supporter_id": ""},
                   PERSON | {"supporter_id": None}) == ["missing_supporter_id"] * 2


def test_earliest_registration_wins(spark):
    df = raw(spark, "supporters", PERSON | {"registration_date": "2021-01-01", "city": "Leeds"}, PERSON)
    (row,) = silver.clean_supporters(df).collect()
    assert row["registration_date"] == dt.date(2020, 1, 1) and row["city"] == "London"


def test_tab_is_not_trimmed(spark):
    (row,) = silver.clean_supporters(raw(spark, "supporters", PERSON | {"supporter_id": "\t"})).collect()
    assert row["supporter_id"] == "\t"


def test_web_defects(spark):
    rows = [WEB, WEB, WEB | {"supporter_id": ""}, WEB | {"supporter_id": None},
            WEB | {"event_timestamp": ""}, WEB | {"event_timestamp": "not-a-timestamp"},
            WEB | {"event_type": " ???INVALID "}]
    kept = silver.clean_web_events(raw(spark, "web_events", *rows))
    assert sorted(r["event_type"] for r in kept.collect()) == ["???invalid", "added_to_cart"]
    assert reasons(spark, "web_events", *rows) == [
        "missing_supporter_id", "missing_supporter_id", "invalid_event_timestamp", "invalid_event_timestamp"]
    (warned,) = ex.warn_counts(kept, ex.warn_rules("web_events")).collect()
    assert (warned["rule"], warned["checked"], warned["failed"]) == ("known_event_type", 2, 1)


def test_order_defects(spark):
    rows = [ORDER, ORDER, ORDER | {"order_id": ""}, ORDER | {"order_id": None}, ORDER | {"order_id": None},
            ORDER | {"order_id": "O2", "supporter_id": ""}, ORDER | {"order_id": "O3", "revenue": "-25.0"},
            ORDER | {"order_id": "O4", "revenue": "-5.0"}, ORDER | {"order_id": "O5", "revenue": None},
            ORDER | {"order_id": "O6", "revenue": "0"}]
    kept = silver.clean_ecommerce_orders(raw(spark, "ecommerce_orders", *rows))
    assert sorted(r["order_id"] for r in kept.collect()) == ["O1", "O6"]
    assert reasons(spark, "ecommerce_orders", *rows) == (
        ["missing_order_id"] * 3 + ["missing_supporter_id"] + ["negative_revenue"] * 2 + ["null_revenue"])


def test_bad_earliest_copy(spark):
    """Dedup runs before the drop rules; the other order keeps the valid later copy."""
    df = raw(spark, "ecommerce_orders", ORDER | {"revenue": "-1"},
             ORDER | {"purchase_timestamp": "2025-09-02 10:00:00"})
    assert silver.clean_ecommerce_orders(df).count() == 0
    (row,) = silver.clean_ecommerce_orders(df, drop_first=True).collect()
    assert row["revenue"] == 10.0


def test_ticket_defects(spark):
    rows = [TICKET, TICKET, TICKET | {"supporter_id": ""}, TICKET | {"ticket_price": "-120.0"},
            TICKET | {"ticket_price": "free"}, TICKET | {"match": "", "attended": "no"}]
    kept = silver.clean_ticket_orders(raw(spark, "ticket_orders", *rows))
    assert sorted(r["attended"] for r in kept.collect()) == [False, True]
    assert reasons(spark, "ticket_orders", *rows) == ["missing_supporter_id", "negative_price", "null_price"]
    (warned,) = ex.warn_counts(kept, ex.warn_rules("ticket_orders")).collect()
    assert warned["failed"] == 1


def test_marketing_defects(spark):
    rows = [MAIL, MAIL | {"supporter_id": ""}, MAIL | {"timestamp": ""}]
    assert silver.clean_marketing_events(raw(spark, "marketing_events", *rows)).count() == 1
    assert reasons(spark, "marketing_events", *rows) == ["missing_supporter_id", "invalid_timestamp"]


def test_report_adds_up_with_independent_duplicates(spark):
    rows = [ORDER, ORDER, ORDER | {"order_id": "O2"}, ORDER | {"order_id": ""},
            ORDER | {"order_id": "O3", "revenue": "-1"}]
    bronze = raw(spark, "ecommerce_orders", *rows)
    clean = silver.clean_ecommerce_orders(bronze, drop_first=True)
    (r,) = ex.quality_report({"ecommerce_orders": (bronze, clean)}, silver.TYPERS, silver.KEYS).collect()
    valid = silver.type_ecommerce_orders(bronze).filter("order_id IS NOT NULL AND revenue >= 0")
    independent = valid.count() - valid.select("order_id").distinct().count()
    assert (r["ingested"], r["passed"], r["rejected"], r["duplicates"]) == (5, 2, 2, independent)
    assert r["pass_rate"] == 60.0 and r["lost"] == 0


def test_report_tells_lost_orders_from_duplicates(spark):
    rows = [ORDER | {"revenue": "-1", "purchase_timestamp": "2024-01-01 00:00:00"},
            ORDER | {"purchase_timestamp": "2024-01-02 00:00:00"}, ORDER | {"order_id": "O2"}, ORDER | {"order_id": "O2"}]
    bronze = raw(spark, "ecommerce_orders", *rows)
    (r,) = ex.quality_report({"ecommerce_orders": (bronze, silver.clean_ecommerce_orders(bronze))},
                             silver.TYPERS, silver.KEYS).collect()
    assert (r["ingested"], r["passed"], r["rejected"], r["duplicates"], r["lost"]) == (4, 1, 1, 1, 1)


def test_observed_warnings_cost_no_extra_scan(spark):
    df = silver.type_ticket_orders(raw(spark, "ticket_orders", TICKET, TICKET | {"match": ""}))
    kept, seen = ex.expect_warn(df, ex.warn_rules("ticket_orders"), "tickets")
    assert kept.count() == 2
    assert seen.get == {"match_populated": 1}


def test_hot_key_is_pruned_before_the_shuffle(spark):
    """A third of the rows under one order id: each task passes on one row of it."""
    plan = silver.clean_ecommerce_orders(raw(spark, "ecommerce_orders", ORDER))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_orders_dealt_by_the_join_are_not_dealt_again(spark, sf_dir):
    star = Star(spark, sf_dir)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = silver.clean_ecommerce_orders(adapters.RAW_DEALT["ecommerce_orders"](star.table))
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        plain = silver.clean_ecommerce_orders(star.raw("ecommerce_orders"))
        assert plan.count("Exchange hashpartitioning") == 2  # the two sides of the join
        assert dealt.columns == plain.columns
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_dealt_copies_and_orders_without_an_id(spark):
    rows = [ORDER, ORDER | {"purchase_timestamp": "2025-08-01 10:00:00"}, ORDER | {"order_id": " "}, ORDER | {"order_id": None},
            ORDER | {"order_id": "O2", "revenue": "-1", "purchase_timestamp": "2025-08-01 10:00:00"}, ORDER | {"order_id": "O2"}]
    plain = raw(spark, "ecommerce_orders", *rows)
    for drop_first in (False, True):
        got = silver.clean_ecommerce_orders(plain.withColumn(DEALT, F.substring("order_id", 2, 1)), drop_first)
        want = silver.clean_ecommerce_orders(plain, drop_first)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.count() == (2 if drop_first else 1)


def test_a_hot_order_is_split_although_copies_are_found_where_the_join_leaves_them(spark, sf_dir):
    star = Star(spark, sf_dir)
    hot = F.when(F.col("l_orderkey") % 3 == 0, 4).otherwise(F.col("l_orderkey")).cast("long").alias("l_orderkey")

    def table(name):
        rows = star.table(name)
        if name != "lineitem":
            return rows
        return rows.select(hot, *[c for c in rows.columns if c != "l_orderkey"]).repartition(8)

    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {name: spark.conf.get(name, None) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        with hot_keys_split(spark):
            dealt = silver.clean_ecommerce_orders(adapters.RAW_DEALT["ecommerce_orders"](table))
            got = sorted(map(str, dealt.collect()))
        assert "skew=true" in dealt._jdf.queryExecution().executedPlan().toString()
        assert got == sorted(map(str, silver.clean_ecommerce_orders(adapters.raw_ecommerce_orders(table)).collect()))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
