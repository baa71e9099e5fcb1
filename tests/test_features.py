"""Features, 360 and feed on hand-made Silver."""

import datetime as dt

from frames import MAIL, ORDER, PERSON, TICKET, WEB, raw

from audience_lens.config import EngineConfig
from audience_lens.operators import activity as act
from audience_lens.operators import features as ft
from audience_lens.plans import medallion
from audience_lens.schemas import GOLD_COLUMNS, SCORES_SCHEMA

CFG = EngineConfig()


def silver(spark, web=(WEB,), orders=(ORDER,), tickets=(TICKET,), mail=(MAIL,), people=(PERSON,)):
    return medallion.build_silver({
        "supporters": raw(spark, "supporters", *people), "web_events": raw(spark, "web_events", *web),
        "ecommerce_orders": raw(spark, "ecommerce_orders", *orders),
        "ticket_orders": raw(spark, "ticket_orders", *tickets),
        "marketing_events": raw(spark, "marketing_events", *mail)})


def test_window_has_only_a_lower_bound(spark):
    times = ("2025-08-21 12:00:00", "2025-08-21 11:59:59", "2026-01-01 00:00:00")
    s = silver(spark, web=[WEB | {"event_timestamp": t, "session_id": t} for t in times])
    row = ft.web_features(s.web_events, CFG).first()
    assert (row["website_sessions_30d"], row["product_views_30d"]) == (2, 2)
    assert row["last_web_event"] == dt.datetime(2026, 1, 1)


def test_supporter_without_rows(spark):
    people = (PERSON, PERSON | {"supporter_id": "S9", "first_name": None})
    row = medallion.build_360(silver(spark, people=people), CFG).filter("supporter_id = 'S9'").first()
    assert (row["total_customer_value"], row["matches_attended"], row["last_match_attended"]) == (0.0, 0, None)
    assert (row["days_since_last_purchase"], row["days_since_last_activity"]) == (999, 999)
    assert (row["engagement_score"], row["purchase_intent_score"]) == (0, 0)
    assert row["recommended_next_action"] == "Re-engagement Campaign"
    assert row["recommendation_reason"] is None


def test_one_row_per_supporter_and_exact_value(spark):
    orders = [ORDER | {"order_id": f"O{i}", "revenue": "0.1"} for i in range(30)]
    gold = medallion.build_360(silver(spark, orders=orders, tickets=(TICKET, TICKET | {"attended": None})), CFG)
    (row,) = gold.collect()
    assert gold.columns == list(GOLD_COLUMNS)
    assert (row["total_merchandise_spend"], row["total_ticket_spend"], row["total_customer_value"]) == (
        3.0, 100.0, 103.0)
    assert (row["ticket_purchases"], row["matches_attended"]) == (2, 1)


def test_overlay_prefers_the_model_and_keeps_the_baseline(spark):
    people = (PERSON, PERSON | {"supporter_id": "S2"})
    ml = spark.createDataFrame([("S1", 88, "Hospitality", None, 0.9)], SCORES_SCHEMA)
    rows = {r["supporter_id"]: r for r in medallion.build_360(silver(spark, people=people), CFG, ml).collect()}
    assert (rows["S1"]["purchase_intent_score"], rows["S1"]["recommended_next_action"]) == (88, "Hospitality")
    assert rows["S1"]["recommendation_reason"].startswith("Ada ")
    assert rows["S2"]["recommended_next_action"] == "Re-engagement Campaign"


def test_activity_states(spark):
    mail = [MAIL | {"opened": o, "clicked": c, "converted": v, "campaign": k} for o, c, v, k in
            (("True", "True", "True", "a"), ("True", "True", "False", "b"), ("True", "False", "False", "c"),
             ("False", "False", "False", "d"))]
    tickets = (TICKET, TICKET | {"attended": "False"}, TICKET | {"attended": None, "match": "x"})
    s = silver(spark, mail=mail, tickets=tickets)
    feed = medallion.build_activity(s)
    kinds = {(r["activity_detail"], r["activity_type"]) for r in feed.filter("channel = 'marketing'").collect()}
    assert kinds == {("a", "converted"), ("b", "clicked"), ("c", "opened"), ("d", "sent")}
    seen = sorted(r["activity_type"] for r in feed.filter("channel = 'ticketing'").collect())
    assert seen == ["attended", "ticket_purchase", "ticket_purchase"]


def test_feed_keeps_the_latest_ten_in_order(spark):
    web = [WEB | {"event_timestamp": f"2025-09-{d:02d} 10:00:00"} for d in range(1, 15)]
    feed = act.export_activity(medallion.build_activity(silver(spark, web=web))).first()["activity"]
    times = [x["activity_timestamp"] for x in feed]
    assert len(feed) == 10 and times == sorted(times, reverse=True) and times[0].startswith("2025-09-14")


def test_result_is_independent_of_partitioning(spark):
    web = [WEB | {"supporter_id": f"S{i % 7}", "session_id": str(i)} for i in range(200)]
    orders = [ORDER | {"supporter_id": f"S{i % 7}", "order_id": f"O{i % 90}", "revenue": str(i / 3)}
              for i in range(200)]
    people = [PERSON | {"supporter_id": f"S{i}"} for i in range(7)]

    def run(n):
        s = silver(spark, web=web, orders=orders, people=people)
        spread = {k: df.repartition(n) for k, df in vars(s).items()}
        return sorted(map(str, medallion.build_360(medallion.Silver(**spread), CFG).collect()))

    assert run(1) == run(13)


def test_features_read_only_their_columns(spark, sf_dir):
    from audience_lens.plans.star import Star

    plan = ft.ticket_features(Star(spark, sf_dir).cleaned().ticket_orders)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint" in text
    agg = ft.ecom_features(Star(spark, sf_dir).silver.ecommerce_orders)
    text = agg._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<supporter_id:string,revenue:double,purchase_timestamp:timestamp_ntz>" in text


def test_result_is_independent_of_the_session_zone(spark):
    def run():
        return sorted(map(str, medallion.build_360(silver(spark), CFG).collect()))

    utc = run()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert run() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
