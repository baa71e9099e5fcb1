"""KPIs, rankings and the business case on hand-made served rows."""

import dataclasses

import pytest

from audience_lens.config import BusinessAssumptions, EngineConfig
from audience_lens.operators import analytics as an
from audience_lens.operators import briefs, serving
from audience_lens.plans import medallion

CFG = EngineConfig()
SCHEMA = ("supporter_id string, first_name string, membership_tier string, country string, "
          "total_customer_value double, total_merchandise_spend double, matches_attended bigint, "
          "ticket_views_30d bigint, product_views_30d bigint, cart_abandons_30d bigint, "
          "membership_views_30d bigint, marketing_opens_30d bigint, days_since_last_activity bigint, "
          "engagement_score bigint, purchase_intent_score bigint, intent_score bigint, "
          "recommended_action string, recommendation_reason string, opportunity_type string")


def served(spark, *rows):
    base = {"first_name": "Ada", "membership_tier": "Gold", "country": "United Kingdom",
            "total_customer_value": 0.0, "total_merchandise_spend": 0.0, "matches_attended": 0,
            "ticket_views_30d": 0, "product_views_30d": 0, "cart_abandons_30d": 0, "membership_views_30d": 0,
            "marketing_opens_30d": 0, "days_since_last_activity": 0, "engagement_score": 0,
            "purchase_intent_score": 0, "intent_score": 0, "recommended_action": "Stadium Tour",
            "recommendation_reason": "because", "opportunity_type": "Experience"}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame(
        [tuple((base | {"supporter_id": f"S{i}"} | r).get(n) for n in names) for i, r in enumerate(rows)],
        SCHEMA)


def test_published_business_case(spark):
    totals = spark.createDataFrame([(5000, 2748, 687878.56)],
                                   "supporters bigint, actionable_supporters bigint, addressable double")
    r = an.business_case_from(totals, BusinessAssumptions()).first()
    assert (r["scaled_addressable_value"], r["incremental_converted_value"]) == (34_393_928, 687_879)
    assert r["incremental_gross_contribution"] == 412_727
    assert (r["roi_x"], r["roi_pct"], r["payback_months"]) == (2.44, 244, 3.5)


def test_business_case_without_contribution(spark):
    r = an.business_case(served(spark, {}), BusinessAssumptions()).first()
    assert r["payback_months"] is None and r["roi_x"] == -1.0
    free = dataclasses.replace(BusinessAssumptions(), annual_platform_cost=0.0)
    assert an.business_case(served(spark, {}), free).first()["roi_x"] == 0.0


def test_empty_table(spark):
    empty = served(spark, {}).limit(0)
    assert an.overview_kpis(empty).first()["revenue"] == 0
    assert [r["supporters"] for r in an.intent_distribution(empty).collect()] == [0, 0, 0]
    assert len(an.opportunities(empty).collect()) == 6
    assert an.business_case(empty, CFG.business).first()["scaled_addressable_value"] == 0


def test_trend_counts_today_in_week_one(spark):
    df = served(spark, {"days_since_last_activity": 0, "engagement_score": 10},
                {"days_since_last_activity": 7, "engagement_score": 3},
                {"days_since_last_activity": 13, "engagement_score": 4},
                {"days_since_last_activity": 56, "engagement_score": 99})
    trend = {r["label"]: r["score"] for r in an.engagement_trend(df).collect()}
    assert trend == {"-1w": 10, "-2w": 4, **{f"-{w}w": 0 for w in range(3, 9)}}  # 3.5 -> 4, half even
    compat = {r["label"]: r["score"] for r in an.engagement_trend(df, compat=True).collect()}
    assert compat["-1w"] == 0


def test_rank_keeps_ties_and_top_does_not(spark):
    df = served(spark, *[{"purchase_intent_score": s} for s in (90, 80, 80, 80, 70)])
    assert [r["intent_rank"] for r in an.rank_intent(df, 2).orderBy("intent_rank").collect()] == [1, 2, 2, 2]
    assert [r["supporter_id"] for r in an.top_intent(df, 2).collect()] == ["S0", "S1"]


def test_search_is_case_insensitive(spark):
    df = served(spark, {"first_name": "Adele"}, {"first_name": None}, {"first_name": "Bea"})
    assert [r["supporter_id"] for r in an.search(df, " AD ").collect()] == ["S0"]
    assert [r["supporter_id"] for r in an.search(df, "s1").collect()] == ["S1"]
    assert an.search(df, "", 2).count() == 2


def test_null_country_is_international(spark):
    df = served(spark, {"country": None}, {}, {"country": "Norway"})
    assert {r["supporter_id"] for r in an.international_merch(df, CFG).collect()} == {"S0", "S2"}


def test_opportunity_members_of_one_type(spark):
    df = served(spark, *[{"purchase_intent_score": i, "opportunity_type": t}
                         for i, t in enumerate(["Experience", "Re-engagement", "Experience", None])])
    got = [r["supporter_id"] for r in an.opportunity_members(df, 2, "Experience").collect()]
    assert got == ["S3", "S2"]
    assert an.opportunity_members(df, 2).count() == 3


@pytest.mark.parametrize("reply, objective, author", [
    ('{"objective": "Go", "primary_kpi": "K"}', "Go", "GenAI"),
    ('```json\n{"objective": "Go"}\n```', "Go", "GenAI"),
    ('```\n{"objective": "Go"}\n``` trailing', "Go", "GenAI"),
    ("{}", "", "GenAI"),
    ('{"objective": "x"} thanks!', None, "template (LLM unavailable)"),
    ('{"objective": "x"} {"objective": "y"}', None, "template (LLM unavailable)"),
    ('{"objective": "x"}, {"objective": "y"}', None, "template (LLM unavailable)"),
    ('{"objective": "x"},"w":{"objective": "y"}', None, "template (LLM unavailable)"),
    ('{"objective": "x"}] [{"objective": "y"}', None, "template (LLM unavailable)"),
    ('{"objective": "x"}} {"v":{"objective": "y"}', None, "template (LLM unavailable)"),
    ("null", None, "template (LLM unavailable)"),
    ('{"objective": "cut', None, "template (LLM unavailable)"),
    ("Sorry.", None, "template (LLM unavailable)"),
    ('["objective"]', None, "template (LLM unavailable)"),
    (None, None, "template (LLM unavailable)"),
])
def test_parse_brief(spark, reply, objective, author):
    facts = briefs.brief_facts(served(spark, {"recommended_action": "Hospitality"}))
    df = facts.crossJoin(spark.createDataFrame([(reply,)], "reply string"))
    r = briefs.parse_brief(df, "reply", CFG).first()
    template = "Convert Ada's current intent into a hospitality outcome."
    assert (r["objective"], r["generated_by"]) == (template if objective is None else objective, author)
    assert r["supporting_kpi"] == "Hospitality revenue"


def test_facts_keep_nulls_in_json(spark):
    facts = briefs.brief_facts(served(spark, {"first_name": None, "matches_attended": None}))
    doc = briefs.facts_json(facts).first()["facts"]
    assert '"first_name":null' in doc and '"matches_attended":0' in doc


def test_log_is_idempotent_and_evolves(spark, tmp_path):
    approvals = briefs.template_brief(briefs.brief_facts(served(spark, {}, {})), CFG).selectExpr(
        "supporter_id", "recommended_action AS next_best_action", "objective AS campaign_objective",
        "recommended_channel", "suggested_message AS campaign_message", "'me' AS approved_by_user")
    from pyspark.sql import functions as F
    at = F.lit("2025-09-20 12:00:00").cast("timestamp_ntz")
    path = str(tmp_path / "log")
    for _ in range(2):
        serving.append_activations(path, approvals, "one", at)
    log = serving.read_activations(spark, path)
    assert log.count() == 2 and log.select("activation_id").distinct().count() == 2 and {r["status"] for r in log.collect()} == {"queued"}
    serving.append_activations(path, approvals, "two", at + F.expr("INTERVAL 1 HOUR"))
    newest = serving.recent_activations(serving.read_activations(spark, path), 2).collect()
    assert {r["approved_at"].hour for r in newest} == {13}
    old = log.drop("approved_at", "campaign_message")
    wide = serving.evolve_log_schema(old, {"approved_at": "timestamp_ntz", "campaign_message": "string"})
    assert set(wide.columns) == set(log.columns)


def test_batches_are_written_once(spark, tmp_path):
    schema = ", ".join(f"{c} string" for c in serving.APPROVAL_COLUMNS)
    one, other = (spark.createDataFrame([(f"S{i}", "Hospitality", None, "Email", m, "me") for i in range(9)], schema) for m in ("m", "n"))
    path = str(tmp_path / "log")

    def kept():
        return sorted((r["batch_id"], r["supporter_id"], r["campaign_message"]) for r in serving.read_activations(spark, path).collect())

    assert serving.append_activations(path, one, "b1") and not serving.append_activations(path, one.repartition(3), "b1")
    before = kept()
    times = {r["approved_at"] for r in serving.read_activations(spark, path).collect()}
    for changed in (other, one.limit(8), one.unionByName(one.limit(1)), one.unionByName(other)):
        with pytest.raises(ValueError, match="other approvals"):
            serving.append_activations(path, changed, "b1")
    assert kept() == before and {r["approved_at"] for r in serving.read_activations(spark, path).collect()} == times
    assert len(list((tmp_path / "log/rows/batch_id=b1").glob("writing=*"))) == 1

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    create, serving.commits.create_once = serving.commits.create_once, stop  # the process ends before the manifest
    try:
        with pytest.raises(Stopped):
            serving.append_activations(path, other, "b2")
    finally:
        serving.commits.create_once = create
    assert kept() == before and len(list((tmp_path / "log/rows/batch_id=b2").glob("writing=*"))) == 1
    assert serving.append_activations(path, other, "b2")
    assert len(kept()) == 18 and len(list((tmp_path / "log/rows/batch_id=b2").glob("writing=*"))) == 1
    assert serving.append_activations(path, one.limit(0), "none") and len(kept()) == 18


def test_two_channels_are_two_approvals(spark, tmp_path):
    from pyspark.sql import functions as F
    rows = [("S1", "Hospitality", None, "Email", "m", "me"), ("S1", "Hospitality", None, "App Push", "m2", "me"),
            ("S1", None, "Hospitality", "Email", "m", "me"), ("S1", "Hospitality", None, "Email", None, "me")]
    approvals = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in serving.APPROVAL_COLUMNS))
    path, at = str(tmp_path / "log"), F.lit("2025-09-20 12:00:00.25").cast("timestamp_ntz")
    for _ in range(2):
        serving.append_activations(path, approvals, "b", at)
    ids = [r["activation_id"] for r in serving.read_activations(spark, path).collect()]
    assert len(ids) == len(set(ids)) == 4
    with pytest.raises(ValueError):
        serving.append_activations(path, approvals, "../b", at)


def test_merge_keeps_the_reason_when_the_new_one_is_null(spark):
    from test_features import silver

    gold = medallion.build_360(silver(spark), CFG)
    scores = spark.createDataFrame([("S1", 7, "Hospitality", None)],
                                   "supporter_id string, purchase_intent_score int, "
                                   "recommended_next_action string, genai_reason string")
    before, after = gold.first(), serving.merge_scores(gold, scores).first()
    assert after["purchase_intent_score"] == 7 and after["recommended_next_action"] == "Hospitality"
    assert after["recommendation_reason"] == before["recommendation_reason"]
