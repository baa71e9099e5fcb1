"""Rule boundaries, score clamps and rounding."""

import dataclasses
import datetime as dt

import pytest
from frames import features
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.functions import rules, scoring

CFG = EngineConfig()
SHOP = CFG.merchandise
TOUR, TICKET, UPGRADE = "Stadium Tour", "Match Ticket", "Membership Upgrade"
HOSPITALITY, BACK = "Hospitality", "Re-engagement Campaign"

CASES = [
    ({"ticket_views_30d": 2, "ticket_purchases": 0}, TOUR, TICKET),
    ({"ticket_views_30d": 3, "ticket_purchases": 0}, TICKET, TICKET),
    ({"ticket_views_30d": 3}, TOUR, TOUR),
    ({"matches_attended": 4, "total_customer_value": 400.0}, HOSPITALITY, HOSPITALITY),
    ({"matches_attended": 4, "total_customer_value": 399.99}, TOUR, HOSPITALITY),
    ({"matches_attended": 3, "total_customer_value": 350.0}, TOUR, HOSPITALITY),
    ({"matches_attended": 3, "total_customer_value": 349.99}, TOUR, TOUR),
    ({"matches_attended": 3, "membership_tier": "Free"}, UPGRADE, UPGRADE),
    ({"matches_attended": 2, "membership_tier": "None"}, TOUR, UPGRADE),
    ({"product_views_30d": 3}, TOUR, SHOP),
    ({"product_views_30d": 4}, SHOP, SHOP),
    ({"membership_views_30d": 1, "cart_abandons_30d": 1, "membership_tier": "Free"}, SHOP, UPGRADE),
    ({"membership_views_30d": 1, "membership_tier": "Free"}, UPGRADE, UPGRADE),
    ({"days_since_last_activity": 60, "hospitality_views_30d": 1}, BACK, HOSPITALITY),
    ({"hospitality_views_30d": 1}, HOSPITALITY, HOSPITALITY),
    ({"days_since_last_activity": 59}, TOUR, TOUR),
    ({"days_since_last_activity": 60}, BACK, BACK),
    ({}, TOUR, TOUR),
]


def test_next_best_action_boundaries(spark):
    df = features(spark, *[c | {"supporter_id": str(i)} for i, (c, _, _) in enumerate(CASES)])
    got = {int(r[0]): (r[1], r[2]) for r in
           df.select("supporter_id", rules.baseline_nba(CFG), rules.overlay_nba(CFG)).collect()}
    assert [got[i] for i in range(len(CASES))] == [(b, m) for _, b, m in CASES]


@pytest.mark.parametrize("case, text", [
    ({"ticket_views_30d": 3, "ticket_purchases": 0},
     "Ada viewed match tickets 3 times in the last 30 days but has not purchased."),
    ({"matches_attended": 4, "total_customer_value": 419.5},
     "Ada attended 4 matches and has spent £420 - a strong hospitality candidate."),
    ({"cart_abandons_30d": 2}, "Ada browsed merchandise 0 times with 2 abandoned baskets recently."),
    ({"days_since_last_activity": 999}, "Ada has had no meaningful interaction for 999 days."),
    ({"first_name": None}, None),
])
def test_reason(spark, case, text):
    assert features(spark, case).select(rules.baseline_reason(CFG)).first()[0] == text


def test_merchandise_label_follows_the_brand():
    assert dataclasses.replace(CFG, brand="Rovers").merchandise == "Rovers Shirt / Merchandise"


@pytest.mark.parametrize("case, score", [
    ({"days_since_last_activity": 999}, 0),
    ({"website_sessions_30d": 50}, 100),
    ({"product_views_30d": 2}, 2),           # 2.4
    ({"product_views_30d": 2, "days_since_last_activity": 33}, 2),  # 2.4 - 0.9 = 1.5, half up
    ({"website_sessions_30d": 1, "marketing_opens_30d": 1, "matches_attended": 1}, 10),
])
def test_engagement(spark, case, score):
    assert features(spark, case).select(scoring.engagement_score(CFG)).first()[0] == score


def test_never_purchased_is_60_days_for_intent_and_999_for_recency(spark):
    rows = [{"ticket_views_30d": 4, "supporter_id": i, "last_purchase_ts": ts}
            for i, ts in (("never", dt.datetime(2000, 1, 1)), ("today", dt.datetime(2025, 9, 20, 1)),
                          ("yesterday", dt.datetime(2025, 9, 19, 23, 59, 59)))]
    df = features(spark, *rows, last_purchase_ts="timestamp_ntz")
    got = {r[0]: r[1:] for r in df.select(
        "supporter_id", scoring.baseline_intent(CFG), scoring.recency_days("last_purchase_ts", CFG)).collect()}
    assert got == {"never": (6, 999), "today": (24, 0), "yesterday": (24, 1)}


def test_blend_rounds_half_to_even(spark):
    df = features(spark, {"supporter_id": "2.5"}, {"supporter_id": "3.5"})
    p = F.col("supporter_id").cast("double") / 70.0
    scores = [r[0] for r in df.select(scoring.blended_intent(p, CFG)).collect()]
    assert scores == [2, 4]


@pytest.mark.parametrize("score, band", [(None, "0-39 Low"), (39, "0-39 Low"), (40, "40-69 Medium"),
                                         (69, "40-69 Medium"), (70, "70-100 High")])
def test_bands(spark, score, band):
    df = spark.createDataFrame([(score,)], "s int")
    assert df.select(scoring.intent_band("s")).first()[0] == band


def test_lookups_have_fallbacks(spark):
    df = spark.createDataFrame([("Other", "Bronze"), (None, None)], "a string, membership_tier string")
    rows = df.select(rules.opportunity_type(F.col("a"), CFG), *rules.action_meta(F.col("a"), CFG),
                     rules.tier_ordinal()).collect()
    assert tuple(rows[0]) == ("Experience", "Email", "Engagement", "Revenue per supporter", 0)
    assert tuple(rows[1]) == ("Experience", "Email / App Push", "Experience uptake", "Engagement score", 0)
