"""Split, AUC, metrics and models."""

import datetime as dt
import math

import pytest
from frames import MAIL, raw
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.functions.hashing import drawn, with_draws
from audience_lens.operators import intent_ml as ml
from audience_lens.operators import silver

CFG = EngineConfig()


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, f"{ml.LABEL} int, probability double")


def brute_auc(pairs):
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    won = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    return won / (len(pos) * len(neg))


@pytest.mark.parametrize("spread", [3, 50, 100_000])
def test_auc_equals_all_pairs(spark, spread):
    pairs = [(int((i * 7919) % 11 < 3), ((i * 104729) % spread + (i % 11 < 3)) / (spread + 1.0))
             for i in range(400)]
    got = ml.auc(predictions(spark, pairs)).first()["auc"]
    assert math.isclose(got, brute_auc(pairs), rel_tol=1e-12)


def test_auc_when_a_third_share_one_value(spark):
    pairs = [(i % 2, 0.25) for i in range(100)] + [(i % 3 == 0, 0.2 + i / 1e6) for i in range(200)]
    pairs = [(int(y), p) for y, p in pairs]
    assert math.isclose(ml.auc(predictions(spark, pairs)).first()["auc"], brute_auc(pairs), rel_tol=1e-12)


def test_metrics_and_zero_division(spark):
    row = ml.evaluate(predictions(spark, [(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)]), "m").first()
    assert (row["auc"], row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.75, 0.5, 0.5, 0.5, 0.5)
    row = ml.evaluate(predictions(spark, [(1, 0.1), (0, 0.2)]), "m").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 1000])
def test_split_is_exact_per_label_and_stable(spark, rows):
    df = spark.range(rows).select(F.concat(F.lit("S"), "id").alias("supporter_id"),
                                  (F.col("id") % 5 == 0).cast("int").alias(ml.LABEL))
    split = ml.stratified_split(df)
    counts = {r[0]: (r[1], r[2]) for r in split.groupBy(ml.LABEL).agg(
        F.count("*"), F.count_if("is_test")).collect()}
    assert all(t == math.ceil(n * 0.25) for n, t in counts.values())
    assert split.count() == rows
    again = ml.stratified_split(df.repartition(5))
    assert sorted(split.collect()) == sorted(again.collect())


def test_label_window(spark):
    rows = [MAIL | {"supporter_id": s, "clicked": c, "timestamp": t} for s, c, t in (
        ("old", "True", "2025-08-01 00:00:00"), ("new", "True", "2025-09-01 00:00:00"),
        ("sent", "False", "2025-09-01 00:00:00"))]
    mail = silver.clean_marketing_events(raw(spark, "marketing_events", *rows))
    got = {r[0]: r[1] for r in ml.engagement_label(mail, CFG).collect()}
    assert got == {"old": 0, "new": 1, "sent": 0}
    window = (dt.datetime(2025, 7, 31), dt.timedelta(days=10))
    assert {r[0]: r[1] for r in ml.engagement_label(mail, CFG, window).collect()} == {
        "old": 1, "new": 0, "sent": 0}


@pytest.fixture(scope="module")
def frame(spark):
    """Noisy frame: the label depends on two features and chance."""
    u = drawn("y")
    df = with_draws(spark.range(600), "id", 1, {c: 1 for c in ("y", *ml.INPUTS)})
    df = df.withColumns({c: drawn(c) * 10 for c in ml.INPUTS})
    signal = F.col("product_views_30d") + F.col("ticket_views_30d") - 10
    return df.select(F.concat(F.lit("S"), "id").alias("supporter_id"), *ml.INPUTS,
                     (u < 1 / (1 + F.exp(-signal / 2))).cast("int").alias(ml.LABEL)).cache()


def test_models_learn_the_signal(spark, frame):
    split = ml.stratified_split(frame)
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    logreg, trees = ml.train_logreg(train), ml.train_gbt(train, trees=5)
    metrics = [ml.evaluate(ml.score_all(m, test), n) for m, n in ((logreg, "logreg"), (trees, "gbt"))]
    both = metrics[0].unionByName(metrics[1])
    assert all(r["auc"] > 0.6 for r in both.collect())
    best = ml.select_best(both).first()
    assert best["auc"] == max(r["auc"] for r in both.collect())
    for model in (logreg, trees):
        top = [r["feature"] for r in ml.feature_importance(model, frame, 2).collect()]
        assert set(top) == {"product_views_30d", "ticket_views_30d"}


def test_fit_check_notices_an_untrained_model(spark, frame):
    split = ml.stratified_split(frame)
    model = ml.train_logreg(split.filter("NOT is_test"))
    good = ml.fit_check(model, split, "m").first()
    assert (good["slope"], good["beats_constant"], good["in_range"]) == (0.0, True, True)
    assert good["n_train"] + good["n_test"] == 600 and good["n_test"] == split.filter("is_test").count()
    for bad in (ml.train_logreg(split.filter("NOT is_test"), max_iter=0), ml.train_logreg(split.filter("is_test"))):
        row = ml.fit_check(bad, split, "m").first()
        assert row["slope"] > 0


def test_scores_with_repeated_enriched_reasons(spark):
    scores = spark.createDataFrame([("S1", 9, "Hospitality", 0.5), ("S2", 8, "Hospitality", 0.4)],
                                   "supporter_id string, purchase_intent_score int, recommended_next_action string, probability double")
    reasons = spark.createDataFrame([("S1", "b"), ("S1", "a"), ("S3", "c")], "supporter_id string, genai_reason string")
    rows = {r["supporter_id"]: r["genai_reason"] for r in ml.publish_scores(scores, CFG, reasons).collect()}
    assert rows == {"S1": "a", "S2": None}


def test_summary(spark):
    df = spark.createDataFrame([(s,) for s in (0, 10, 20, 30)], "purchase_intent_score int")
    r = ml.score_summary(df).first()
    assert (r["n"], r["mean"], r["std"], r["p25"], r["p50"], r["p75"]) == (4, 15.0, 12.91, 7.5, 15.0, 22.5)


def test_linear_model_wins_a_tie(spark):
    df = spark.createDataFrame([("boosted_trees", 0.9), ("logistic_regression", 0.9), ("x", None)],
                               "model string, auc double")
    assert ml.select_best(df).first()["model"] == "logistic_regression"
