"""Full refresh from landed files: Bronze -> Silver + quarantine -> Gold -> serving tables."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from audience_lens.config import EngineConfig
from audience_lens.operators import expectations as ex
from audience_lens.operators import features as ft
from audience_lens.operators import activity, intent_ml, serving
from audience_lens.operators.silver import CLEANERS, KEYS, TYPERS
from audience_lens.plans import medallion
from audience_lens.schemas import SCORES_SCHEMA, SOURCES
from audience_lens.sources.tables import read_table, write_table
from audience_lens.sources.workspace import in_parallel
from audience_lens.streaming.ingest import ingest_all


def refresh(spark: SparkSession, landing: str, root: str, cfg: EngineConfig,
            scores: DataFrame | None = None, updated_at: Column | None = None, train: bool = False,
            enriched: DataFrame | None = None) -> None:
    """Ingest new files, then rebuild every table below ``root``.

    Each layer is written once and read back by the next, so no layer is computed twice and a lost
    executor costs at most one layer; independent tables are written side by side. With ``train`` the
    overlay comes from ``model_job``; ``scores`` given by the caller take precedence. Warn rules are
    counted while their table is written, and reported in ``quality/warnings``.
    """
    ingest_all(spark, landing, f"{root}/state", f"{root}/bronze")
    warned: dict[str, Observation] = {}

    def watched(df: DataFrame, source: str) -> DataFrame:
        rules = ex.warn_rules(source)
        if not rules:
            return df
        df, warned[source] = ex.expect_warn(df, rules, f"warn_{source}_{uuid.uuid4().hex}")
        return df

    def clean(source: str) -> None:
        bronze = read_table(spark, f"{root}/bronze/{source}")
        write_table(watched(CLEANERS[source](bronze), source), f"{root}/silver/{source}")
        write_table(ex.quarantine(bronze, ex.quarantine_reasons(source)), f"{root}/quarantine/{source}")

    in_parallel(spark, [partial(clean, source) for source in SOURCES])
    silver = silver_tables(spark, root)

    def gold() -> None:
        write_table(medallion.build_scored(silver, cfg), f"{root}/gold/scored")
        scored = read_table(spark, f"{root}/gold/scored")
        overlay = scores
        if overlay is None and train:
            overlay = model_job(spark, root, silver, scored, cfg, enriched)
        if overlay is None:
            overlay = spark.createDataFrame([], SCORES_SCHEMA)
        write_table(watched(ft.overlay_scores(scored, overlay, cfg), "supporter_360"), f"{root}/gold/supporter_360")
        whole = read_table(spark, f"{root}/gold/supporter_360")
        write_table(serving.publish_profile(whole), f"{root}/serving/supporter_profile")
        write_table(serving.publish_nba(whole, cfg, updated_at=updated_at), f"{root}/serving/next_best_action")
        write_table(serving.export_snapshot(serving.serve(whole, cfg)), f"{root}/serving/snapshot", fmt="json")

    def feed() -> None:
        write_table(medallion.build_activity(silver), f"{root}/gold/supporter_activity")
        latest = activity.export_activity(read_table(spark, f"{root}/gold/supporter_activity"))
        write_table(latest, f"{root}/serving/activity_feed", fmt="json")

    in_parallel(spark, [gold, feed, lambda: write_table(report(spark, root), f"{root}/quality/report")])
    rows = [(source, rule, int(n)) for source, seen in sorted(warned.items()) for rule, n in seen.get.items()]
    write_table(spark.createDataFrame(rows, "source string, rule string, failed long").coalesce(1), f"{root}/quality/warnings")


def model_job(spark: SparkSession, root: str, silver: medallion.Silver, scored: DataFrame, cfg: EngineConfig,
              enriched: DataFrame | None = None) -> DataFrame | None:
    """Trains both models on the refreshed layers and writes ``model/metrics`` and ``model/scores``.

    Label and features, exact split, two fits, metrics on the test part, the better model, scores of all
    supporters. The driver sees class counts, model parameters and metric rows. Without both classes in
    the training part there is nothing to learn: no table is written and None comes back.
    """
    labels = intent_ml.engagement_label(silver.marketing_events, cfg)
    write_table(intent_ml.stratified_split(intent_ml.feature_frame(scored, labels)), f"{root}/model/frame")
    frame = read_table(spark, f"{root}/model/frame")
    training = frame.filter("NOT is_test")
    if len(intent_ml.class_counts(training)) < 2:
        return None
    names = {"logistic_regression": intent_ml.train_logreg, "boosted_trees": intent_ml.train_gbt}
    models = dict(zip(names, in_parallel(spark, [partial(fit, training) for fit in names.values()])))
    metrics = [intent_ml.evaluate(intent_ml.score_all(m, frame.filter("is_test")), n) for n, m in models.items()]
    write_table(metrics[0].unionByName(metrics[1]).coalesce(1), f"{root}/model/metrics")
    best = intent_ml.select_best(read_table(spark, f"{root}/model/metrics")).first()["model"]
    scores = intent_ml.intent_scores(scored, intent_ml.score_all(models[best], frame), cfg)
    write_table(intent_ml.publish_scores(scores, cfg, enriched), f"{root}/model/scores")
    return read_table(spark, f"{root}/model/scores")


def silver_tables(spark: SparkSession, root: str) -> medallion.Silver:
    return medallion.Silver(**{s: read_table(spark, f"{root}/silver/{s}") for s in SOURCES})


def report(spark: SparkSession, root: str) -> DataFrame:
    """Quality report over the written layers."""
    return ex.quality_report({
        s: (read_table(spark, f"{root}/bronze/{s}"), read_table(spark, f"{root}/silver/{s}"))
        for s in SOURCES}, TYPERS, KEYS)
