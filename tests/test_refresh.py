"""Generator -> CSV landing -> incremental ingest -> all layers."""

import pytest
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.operators import expectations as ex
from audience_lens.plans import refresh as rf
from audience_lens.schemas import CORRUPT, SOURCES
from audience_lens.sources import generator, tables
from audience_lens.streaming.ingest import ingest_all

CFG = EngineConfig()
SIZES = {"supporters": 400, "web": 1600, "orders": 640, "tickets": 400, "marketing": 800}


def land(frames, folder, mode="append"):
    for source, df in frames.items():
        df.write.mode(mode).option("header", "true").csv(f"{folder}/{source}")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lake")
    landing, root = str(folder / "landing"), str(folder / "root")
    land(generator.generate(spark, CFG, **SIZES), landing)
    rf.refresh(spark, landing, root, CFG)
    return landing, root


def table(spark, root, name):
    return tables.read_table(spark, f"{root}/{name}")


def test_quality_counts_match_the_injected_defects(spark, built):
    _, root = built
    got = {r["source"]: (r["ingested"], r["passed"], r["rejected"], r["duplicates"])
           for r in rf.report(spark, root).collect()}
    assert got["supporters"] == (402, 400, 2, 0)
    assert got["ecommerce_orders"] == (674, 640, 4, 30)
    assert got["ticket_orders"] == (402, 400, 2, 0)
    assert got["marketing_events"] == (802, 800, 2, 0)
    assert got["web_events"] == (1605, 1601, 4, 0)
    rejected = sum(table(spark, root, f"quarantine/{s}").count() for s in SOURCES)
    assert rejected == 14
    warned = ex.warn_counts(table(spark, root, "silver/web_events"), ex.warn_rules("web_events")).first()
    assert warned["failed"] == 1


def test_dirty_rows_are_repaired(spark, built):
    people = table(spark, built[1], "silver/supporters")
    assert people.filter("age_band = 'Unknown'").count() == 10
    warned = {r["rule"]: r["failed"] for r in ex.warn_counts(people, ex.warn_rules("supporters")).collect()}
    assert warned == {"valid_membership_tier": 0, "sensible_registration_date": 0}
    assert people.filter(F.col("country") == F.upper("country")).count() == 0


def test_gold_properties(spark, built):
    root = built[1]
    gold = table(spark, root, "gold/supporter_360")
    check = ex.uniqueness_check(gold, "supporter_id").first()
    assert check["is_unique"] and check["n_rows"] == 400
    assert gold.filter("purchase_intent_score NOT BETWEEN 0 AND 100 "
                       "OR engagement_score NOT BETWEEN 0 AND 100").count() == 0
    silver_rows = sum(table(spark, root, f"silver/{s}").count() for s in SOURCES[1:])
    assert table(spark, root, "gold/supporter_activity").count() == silver_rows
    assert table(spark, root, "serving/next_best_action").count() == 400
    assert len(table(spark, root, "serving/supporter_profile").columns) == 23


def test_ingest_reads_each_file_once(spark, built):
    landing, root = built
    before = table(spark, root, "bronze/web_events").count()
    ingest_all(spark, landing, f"{root}/state", f"{root}/bronze")
    assert table(spark, root, "bronze/web_events").count() == before
    new = generator.gen_web_events(spark.range(5001, 5011).withColumnRenamed("id", "n"), 400, CFG)
    land({"web_events": new}, landing)
    ingest_all(spark, landing, f"{root}/state", f"{root}/bronze")
    bronze = table(spark, root, "bronze/web_events")
    assert bronze.count() == before + 10
    assert bronze.filter("_source_file IS NULL OR _ingested_at IS NULL").count() == 0


def test_model_job_overlays_gold(spark, tmp_path):
    """From landed CSV to an overlay: scores, metrics, warnings, snapshot, feed and report are written."""
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    land(generator.generate(spark, CFG, **SIZES), landing)
    rf.refresh(spark, landing, root, CFG, train=True)
    scores, gold = table(spark, root, "model/scores"), table(spark, root, "gold/supporter_360")
    assert scores.count() == gold.count() == 400
    both = gold.select("supporter_id", F.col("purchase_intent_score").alias("g")).join(scores, "supporter_id")
    assert both.filter("g != purchase_intent_score").count() == 0
    metrics = {r["model"]: r["auc"] for r in table(spark, root, "model/metrics").collect()}
    assert set(metrics) == {"logistic_regression", "boosted_trees"} and all(0 < a <= 1 for a in metrics.values())
    warned = {(r["source"], r["rule"]): r["failed"] for r in table(spark, root, "quality/warnings").collect()}
    assert warned[("web_events", "known_event_type")] == 1 and warned[("supporter_360", "one_row_per_supporter")] == 0
    assert table(spark, root, "quality/report").count() == len(SOURCES)
    for name in ("snapshot", "activity_feed"):
        assert tables.read_table(spark, f"{root}/serving/{name}", "json").count() == 400
    again = table(spark, root, "gold/scored")
    rf.refresh(spark, landing, root, CFG)
    assert again.count() == 400  # a reader of the version before is not disturbed


def test_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 4, 5):
        tables.write_table(spark.range(n), path)
    assert len(tables.versions(spark, path)) == tables.KEPT
    with pytest.raises(Exception):
        tables.write_table(spark.range(9).select(F.raise_error(F.lit("stop")).alias("id")), path)
    assert tables.read_table(spark, path).count() == 5
    plain = str(tmp_path / "plain")
    spark.range(2).write.parquet(plain)
    assert tables.read_table(spark, plain).count() == 2


def test_malformed_lines_are_rescued(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "supporter_id,campaign,sent,opened,clicked,converted,timestamp\n"
        "S1,A,True,True,False,False,2025-09-01 10:00:00\nS2,B,True,True,False,False,x,surplus\nS3,C\n")
    bronze = tables.ingest_batch(spark, str(tmp_path), "marketing_events")
    assert bronze.count() == 3
    kept = {r[CORRUPT] for r in tables.rescue_malformed(bronze).collect()}
    assert kept == {"S2,B,True,True,False,False,x,surplus", "S3,C"}


def test_generator_is_deterministic_and_shaped(spark):
    rows = spark.range(1, 4001).withColumnRenamed("id", "n")
    people = generator.gen_supporters(rows, CFG, with_persona=True)
    share = {r["persona"]: r["count"] / 4000 for r in people.groupBy("persona").count().collect()}
    assert all(abs(share[p] - w) < 0.03 for p, w in generator.PERSONAS)
    uk = people.filter("country = 'United Kingdom'").count() / 4000
    assert abs(uk - 0.55) < 0.03
    assert sorted(people.collect()) == sorted(
        generator.gen_supporters(rows.repartition(7), CFG, with_persona=True).collect())
    assert generator.gen_supporters(rows, CFG, seed=8).exceptAll(people.drop("persona")).count() > 3900
    mail = generator.gen_marketing_events(rows, 400, CFG)
    assert mail.filter("converted = 'True' AND clicked = 'False'").count() == 0
    assert mail.filter("clicked = 'True' AND opened = 'False'").count() == 0


def test_supporter_ids_are_never_cut(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "n bigint")
    assert [r[0] for r in df.select(generator.supporter_id(F.col("n"))).collect()] == ["S000007", "S1234567"]
