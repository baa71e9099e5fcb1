"""The search index finds what a scan finds, and reads less."""

import pytest
from pyspark.sql import functions as F

from audience_lens.operators import analytics, search_index
from audience_lens.sources.lake import Lake

NAMES = ["Ada", "Adam", "adalina", "Al", "B", "", None, "Éva", "Anna-Lena", "ana na", "\U0001F600x", "100%", "a_b", "ADA", "Ann"]


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    rows = [(f"S{i:04d}", NAMES[i % len(NAMES)], None if i % 11 == 0 else (i * 37) % 101) for i in range(400)]
    served = spark.createDataFrame(rows, "supporter_id string, first_name string, purchase_intent_score int").withColumns({
        "membership_tier": F.lit("Free"), "country": F.lit("x"), "recommended_action": F.lit("y")})
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    run = lake.begin()
    run.rewrite("profiles", served)
    search_index.publish(run, run.table("profiles"))
    run.commit({})
    return lake.snapshot()


def parts():
    out = {"", " ", "zzz", "adax", "S00000", "\x02", "ada\x03", "%", "_"}
    for text in ("S0123", "Adalina", "Anna-Lena", "Éva", "\U0001F600x", "100%"):
        out |= {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    return sorted(out)


def test_every_part_is_found_as_by_a_scan(published):
    served = published.table("profiles").persist()
    for part in parts()[::6] + ["S0123", "ada", "l", "S", " ANNA", "éva"]:
        want = analytics.search(served, part).collect()
        assert search_index.search(published, served, part).collect() == want, part
    served.unpersist()


def test_a_search_reads_one_bucket(spark, published):
    found = search_index.candidates(published, "adalina")
    assert 0 < found.count() < 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram," in plan
    assert search_index.candidates(published, "nowhere").count() == 0
    n = published.table(search_index.POSTINGS).count()
    assert published.table(search_index.GRAMS).agg(F.sum("n")).first()[0] == n
