"""Lookups of single supporters read little."""

import pytest
from pyspark.sql import functions as F

from audience_lens.operators import by_supporter
from audience_lens.sources.lake import Lake

N = 200_000


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    run = lake.begin()
    rows = spark.range(N).select(F.concat(F.lit("S"), "id").alias("supporter_id"), F.md5(F.col("id").cast("string")).alias("first_name"))
    by_supporter.publish(run, by_supporter.PROFILE, rows, 4, **{"parquet.block.size": "65536", "parquet.page.size": "8192"})
    run.commit({})
    return lake.snapshot()


def scanned(df):
    """(files, rows) that the scan of an executed plan has read."""
    plan = df._jdf.queryExecution().executedPlan()
    metrics = plan.collectLeaves().apply(0).metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def test_ten_ids_read_few_row_groups(published):
    ids = [f"S{i * 19987}" for i in range(10)]
    found = by_supporter.lookup(published, by_supporter.PROFILE, [*ids, ids[0], "nobody"])
    assert sorted(r["supporter_id"] for r in found.collect()) == sorted(ids)
    assert scanned(found)[1] < N / 4


def test_one_id_reads_one_bucket_and_nobody_nothing(published):
    one = by_supporter.lookup(published, by_supporter.PROFILE, ["S4242"])
    assert len(one.collect()) == 1
    files, rows = scanned(one)
    assert files <= 2 and rows < N / 20
    nobody = by_supporter.lookup(published, by_supporter.PROFILE, ["S4242x"])  # between two ids: only the Bloom filter knows
    assert nobody.collect() == [] and scanned(nobody)[1] == 0
    assert by_supporter.lookup(published, by_supporter.PROFILE, []).count() == 0
    with pytest.raises(ValueError, match="join"):
        by_supporter.lookup(published, by_supporter.PROFILE, ids=[str(i) for i in range(by_supporter.MOST_IDS + 1)])
