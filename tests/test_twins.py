"""Every registered query against its SQL twin, values compared exactly."""

import pytest

import __spark_entry__ as entry
from audience_lens.plans.oracle import ORACLE_SQL as TWINS
from audience_lens.plans.registry import QUERIES
from compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_twin():
    assert set(TWINS) == set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, TWINS[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_compare_notices_differences(spark, sf_dir, con):
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    assert compare(df, con, "SELECT * FROM nation") is None
    assert compare(df, con, "SELECT * REPLACE (n_nationkey + 1 AS n_nationkey) FROM nation")
    assert compare(df, con, "SELECT * FROM nation LIMIT 3")
