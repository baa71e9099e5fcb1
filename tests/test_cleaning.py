"""Column functions against plain Python on arbitrary text."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from audience_lens.functions import cleaning as cl

TEXT = st.one_of(st.none(), st.text(alphabet=" \tabcXYZ019.-:TtRrUuEe", max_size=12),
                 st.sampled_from(["true", "TRUE", " true", "2025-02-30", "2025-02-28", "1e3", "12", "-0.5", ""]))
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(values=st.lists(TEXT, min_size=1, max_size=60))
def test_text_functions(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.orderBy("i").select(
        cl.blank_to_null("v"), cl.default_if_blank("v", "?"), cl.to_bool("v"), cl.lower_trim("v")).collect()
    for v, row in zip(values, rows):
        stripped = None if v is None else v.strip(" ")
        assert row[0] == (stripped or None)
        assert row[1] == (stripped or "?")
        assert row[2] == (None if v is None else v.lower() == "true")
        assert row[3] == (None if v is None else stripped.lower())


@SETTINGS
@given(values=st.lists(TEXT, min_size=1, max_size=60))
def test_lenient_casts_never_fail(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = df.select(cl.to_timestamp_lenient("v"), cl.to_date_lenient("v"),
                    *[cl.to_number_lenient("v", t) for t in ("int", "double")])
    assert len(out.collect()) == len(values)


def test_impossible_dates_are_null(spark):
    df = spark.createDataFrame([("2025-02-30",), ("2025-02-28",), ("",)], "v string")
    got = [r[0] for r in df.select(cl.to_date_lenient("v").isNull()).collect()]
    assert got == [True, False, True]


def test_typed_columns_need_no_cast(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = events.select(cl.to_timestamp_lenient("ts").alias("t")).filter(F.col("t").isNotNull())
    assert "cast" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
