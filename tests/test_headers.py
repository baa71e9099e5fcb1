"""CSV files whose headers differ from each other."""

import json

import pytest
from pyspark.sql import functions as F

from audience_lens.schemas import CORRUPT, RAW_COLUMNS, RESCUED
from audience_lens.sources import headers, tables
from audience_lens.streaming.ingest import ingest_stream

MAIL = RAW_COLUMNS["marketing_events"]
EXPECTED = ",".join(MAIL)
LINE = "S1,Drive,True,True,False,False,2025-09-01 10:00:00"
FILES = {
    "as_expected.csv": f"{EXPECTED}\n{LINE}\n\n{EXPECTED}\nS2,B\n{LINE},surplus\n",
    "reordered.csv": "campaign,supporter_id,timestamp,sent,opened,clicked,converted\nDrive,S3,t,a,b,c,d\n",
    "missing.csv": "supporter_id,campaign\nS4,Drive\nS5,Drive,more\nS6\n",
    "extra.csv": f"{EXPECTED},device,\n{LINE},\"a, b\",x\n{LINE},,\n",
    "spelled.csv": "﻿\"Supporter_ID\" , CAMPAIGN ,sent,opened,clicked,converted,\"timestamp\"\r\nS7,Drive,a,b,c,d,e\r\n",
    "twice.csv": "supporter_id,campaign,supporter_id,sent\nS8,Drive,S9,True\n",
    "blank_first.csv": f"\n  \n{EXPECTED}\n{LINE}\n",
    "only_header.csv": "campaign,supporter_id\n",
    "no_header.csv": "S10,Drive,True\nS11,Drive,True\n",
    "empty.csv": "",
}


@pytest.fixture
def landed(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_text(content, newline="")
    return str(tmp_path)


def by_file(bronze):
    out = {}
    for r in bronze.collect():
        out.setdefault(r[headers.FILE].rsplit("/", 1)[-1], []).append(r)
    return out


def values(r):
    return tuple(r[c] for c in MAIL)


def check(bronze):
    got = by_file(bronze)
    full = tuple(LINE.split(","))
    assert {(r["supporter_id"], r[CORRUPT]) for r in got["as_expected.csv"]} == {("S1", f"{LINE},surplus"), ("S1", None), ("S2", "S2,B")}
    assert len(got["as_expected.csv"]) == 3
    assert [values(r) for r in got["reordered.csv"]] == [("S3", "Drive", "a", "b", "c", "d", "t")]
    assert [(r["supporter_id"], r["campaign"], r["sent"], r[CORRUPT]) for r in got["missing.csv"]] == [
        ("S4", "Drive", None, None), ("S5", "Drive", None, "S5,Drive,more"), ("S6", None, None, "S6")]
    assert [r[RESCUED] and json.loads(r[RESCUED]) for r in got["extra.csv"]] == [{"device": "a, b", "": "x"}, None]
    assert all(values(r) == full and r[CORRUPT] is None for r in got["extra.csv"])
    assert [values(r) for r in got["spelled.csv"]] == [("S7", "Drive", "a", "b", "c", "d", "e")]
    assert [(r["supporter_id"], r["sent"], r[RESCUED]) for r in got["twice.csv"]] == [("S8", "True", '{"supporter_id#3":"S9"}')]
    assert [values(r) for r in got["blank_first.csv"]] == [full]
    assert [(values(r), r[CORRUPT]) for r in got["no_header.csv"]] == [((None,) * 7, "S10,Drive,True"), ((None,) * 7, "S11,Drive,True")]
    assert set(got) == set(FILES) - {"only_header.csv", "empty.csv"}


def test_columns_are_matched_by_name(spark, landed):
    check(tables.ingest_batch(spark, landed, "marketing_events"))


def test_stream_matches_alike_and_keeps_the_layouts(spark, landed, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("state"))
    for _ in range(2):
        ingest_stream(spark, landed, "marketing_events", f"{folder}/mark", f"{folder}/bronze", max_files=4)
    check(spark.read.parquet(f"{folder}/bronze"))
    kept = {r[headers.FILE].rsplit("/", 1)[-1]: r["width"] for r in spark.read.parquet(f"{folder}/mark_headers").collect()}
    assert kept == {"reordered.csv": 7, "missing.csv": 2, "extra.csv": 9, "spelled.csv": 7, "twice.csv": 4, "only_header.csv": 2, "no_header.csv": None}


def test_a_file_in_many_splits_has_one_header(spark, tmp_path):
    with open(tmp_path / "big.csv", "w") as out:
        out.write("campaign,supporter_id\n")
        out.writelines(f"C{i},S{i}\n" for i in range(20_000))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        bronze = tables.ingest_batch(spark, str(tmp_path), "marketing_events")
        assert headers.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        assert bronze.agg(F.count("*"), F.count_distinct("supporter_id"), F.count_if(F.col("campaign").startswith("C")), F.count(CORRUPT)).first()[:] == (
            20_000, 20_000, 20_000, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_expected_files_need_no_shuffle(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{EXPECTED}\n{LINE}\n")
    plan = tables.ingest_batch(spark, str(tmp_path), "marketing_events")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_each_line_is_parsed_once_per_width(spark, landed):
    plan = tables.ingest_batch(spark, landed, "marketing_events")._jdf.queryExecution().optimizedPlan().toString()
    widths = {len(MAIL), 2, 9, 4}
    assert plan.count("from_csv(") == len(widths)
