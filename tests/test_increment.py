"""Refresh by what is new against a rebuild from all files; layers in partitions below one manifest."""

import datetime as dt
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.operators import activity, by_supporter, serving
from audience_lens.operators import day_states as ds
from audience_lens.operators import expectations as ex
from audience_lens.plans import increment, medallion
from audience_lens.schemas import RAW_COLUMNS, SOURCES
from audience_lens.sources import commits, generator
from audience_lens.plans.star import LANDING, MARK, Star
from audience_lens.sources.lake import KEPT, Lake, Run
from frames import MAIL, ORDER, PERSON, TICKET, WEB, raw

CFG = EngineConfig()
MIDNIGHT = EngineConfig(ref_ts=dt.datetime(2025, 9, 20))
SIZES = {"supporters": 50, "web": 240, "orders": 100, "tickets": 60, "marketing": 120}


def at():
    return F.lit("2025-09-20 12:00:00").cast("timestamp_ntz")


def land(frames, folder):
    for source, df in frames.items():
        df.coalesce(1).write.mode("append").option("header", "true").csv(f"{folder}/{source}")


def bronze(spark, root):
    return {s: spark.read.parquet(f"{root}/bronze/{s}") for s in SOURCES}


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    assert sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


def check_equals_rebuild(spark, root, cfg):
    now, rows = Lake(spark, f"{root}/lake").snapshot(), bronze(spark, root)
    built = medallion.build_silver(rows)
    for source in SOURCES:
        same(getattr(increment.silver(now), source), getattr(built, source))
        rejected = ex.quarantine(rows[source].withColumn("batch_id", F.col("batch_id").cast("string")), ex.quarantine_reasons(source))
        same(now.table(f"quarantine.{source}"), rejected)
    gold = medallion.build_360(built, cfg)
    same(now.table("gold.supporter_360"), gold)
    same(by_supporter.served(now), serving.load_serving(serving.publish_profile(gold), serving.publish_nba(gold, cfg, updated_at=at())))
    same(by_supporter.read(now, by_supporter.FEED), activity.export_activity(medallion.build_activity(built)))


def test_landings_in_any_order_equal_a_rebuild(spark, tmp_path, monkeypatch):
    cfg = CFG
    monkeypatch.setattr(generator, "HISTORY_DAYS", 45)
    frames = generator.generate(spark, cfg, **SIZES)
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    mark = {s: F.pmod(F.xxhash64(*RAW_COLUMNS[s]), F.lit(3)) for s in SOURCES}
    for thirds in ((2,), (0,), (1, 0)):  # the last landing brings copies of the one before, too
        for third in thirds:
            land({s: df.filter(mark[s] == third) for s, df in frames.items()}, landing)
        number = increment.advance(spark, landing, root, cfg, at(), buckets=4)
    assert number == 3
    check_equals_rebuild(spark, root, cfg)


def rows(spark, source, base, *changes):
    return raw(spark, source, *[base | c for c in changes])


@pytest.fixture
def small(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    land({"supporters": rows(spark, "supporters", PERSON, {}, {"supporter_id": "S2"}),
          "web_events": rows(spark, "web_events", WEB, {}, {"event_timestamp": "2025-09-11 10:00:00"}, {"event_timestamp": "2025-08-21 11:00:00"},
                             {"event_timestamp": "2025-08-21 12:00:00", "session_id": "SESS1"}),
          "ecommerce_orders": rows(spark, "ecommerce_orders", ORDER, {}, {"order_id": "O2"}, {"order_id": "O3", "purchase_timestamp": None}),
          "ticket_orders": rows(spark, "ticket_orders", TICKET, {}, {"purchase_timestamp": None}),
          "marketing_events": rows(spark, "marketing_events", MAIL, {})}, landing)
    increment.advance(spark, landing, root, CFG, at(), buckets=4)
    return landing, root


def test_late_copies_displace_and_move_orders(spark, small):
    landing, root = small
    check_equals_rebuild(spark, root, CFG)
    late = [{"purchase_timestamp": "2025-08-30 10:00:00", "revenue": "7"}, {"order_id": "O2", "purchase_timestamp": "2025-08-30 10:00:00", "revenue": "-1"},
            {"order_id": "O3", "revenue": "3"}, {"order_id": "O4", "purchase_timestamp": "2025-09-02 10:00:00"}, {"order_id": ""}]
    land({"ecommerce_orders": rows(spark, "ecommerce_orders", ORDER, *late)}, landing)
    increment.advance(spark, landing, root, CFG, at())
    check_equals_rebuild(spark, root, CFG)
    now = Lake(spark, f"{root}/lake").snapshot()
    got = sorted((r["order_id"], r["revenue"], r["day"]) for r in now.table("silver.ecommerce_orders").collect())
    assert got == [("O1", 7.0, "2025-08"), ("O3", 10.0, "undated"), ("O4", 10.0, "2025-09")]


def parts_read(df):
    return {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}


def test_one_new_file_rewrites_and_reads_its_days_only(spark, small):
    landing, root = small
    lake = Lake(spark, f"{root}/lake")
    before = lake.snapshot()
    land({"web_events": rows(spark, "web_events", WEB, {"event_timestamp": "2025-09-11 23:00:00", "session_id": "SESS2"})}, landing)
    increment.advance(spark, landing, root, CFG, at())
    after = lake.snapshot()
    for name in ("silver.web_events", "state.web_days", "state.web_sessions"):
        old, new = before.tables[name]["parts"], after.tables[name]["parts"]
        assert {p for p in new if old.get(p) != new[p]} == {"2025-09-11"} and len(old) == 3
    for name in ("silver.ecommerce_orders", "first.supporters", "state.ticket_days", "quarantine.supporters"):
        assert before.tables[name] == after.tables[name]
    recent = after.table("state.web_days").filter("day >= '2025-09-01'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pruned = plan.split("PartitionFilters: [", 1)[1].split("], PushedFilters", 1)[0]
    assert ">= 2025-09-01" in pruned and "Filter" not in plan.split("FileScan", 1)[0]  # nothing is left to filter by row
    check_equals_rebuild(spark, root, CFG)


def test_boundary_day_is_cut_at_the_hour(spark, small):
    _, root = small
    first = Lake(spark, f"{root}/lake").snapshot().table("gold.supporter_360").filter("supporter_id = 'S1'").first()
    assert first["product_views_30d"] == 3 and first["website_sessions_30d"] == 1  # 11:00 of the first day is too early


def test_a_stopped_run_leaves_nothing_to_read_or_keep(spark, small, monkeypatch):
    landing, root = small
    lake = Lake(spark, f"{root}/lake")
    before = sorted(map(str, by_supporter.served(lake.snapshot()).collect()))
    land({"web_events": rows(spark, "web_events", WEB, {"session_id": "SESS9"}), "supporters": rows(spark, "supporters", PERSON, {"supporter_id": "S3"})}, landing)

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as m:  # the process ends after all tables have been written
        m.setattr(commits, "create_once", stop)
        with pytest.raises(Stopped):
            increment.advance(spark, landing, root, CFG, at())
    assert lake.snapshot().number == 1 and sorted(map(str, by_supporter.served(lake.snapshot()).collect())) == before
    increment.advance(spark, landing, root, CFG, at())
    check_equals_rebuild(spark, root, CFG)
    tables = lake.snapshot().tables
    assert increment.advance(spark, landing, root, CFG, at()) == 3 and lake.snapshot().tables == tables  # nothing new
    named = set()
    for number in range(2, 4):
        for name, entry in lake.snapshot(number).tables.items():
            named |= {(name, w) for w in entry["parts"].values()}
    found = {tuple(p.split(os.sep)[-2:]) for p in glob.glob(f"{root}/lake/data/*/write=*")}
    assert {(n, w.partition("=")[2]) for n, w in found} == named
    assert len(commits.names(spark, f"{root}/lake/runs")) == KEPT


def test_readers_see_one_run_and_writers_do_not_overlap(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))

    def make(n):
        run = lake.begin()
        for name in ("a", "b"):
            run.rewrite(name, spark.range(3).withColumn("run", F.lit(n)))
        return run

    make(1).commit({})
    held = lake.snapshot()
    second, rival = make(2), lake.begin()
    assert {r["run"] for r in lake.snapshot().table("a").collect()} == {1}  # written, but not shown
    assert {r["run"] for r in second.table("b").collect()} == {2}
    second.commit({"x": 1})
    rival.replace("a", spark.createDataFrame([("v", 1)], "day string, n int"), "day", [])
    with pytest.raises(RuntimeError, match="another writer"):
        rival.commit({})
    now = lake.snapshot()
    assert now.marks == {"x": 1} and {r["run"] for t in "ab" for r in now.table(t).collect()} == {2}
    assert {r["run"] for t in "ab" for r in held.table(t).collect()} == {1}  # a reader of the run before is not disturbed


def test_partitions_are_replaced_emptied_and_added(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))

    def put(touched, *cells):
        run = lake.begin()
        run.replace("t", spark.createDataFrame(list(cells), "day string, n int"), "day", touched)
        run.commit({})
        return sorted((r["day"], r["n"]) for r in lake.snapshot().table("t").collect())

    assert put([]) == []
    assert put(["a"], ("a", 1), ("b", 2), ("undated", 3)) == [("a", 1), ("b", 2), ("undated", 3)]
    assert put(["b", "zz"], ("c", 4)) == [("a", 1), ("c", 4), ("undated", 3)]
    assert len(glob.glob(str(tmp_path / "lake/data/t/write=*/day=*"))) == 4  # two runs are kept
    assert put(["a", "c", "undated"]) == []
    assert put([], ("e", 5)) == [("e", 5)] and len(glob.glob(str(tmp_path / "lake/data/t/write=*/day=*"))) == 1


def test_nothing_landed_for_a_source(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    for source in SOURCES:
        os.makedirs(f"{landing}/{source}")
    assert increment.advance(spark, landing, root, CFG) == 1
    land({"supporters": rows(spark, "supporters", PERSON, {})}, landing)
    with pytest.raises(ValueError, match="web_events"):
        increment.advance(spark, landing, root, CFG)


def test_states_merge_to_the_features(spark):
    from audience_lens.operators import features as ft

    web = ds.with_day(medallion.build_silver({"web_events": rows(spark, "web_events", WEB, *[
        {"event_timestamp": f"2025-{m:02d}-{d:02d} {h:02d}:30:00", "session_id": f"SESS{(d + h) % 4}", "event_type": e}
        for m in (8, 9) for d in (20, 21, 22) for h in (3, 11, 12) for e in ("viewed_membership", "abandoned_cart")]),
        **{s: rows(spark, s, {}) for s in SOURCES if s != "web_events"}}).web_events, "web_events")
    for cfg in (CFG, MIDNIGHT, EngineConfig(window_days=0)):
        same(ds.web_features(ds.web_days(web), ds.web_sessions(web), web, cfg), ft.web_features(web.drop("day"), cfg))


def test_new_and_old_copies_are_found_in_one_pass(spark, tmp_path, monkeypatch):
    staged, root = [], str(tmp_path)
    real = Run.staged
    monkeypatch.setattr(Run, "staged", lambda run, df: staged.append(df.columns) or real(run, df))
    rest = {"web_events": [WEB], "ticket_orders": [TICKET], "marketing_events": [MAIL]}
    for revenue, ts in (("10", "2025-09-01 10:00:00"), ("7", "2025-08-01 10:00:00")):
        rows = {"supporters": [PERSON], "ecommerce_orders": [ORDER | {"revenue": revenue, "purchase_timestamp": ts}] * 2, **rest}
        land({source: raw(spark, source, *own) for source, own in rows.items()}, f"{root}/landing")
        staged.clear()
        increment.advance(spark, f"{root}/landing", root, CFG, at(), 4)
        assert sum(c == increment._FRESH for columns in staged for c in columns) == 2  # one for each keyed source
    check_equals_rebuild(spark, root, CFG)


def test_landings_take_marked_rows_that_are_written_once(spark, sf_dir):
    star = Star(spark, sf_dir)
    for source in SOURCES:
        rows = star.raw(source)
        text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns], F.xxhash64(*rows.columns).alias(MARK))
        same(star.marked(source), text)
        assert star.marked(source).inputFiles() == star.marked(source).inputFiles() != rows.inputFiles()


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_a_run_keeps_no_shuffle_files_and_no_staged_rows(spark, small, monkeypatch):
    landing, root = small
    staged = []
    real = commits.create_once
    monkeypatch.setattr(commits, "create_once", lambda *a: staged.append(commits.names(spark, f"{root}/lake/data/staged")) or real(*a))
    land({"web_events": rows(spark, "web_events", WEB, {"session_id": "SESS7"}, {"session_id": "SESS7"}),
          "ecommerce_orders": rows(spark, "ecommerce_orders", ORDER, {"order_id": "O7"}, {"order_id": "O7"})}, landing)
    before = shuffle_files(spark)
    increment.advance(spark, landing, root, CFG, at())
    assert [[n for n in names if "=" in n] for names in staged] == [[]]
    for _ in range(50):  # files go in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    check_equals_rebuild(spark, root, CFG)


def test_landed_files_go_when_bronze_has_their_rows(spark, small):
    landing, root = small
    held = {f for f in glob.glob(f"{landing}/*/part-*")}
    assert {f.split(os.sep)[-2] for f in held} == set(SOURCES)  # kept unless asked otherwise
    land({"web_events": rows(spark, "web_events", WEB, {"session_id": "SESS8"}), "ecommerce_orders": rows(spark, "ecommerce_orders", ORDER, {"order_id": "O8"})}, landing)
    increment.advance(spark, landing, root, CFG, at(), keep_landed=False)
    assert set(glob.glob(f"{landing}/*/part-*")) == held  # the new ones have gone, those of the run before are another's
    assert increment.advance(spark, landing, root, CFG, at(), keep_landed=False) == 3
    land({"web_events": rows(spark, "web_events", WEB, {"session_id": "SESS9"})}, landing)
    increment.advance(spark, landing, root, CFG, at())
    assert len(glob.glob(f"{landing}/*/part-*")) == len(held) + 1
    check_equals_rebuild(spark, root, CFG)


def test_periods_keep_the_orders_of_buckets_that_nothing_has_come_to(spark, small):
    landing, root = small
    more = [{"order_id": f"P{i}"} for i in range(12)]
    land({"ecommerce_orders": rows(spark, "ecommerce_orders", ORDER, *more)}, landing)
    increment.advance(spark, landing, root, CFG, at())
    for late in ({"purchase_timestamp": "2025-08-30 10:00:00"}, {"purchase_timestamp": "2025-08-29 10:00:00", "revenue": "-1"}):
        land({"ecommerce_orders": rows(spark, "ecommerce_orders", ORDER, {"order_id": "P3"} | late)}, landing)
        increment.advance(spark, landing, root, CFG, at())
        check_equals_rebuild(spark, root, CFG)
    assert Lake(spark, f"{root}/lake").snapshot().table("silver.ecommerce_orders").filter("order_id LIKE 'P%'").count() == 11


def test_extracts_hold_both_landings_in_packed_files(spark, sf_dir, tmp_path, monkeypatch):
    star, landing, folder = Star(spark, sf_dir), str(tmp_path / "landing"), str(tmp_path / "extracts")
    mark = F.pmod(MARK, F.lit(10))

    def read(source):
        names = RAW_COLUMNS[source]
        return spark.read.schema(", ".join(f"{c} string" for c in names)).option("header", "true").csv(f"{landing}/{source}")

    def as_landed(frame, source):
        path = str(tmp_path / "plain" / source)
        frame.drop(MARK).write.mode("overwrite").option("header", "true").csv(path)
        return spark.read.schema(read(source).schema).option("header", "true").csv(path)

    for source in ("ecommerce_orders", "supporters"):
        marked = star.marked(source)
        star._extract(folder, source)
        star._land(folder, landing, 0, source)
        same(read(source), as_landed(marked.filter(mark < 5), source))
        star._land(folder, landing, 1, source)
        same(read(source), as_landed(marked.unionByName(marked.filter(mark == 3)), source))
        assert all(f.endswith(".gz") for f in read(source).inputFiles())
        assert not [n for i in (0, 1) for n in commits.names(spark, f"{folder}/{source}/{LANDING}={i}")]
    nobody = raw(spark, "web_events").withColumn(MARK, F.lit(0).cast("long"))
    monkeypatch.setattr(Star, "_marked", lambda *_: nobody)
    star._extract(folder, "web_events")
    star._land(folder, landing, 0, "web_events")
    assert len(read("web_events").inputFiles()) == 1 and read("web_events").count() == 0  # a header alone
    assert [r[0] for r in spark.read.text(f"{landing}/web_events").collect()] == [",".join(RAW_COLUMNS["web_events"])]


def test_the_lake_holds_its_rows_once(spark, sf_dir):
    star = Star(spark, sf_dir)
    now = star.lake()
    root = now.root.removesuffix("/lake")
    assert not [f for d in ("landing", "extracts") for f in glob.glob(f"{root}/{d}/**/*.csv*", recursive=True)]
    files = now.table("silver.ecommerce_orders").inputFiles() + spark.read.parquet(f"{root}/bronze/ecommerce_orders").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
