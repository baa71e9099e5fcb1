"""Written layers follow the input files and the session's folder."""

from types import SimpleNamespace

import pytest

from audience_lens.sources import workspace as ws


def test_version_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    before = ws.input_version(spark, [path])
    assert before == ws.input_version(spark, [path])
    spark.range(4).write.mode("append").parquet(path)
    assert before != ws.input_version(spark, [path])


def test_layer_is_written_once_per_version(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for version in ("a", "a", "b"):
        assert ws.materialize(spark, "test_layer", version, build).count() == 5
    assert len(calls) == 2


def _session(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder),
                           sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_folder_comes_from_the_session():
    assert ws.workspace(_session("s3://shared/", "yarn")) == "s3://shared/audience_lens/app"


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError):
        ws.workspace(_session(None, "yarn"))
    assert ws.workspace(_session(None, "local[2]")).endswith("/audience_lens/app")


def test_parallel_jobs_keep_order_and_raise(spark):
    assert ws.in_parallel(spark, [lambda n=n: spark.range(n).count() for n in (3, 1, 2)]) == [3, 1, 2]
    with pytest.raises(ZeroDivisionError):
        ws.in_parallel(spark, [lambda: 1, lambda: 1 / 0])
