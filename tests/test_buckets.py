"""History in buckets: the same rows as one whole rewrite, and only touched buckets are written."""

import glob
import os
from datetime import datetime as T

import pytest

from tidekeep.operators.runs import upsert_run_history
from tidekeep.sinks import buckets


def plain(df):
    return sorted((tuple(r) for r in df.select("host", "run_id", "ts", "status").collect()), key=repr)


@pytest.fixture()
def history(spark):
    rows = [(f"h{i % 5}", f"r{i // 2}", T(2026, 1, 1 + i % 7, i % 24), "success") for i in range(400)]
    rows += [("hot", "r0", T(2026, 1, 1 + i % 28, i % 24), "success") for i in range(200)] + [(None, "r1", None, "failed")]
    return spark.createDataFrame(rows, "host string, run_id string, ts timestamp, status string")


def test_updates_equal_a_whole_rewrite(spark, history, tmp_path):
    root, want = str(tmp_path / "history"), history
    buckets.write_buckets(history, root, buckets=16)
    assert plain(buckets.read_buckets(spark, root)) == plain(history)
    for number in range(3):
        changes = spark.createDataFrame([("hot", "r0", f"new{number}"), (f"h{number}", f"r{5 * number}", "partial"), ("no", "run", "x"),
                                         (None, "r1", "x")], "host string, run_id string, status string")
        buckets.update_buckets(changes, root)
        want = spark.createDataFrame(upsert_run_history(want, changes).collect(), history.schema)
        assert plain(buckets.read_buckets(spark, root)) == plain(want)
    assert sum(r["status"] == "new2" for r in want.collect()) > 0


def test_only_touched_buckets_are_written(spark, history, tmp_path):
    root = str(tmp_path / "history")
    buckets.write_buckets(history, root, buckets=16)
    before = {r["bucket"]: r["path"] for r in buckets.manifest(spark, root).collect()}
    folders = set(os.listdir(f"{root}/data"))
    touched = buckets.update_buckets(spark.createDataFrame([("h1", "r3", "partial")], "host string, run_id string, status string"), root)
    after = {r["bucket"]: r["path"] for r in buckets.manifest(spark, root).collect()}
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)
    (new,) = set(os.listdir(f"{root}/data")) - folders
    assert [os.path.basename(p) for p in glob.glob(f"{root}/data/{new}/_bucket=*")] == [f"_bucket={touched[0]}"]
    stored = {r["bucket"]: r["rows"] for r in buckets.manifest(spark, root).collect()}
    assert sum(stored.values()) == history.count()


def test_failed_update_leaves_the_version_before(spark, history, tmp_path, monkeypatch):
    root = str(tmp_path / "history")
    buckets.write_buckets(history, root, buckets=4)
    changes = spark.createDataFrame([("hot", "r0", "x")], "host string, run_id string, status string")
    with monkeypatch.context() as patch:
        patch.setattr(buckets, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            buckets.update_buckets(changes, root)
    assert plain(buckets.read_buckets(spark, root)) == plain(history)
    buckets.update_buckets(changes, root)
    assert plain(buckets.read_buckets(spark, root)) == plain(upsert_run_history(history, changes))


def test_nothing_to_do(spark, history, tmp_path):
    root = str(tmp_path / "history")
    none = spark.createDataFrame([], "host string, run_id string, status string")
    assert buckets.update_buckets(none, root) == []
    with pytest.raises(ValueError):
        buckets.read_buckets(spark, root)
    buckets.write_buckets(history, root, buckets=4)
    assert buckets.update_buckets(none, root) == []
    assert buckets.manifest(spark, root).first()["version"] == 1


def test_stream_of_changes(spark, history, tmp_path):
    root, arriving = str(tmp_path / "history"), str(tmp_path / "in")
    buckets.write_buckets(history, root, buckets=8)
    first = spark.createDataFrame([("hot", "r0", 1, "a"), ("hot", "r0", 2, "b")], "host string, run_id string, seq int, status string")
    first.coalesce(1).write.parquet(f"{arriving}/part=0")
    stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", True).parquet(arriving)
    wanted = spark.createDataFrame([("hot", "r0", "b")], "host string, run_id string, status string")
    for _ in range(2):
        changes = stream.select("host", "run_id", "status")
        buckets.update_stream(changes, root, str(tmp_path / "checkpoint")).awaitTermination()
        assert plain(buckets.read_buckets(spark, root)) == plain(upsert_run_history(history, wanted))
