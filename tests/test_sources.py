"""Owners of files, stored statistics, keys, and times of log lines that continue others."""

import os
from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from tidekeep.operators import profile
from tidekeep.plans import jobs
from tidekeep.sources.ownership import read_entries
from tidekeep.sources.statistics import declare_key, declared_key, discover_keys, table_statistics
from tidekeep.sources.tables import TableSource, scan_tables


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "a" / "b" / "c" / "d").mkdir(parents=True)
    for name, mode in (("a/one", 0o640), ("a/b/two", 0o600), ("a/b/c/three", 0o644), ("z", 0o000)):
        (root / name).write_text("x" * len(name))
        os.chmod(root / name, mode)
    os.symlink(root / "a", root / "link")
    return str(root)


def test_entries_of_folders(spark, tree):
    for per_task in (1, 256):
        got = {r.rel_path: r for r in read_entries(spark, [("h", tree)], per_task=per_task).collect()}
        assert set(got) == {None, "a", "a/one", "a/b", "a/b/two", "a/b/c", "link", "z"}  # down to two separators
        assert got["a/one"].mode == 0o640 and got["a/one"].size == 5 and got["a/one"].gid == os.stat(tree).st_gid
        assert got["z"].mode == 0 and not got["z"].is_dir and not got["link"].is_dir and got[None].is_dir
    assert read_entries(spark, [("h", tree)], depth=0).count() == 4
    assert read_entries(spark, []).count() == 0


def test_folder_health(spark, tree, tmp_path):
    (tmp_path / "empty").mkdir()
    roots = [("h1", tree), ("h1", str(tmp_path / "empty")), ("h2", tree + "/a/one"), ("h2", str(tmp_path / "gone"))]
    entries, owner = read_entries(spark, roots), os.geteuid()
    fine = {(r.host, r.check.split("/")[-1]): (r.status, r.message) for r in jobs.folder_health(entries, owner).collect()}
    assert {k: v[0] for k, v in fine.items()} == {
        ("h1", "root"): "ok", ("h1", "empty"): "ok", ("h2", "one"): "error", ("h2", "gone"): "error"}
    assert fine["h2", "one"][1].endswith("is not a directory") and "missing or unreadable" in fine["h2", "gone"][1]
    drift = {r.check.split("/")[-1]: r for r in jobs.folder_health(entries, owner + 1).collect()}["root"]
    group = os.stat(tree).st_gid
    assert drift.status == "warn" and drift.message.count("uid=") == 6  # five entries and the expected owner
    assert f"a/b/two(uid={owner} gid={group} mode=0600)" in drift.message
    assert f"a/one(uid={owner} gid={group} mode=0640)" in drift.message
    first = drift.message.split(": ", 1)[1].split(", ")
    assert [text.split("(")[0] for text in first] == ["a", "a/b", "a/b/c", "a/b/two", "a/one"]


def test_mode_without_permissions(spark):
    rows = spark.createDataFrame([("h", "/r", "x", 5, 6, 0)], "host string, root string, rel_path string, uid int, gid int, mode int")
    assert "x(uid=5 gid=6 mode=0)" in jobs.drift_checks(rows).first().message
    assert "x(uid=5)" in jobs.drift_checks(rows.drop("gid", "mode")).first().message


def test_statistics_of_a_folder(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "src+1" / "many.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "src+1" / "none.parquet"))
    source = TableSource(folder=str(tmp_path / "src+1"))
    stats = lambda: {r.table_name: r.table_rows for r in table_statistics(spark, source, ["many", "none"]).collect()}
    assert stats() == {"many": 100, "none": 0}
    (tmp_path / "src+1" / "many.parquet" / "part-broken.parquet").write_bytes(b"PAR1 no footer")
    assert stats() == {"many": 100, "none": 0}
    assert table_statistics(spark, source, []).count() == 0
    plan = table_statistics(spark, source, ["many"])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]  # paths only


def test_statistics_of_a_catalogue(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS stats_db")
    try:
        spark.range(7).write.mode("overwrite").saveAsTable("stats_db.counted")
        spark.range(7).write.mode("overwrite").saveAsTable("stats_db.unknown")
        spark.sql("ANALYZE TABLE stats_db.counted COMPUTE STATISTICS")
        found = table_statistics(spark, TableSource(database="stats_db"), ["counted", "unknown"])
        assert {r.table_name: r.table_rows for r in found.collect()} == {"counted": 7, "unknown": None}
    finally:
        spark.sql("DROP DATABASE stats_db CASCADE")


def test_keys_are_kept_with_the_tables(spark, tmp_path):
    table = spark.createDataFrame([(2, "b", 1), (1, "a", 2)], "k int, v string, j int")
    declare_key(table, ["j", "k"]).write.parquet(str(tmp_path / "t.parquet"))
    table.write.parquet(str(tmp_path / "u.parquet"))
    source = TableSource(folder=str(tmp_path))
    tables = scan_tables(spark, source, ["t", "u"])
    assert declared_key(tables["t"]) == ["j", "k"] and discover_keys(spark, source, tables) == {"t": ["j", "k"]}
    run = jobs.snapshot_tables(spark, {"main": source}, str(tmp_path / "out"), str(tmp_path / "hist"), "h", datetime(2026, 1, 2))
    recorded = run.first().results[0]
    expected = profile.table_sample_hash(table, ["j", "k"], 50).first().sample_hash
    assert recorded.sample_row_hashes == {"t": expected} and recorded.row_count_mode == "exact"


def test_counts_that_fail_are_estimated(spark, tmp_path, monkeypatch):
    spark.range(5).write.parquet(str(tmp_path / "src" / "t.parquet"))

    def stopped(*_):
        raise PySparkException("statement timeout")
    monkeypatch.setattr(profile, "table_row_counts", stopped)
    run = jobs.snapshot_tables(spark, {"main": TableSource(folder=str(tmp_path / "src"))}, str(tmp_path / "out"),
                               str(tmp_path / "hist"), "h", datetime(2026, 1, 2))
    recorded = run.first().results[0]
    assert (recorded.status, recorded.row_counts, recorded.row_count_mode) == ("success", 5, "estimate")
    assert recorded.table_row_counts is None
