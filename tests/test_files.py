"""Sources, sinks and jobs on files."""

import gzip
import hashlib
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from tidekeep import schemas
from tidekeep.operators import digest_tree, runs as run_ops, verify
from tidekeep.plans import jobs
from tidekeep.sinks import files as sinks
from tidekeep.sources import files as sources
from tidekeep.sources.artifacts import _Payload, artifact_digests, file_sha256, list_folders, listed_artifacts
from tidekeep.sources.tables import TableSource, discover_tables, scan_tables

OLD = ('{"timestamp":"2026-05-27T10:00:00Z","run_id":"old","status":"failed","duration":"1s","databases_total":1,'
       '"databases_succeeded":0,"databases_failed":1}\n')
NEW = ('{"timestamp":"2026-05-28T10:00:00Z","run_id":"new","status":"success","run_folder":"/tmp/run",'
       '"log_file":"/tmp/run.log","duration":"2s","databases_total":2,"databases_succeeded":2,"databases_failed":0,'
       '"logical_upload_status":"success","adaptive_xbcloud_parallel":2,"hostname":"h","extra":1,'
       '"validation_checked_at":"0001-01-01T00:00:00Z","results":[{"name":"a","status":"success","size_bytes":7}]}\n')
PAYLOAD = b"CREATE TABLE test (id int);\n-- Dump completed\n"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_run_history(spark, tmp_path):
    path = tmp_path / "backup-runs.jsonl"
    assert sources.read_run_history(spark, str(path)).count() == 0
    path.write_text(OLD + NEW + "{broken\n")
    history = sources.read_run_history(spark, str(path)).cache()
    assert history.where("_corrupt_record IS NOT NULL").count() == 1
    good = run_ops.run_view(history.where("run_id IS NOT NULL"))
    view = {r["run_id"]: r for r in good.collect()}
    assert view["new"]["final_outcome"] == "" and view["old"]["final_outcome"] == "1 of 1 database backups failed"
    assert view["new"]["adaptive_xbcloud_parallel"] == 2 and view["old"]["adaptive_xbcloud_parallel"] == 0
    assert view["new"]["validation_checked_at"] is None and view["new"]["results"][0]["size_bytes"] == 7
    assert view["new"]["results"][0]["row_counts"] == 0
    latest = run_ops.latest_run(history.where("run_id IS NOT NULL").fillna("h", ["host"]).select("host", "ts", "run_id"))
    assert rows(latest.select("run_id")) == [("new",)]
    results = run_ops.explode_results(history.where("run_id IS NOT NULL"))
    assert rows(results.select("run_id", "name"), "run_id") == [("new", "a"), ("old", None)]


def test_records_without_time_go_by_place_in_the_file(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text("".join(f'{{"run_id":"run-{i}","status":"success","hostname":"h"}}\n' for i in range(1, 3)))
    history = sources.read_run_history(spark, str(path))
    last = run_ops.keep_last(history.select("host", "run_id", "ts", "_seq"), ["host"], ["ts", "_seq"])
    assert last.collect()[0]["run_id"] == "run-2"


def test_history_and_manifests_round_trip(spark, tmp_path):
    runs = jobs._as(spark.createDataFrame(
        [("a", "success", 0, 1.5, "h"), ("b", "skipped", 0, 0.0, "h"), ("c", "failed", 2, 0.0, "h")],
        "run_id string, status string, databases_failed int, adaptive_load_per_cpu double, hostname string"), schemas.RUN)
    sinks.append_run_history(runs, str(tmp_path / "h"))
    back = sources.read_run_history(spark, str(tmp_path / "h"))
    assert rows(back.select("run_id", "databases_failed", "adaptive_load_per_cpu"), "run_id") == [("a", 0, 1.5), ("c", 2, 0.0)]
    text = "".join(p.read_text() for p in (tmp_path / "h").glob("*.json"))
    assert '"databases_failed":0' in text and '"adaptive_load_per_cpu":0' not in text
    sinks.write_manifests(runs, str(tmp_path / "m"))
    assert rows(sources.read_manifests(spark, str(tmp_path / "m")).select("run_id", "status"), "run_id") == [
        ("a", "success"), ("b", "skipped"), ("c", "failed")]
    folder = tmp_path / "f" / "2026-05-28_10-00-00"
    folder.mkdir(parents=True)
    (folder / "manifest.json").write_text(NEW.replace(",", ",\n"))
    assert rows(sources.read_manifests(spark, str(tmp_path / "f")).select("run_id", "databases_total")) == [("new", 2)]


def test_metric_text(spark, tmp_path):
    labels = 'job="fleet",service="mysql",env="pilot"'
    gauges = {"backup_last_run_timestamp": 1760000000.0, "backup_last_duration_seconds": 12.345,
              "backup_last_size_bytes": 4096.0, "backup_last_status": 1.0, "backup_physical_last_duration_seconds": 90.5,
              "backup_adaptive_load_per_cpu": 0.0, "backup_logical_validation_last_status": -1.0}
    data = [("h", m, v, labels, None) for m, v in gauges.items()] + [
        ("h", "backup_database_row_count", 7.0, labels, "db1"), ("h", "backup_database_row_count", 8.0, labels, "db2")]
    samples = spark.createDataFrame(data, "host string, metric string, value double, labels string, database string")
    sinks.write_metric_text(samples, str(tmp_path / "g"))
    files = list((tmp_path / "g").glob("host=h/*.txt"))
    lines = files[0].read_text().splitlines()
    assert len(files) == 1
    for line in ["# HELP backup_last_run_timestamp Unix timestamp when the most recent backup run ended.",
                 "# TYPE backup_last_run_timestamp gauge", f"backup_last_run_timestamp{{{labels}}} 1760000000",
                 f"backup_last_duration_seconds{{{labels}}} 12.345", f"backup_physical_last_duration_seconds{{{labels}}} 90.500",
                 f"backup_adaptive_load_per_cpu{{{labels}}} 0.000",
                 f'backup_database_row_count{{{labels},database="db1"}} 7']:
        assert line in lines
    assert lines[0].startswith("# HELP backup_last_run_timestamp") and lines.count("# TYPE backup_database_row_count gauge") == 1
    back = sources.read_metric_text(spark, str(tmp_path / "g"))
    got = {(r["metric"], r["labels"].get("database")): r["value"] for r in back.collect()}
    assert got == {(m, d): v for _, m, v, _, d in data}
    assert {r["host"] for r in back.collect()} == {"h"}
    report = {r["metric"]: r for r in jobs.observability_report(spark, str(tmp_path / "g")).collect()}
    assert report["backup_logical_validation_last_status"]["label"] == "Not Validated"
    assert report["backup_last_status"]["last_write_result"] == "failed-or-unknown" and len(report) == 28


def test_metric_text_oddities(spark, tmp_path):
    folder = tmp_path / "h1"
    folder.mkdir()
    (folder / "x.prom").write_text('\n# HELP a b\nlonely\n  plain 5\nx{a="1 2",b="q\\"z"}  nonsense\n')
    got = {r["metric"]: (r["value"], r["labels"], r["host"]) for r in sources.read_metric_text(spark, str(tmp_path)).collect()}
    assert got == {"plain": (5.0, {}, "h1"), "x": (0.0, {"a": "1 2", "b": 'q"z'}, "h1")}


def test_logs(spark, tmp_path):
    folder = tmp_path / "h1"
    folder.mkdir()
    run = ["2026/05/28 21:56:10.631283 found 4 databases: a", "no time here", "", "2026/05/28 21:56:11.000001 x\r"]
    (folder / "2026-05-28_21-56-10.log").write_bytes(("\n".join(run) + "\n").encode())
    (folder / "2026-05-28.log").write_text("2026/05/28 21:56:10.631283 daily copy\n")
    got = rows(sources.read_run_logs(spark, str(tmp_path)), "line_no")
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [
        ("h1", "2026-05-28_21-56-10", 1, "found 4 databases: a"), ("h1", "2026-05-28_21-56-10", 2, "no time here"),
        ("h1", "2026-05-28_21-56-10", 3, ""), ("h1", "2026-05-28_21-56-10", 4, "x")]
    assert got[0][3] == T(2026, 5, 28, 21, 56, 10, 631283) and got[1][3] is None
    assert rows(sources.read_log_lines(spark, str(folder), "2026-05-28").select("line_no")) == [(1,)]
    assert sources.read_log_lines(spark, str(folder), "2020-01-01").count() == 0


def test_continued_log_lines_across_splits(spark, tmp_path):
    (tmp_path / "a").mkdir()
    stamps = [f"2026/01/01 00:00:0{i}.000000 first of {i}\n" + "".join(f"  more {k}\n" for k in range(300)) for i in range(5)]
    (tmp_path / "a" / "2026-01-01_02-00-00.log").write_text("no time yet\n" + "".join(stamps))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = sources.read_run_logs(spark, str(tmp_path), continued=True).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert lines[0]["ts"] is None and lines[0]["continues"] is None
    assert [(r["ts"].second, r["continues"]) for r in lines[1:]] == [
        (i, None if k == 0 else 2 + 301 * i) for i in range(5) for k in range(301)]


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i}\n" for i in range(1, 20001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        got = sources.read_log_lines(spark, str(path))
        assert got.where("line != concat('line ', line_no)").count() == 0 and got.count() == 20000
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_state_and_overrides(spark, tmp_path):
    (tmp_path / "h1").mkdir()
    (tmp_path / "h1" / "state.json").write_text('{\n "logical_last_success": "2026-06-23T02:00:00+02:00",\n "physical_last_success": "soon"\n}')
    (tmp_path / "h1" / "overrides.json").write_text('{"expires_at":"2026-07-01T00:00:00Z","values":{"A":"1","B":""},"note":"x"}')
    assert rows(sources.read_schedule_state(spark, str(tmp_path / "*" / "state.json")), "kind") == [
        ("h1", "logical", T(2026, 6, 23)), ("h1", "physical", None)]
    assert rows(sources.read_overrides(spark, str(tmp_path / "*" / "overrides.json")), "key") == [
        ("h1", "A", "1", T(2026, 7, 1)), ("h1", "B", "", T(2026, 7, 1))]
    assert sources.read_overrides(spark, str(tmp_path / "none.json")).count() == 0


def dumps(tmp_path):
    good = gzip.compress(PAYLOAD)
    files = {"good": good, "members": gzip.compress(PAYLOAD[:10]) + gzip.compress(PAYLOAD[10:]), "plain": PAYLOAD,
             "cut": good[:-4], "crc": good[:-8] + b"\0\0\0\0" + good[-4:], "unmarked": gzip.compress(b"CREATE"),
             "empty": b"", "trailing": good + b"xxxx"}
    folder = tmp_path / "root" / "run-1"
    folder.mkdir(parents=True)
    for name, data in files.items():
        (folder / f"{name}.sql.gz").write_bytes(data)
    return files


def test_artifact_digests(spark, tmp_path):
    files = dumps(tmp_path)
    folders = spark.createDataFrame([(str(tmp_path / "root" / "run-1"),), ("/gone",), ("",)], "run_folder string")
    artifacts = listed_artifacts(list_folders(folders))
    seen = sources.read_artifacts(spark, str(tmp_path / "root"))
    assert seen.select("run_id", "db", "bytes").subtract(artifacts.select("run_id", "db", "bytes")).count() == 0
    got = {r["db"]: r for r in artifact_digests(artifacts).collect()}
    for name, data in files.items():
        assert got[name]["artifact_sha256"] == hashlib.sha256(data).hexdigest() and got[name]["bytes"] == len(data)
    for name in ("good", "members"):
        assert got[name]["payload_sha256"] == hashlib.sha256(PAYLOAD).hexdigest() and got[name]["has_end_marker"]
    assert {n: (r["header_error"], r["gzip_error"]) for n, r in got.items() if r["gzip_error"]} == {
        "plain": (True, "gzip: invalid header"), "cut": (False, "unexpected EOF"), "crc": (False, "gzip: invalid checksum"),
        "empty": (True, "EOF"), "trailing": (False, "gzip: invalid header")}
    hashed = file_sha256(artifacts.select("path"))
    assert {r["sha256"] for r in hashed.collect()} == {hashlib.sha256(d).hexdigest() for d in files.values()}
    lines = sources.read_dump_lines(spark, str(tmp_path / "root" / "run-1" / "good.sql.gz"))
    assert [r["line"] for r in lines.collect()] == PAYLOAD.decode().splitlines()


@pytest.mark.parametrize("step", [1 << 10, 1 << 22])
def test_inflating_in_steps(step):
    payload = b"\0" * 20_000_000 + b"-- Dump completed\n"
    data, inflated = gzip.compress(payload) + gzip.compress(payload), _Payload()
    for i in range(0, len(data), step):
        inflated.feed(data[i:i + step])
    inflated.close()
    assert inflated.error is None and inflated.members == 2 and inflated.size == 2 * len(payload)
    assert inflated.sha.hexdigest() == hashlib.sha256(payload * 2).hexdigest()


def test_validate_runs(spark, tmp_path):
    files = dumps(tmp_path)
    sha, folder = hashlib.sha256, str(tmp_path / "root" / "run-1")
    def result(name, artifact="", payload=""):
        return {"name": name, "status": "success", "artifact_sha256": artifact, "sql_sha256": payload}
    results = [result("good", sha(files["good"]).hexdigest(), sha(PAYLOAD).hexdigest()), result("good", "deadbeef"),
               result("good", "", "deadbeef"), result("plain"), result("crc"), result("cut", "", "x"), result("unmarked"),
               result("absent"), result("empty")]
    data = [("run-1", folder, results), ("run-2", "", results), ("run-3", "/gone", results), ("run-4", folder, []),
            ("run-5", folder, [results[0]])]
    history = spark.createDataFrame([("h", *d, T(2026, 1, 1)) for d in data],
                                    f"host string, run_id string, run_folder string, results array<struct<{schemas.RESULT}>>, ts timestamp")
    checked, fields = jobs.validate_runs(history)
    errors = {r["position"]: r["error"] for r in checked.where("run_id = 'run-1'").collect()}
    assert errors[0] == "" and errors[1].startswith("artifact sha256 mismatch: manifest=deadbeef actual=")
    assert errors[2].startswith("sql sha256 mismatch: manifest=deadbeef actual=")
    assert errors[3] == "invalid gzip header: gzip: invalid header"
    assert errors[4] == "gzip checksum or read error: gzip: invalid checksum"
    assert errors[5] == "sql payload hash read error: unexpected EOF"
    assert errors[6] == "missing '-- Dump completed' signature at end of file" and errors[7] == "file missing"
    assert errors[8] == "invalid gzip header: EOF"
    told = {r["run_id"]: (r["validation_status"], r["validation_error"]) for r in fields.collect()}
    assert told["run-2"] == ("failed", "No local run folder recorded for this backup")
    assert told["run-3"] == ("failed", "Local backup files have been removed (retention period exceeded)")
    assert told["run-4"] == ("failed", "No logical dump results recorded for this backup run")
    assert told["run-1"][1].startswith("validation failed for good: artifact sha256 mismatch")
    updated = run_ops.upsert_run_history(
        history.withColumns({c: F.lit(None).cast("string") for c in ("validation_mode", "validation_status", "validation_error")}),
        fields.where("run_id = 'run-1'").select("host", "run_id", "validation_mode", "validation_status", "validation_error"))
    assert rows(updated.groupBy("validation_status").count(), "validation_status") == [(None, 4), ("failed", 1)]


def test_validation_report(spark):
    fields = spark.createDataFrame([("run-9", "sandbox restore test", "failed", "validation failed for pf_central: row count mismatch")],
                                   "run_id string, validation_mode string, validation_status string, validation_error string")
    dbs = spark.createDataFrame([("run-9", 0, "pf_app", True, ""), ("run-9", 1, "pf_central", False, "row count mismatch")],
                                "run_id string, position int, db string, valid boolean, error string")
    assert [r["line"] for r in jobs.validation_report(fields, dbs).collect()] == [
        "Validation Mode: sandbox restore test", "Run ID: run-9", "Result: failed",
        "Error: validation failed for pf_central: row count mismatch", "Databases:", "- pf_app: ok",
        "- pf_central: failed (row count mismatch)"]


def test_inspect_and_inventory(spark, tmp_path):
    dumps(tmp_path)
    physical = tmp_path / "root" / "run-1" / "physical" / "d"
    physical.mkdir(parents=True)
    (physical / "x.ibd").write_bytes(b"x" * 1500)
    files = sources.read_inventory(spark, str(tmp_path / "root"))
    got = {r["name"]: (r["kind"], r["size"]) for r in jobs.inspect_run(files, "run-1").collect()}
    assert got["physical"] == ("physical", "1.5 kB") and got["unmarked"][0] == "logical" and len(got) == 8
    plan = sinks.plan_upload(files, "p")
    assert plan.where("object_key = 'p/run-1/physical/d/x.ibd' AND size = 1500").count() == 1


def test_export_and_snapshot(spark, tmp_path):
    source = tmp_path / "src"
    spark.range(100).select("id", (F.col("id") * 1.5).alias("x")).write.parquet(str(source / "t.parquet"))
    spark.range(0).withColumn("y", F.lit("z")).write.parquet(str(source / "u.parquet"))
    where = TableSource(folder=str(source))
    assert rows(discover_tables(spark, where)) == [("table", "t"), ("table", "u")]
    other = tmp_path / "other"
    spark.range(1).write.parquet(str(other / "c.parquet"))
    run = jobs.snapshot_tables(
        spark, {"main": where, "bk_old": TableSource(folder=str(other)), "mysql": where,
                "gone": TableSource(folder=str(tmp_path / "nowhere"))},
        str(tmp_path / "out"), str(tmp_path / "hist"), "h", T(2026, 1, 2, 3, 4, 5), pk_columns={"main": {"t": ["id"]}},
        sample_rows=10)
    row = run.collect()[0]
    result = {r["name"]: r for r in row["results"]}["main"]
    lost = {r["name"]: r for r in row["results"]}["gone"]
    assert (row["run_id"], row["status"], row["databases_total"]) == ("2026-01-02_03-04-05", "partial", 2)
    assert row["failure_reason"] == "1 of 2 database backups failed"
    assert lost["status"] == "failed" and lost["error_category"] == "command" and "nowhere" in lost["error"]
    assert result["table_row_counts"] == {"t": 100, "u": 0} and result["row_counts"] == 100 and result["table_count"] == 2
    assert set(result["sample_row_hashes"]) == {"t"} and len(result["artifact_sha256"]) == 64
    text = "".join(f"{i}\t{i * 1.5:.6f}\n" for i in range(10))
    assert result["sample_row_hashes"]["t"] == hashlib.sha256(text.encode()).hexdigest()
    copy = spark.read.parquet(str(tmp_path / "out" / "2026-01-02_03-04-05" / "main" / "t"))
    assert copy.count() == 100
    assert sources.read_run_history(spark, str(tmp_path / "hist")).count() == 1
    assert rows(sources.read_manifests(spark, str(tmp_path / "out" / "manifests")).select("run_id")) == [("2026-01-02_03-04-05",)]
    chosen = jobs.snapshot_tables(spark, {"bk_old": TableSource(folder=str(other)), "main": where}, str(tmp_path / "out2"),
                                  str(tmp_path / "hist"), "h", T(2026, 1, 3), allow=["bk_old"], requested={"bk_old": ["c", "z"]})
    assert [(r["name"], r["table_row_counts"]) for r in chosen.collect()[0]["results"]] == [("bk_old", {"c": 1})]
    assert sources.read_run_history(spark, str(tmp_path / "hist")).count() == 2
    with pytest.raises(Exception):
        sinks.export_tables(spark, scan_tables(spark, where, ["t"]), str(tmp_path / "out"), "2026-01-02_03-04-05", "main")


def test_catalogue_source(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS keep LOCATION '{tmp_path}/keep'")
    spark.range(3).write.mode("overwrite").saveAsTable("keep.numbers")
    spark.sql("CREATE OR REPLACE VIEW keep.even AS SELECT * FROM keep.numbers WHERE id % 2 = 0")
    source = TableSource(database="keep")
    assert rows(discover_tables(spark, source)) == [("view", "even"), ("table", "numbers")]
    assert scan_tables(spark, source, ["even"])["even"].count() == 2
    spark.sql("DROP DATABASE keep CASCADE")


def test_encryption(spark):
    df = spark.createDataFrame([(1, "secret", None), (2, "secret", "b")], "id int, a string, b string")
    for key in ("short", "k" * 32, "k" * 40):
        sealed = sinks.encrypt_columns(df, ["a", "b"], key)
        first, second = [r["a"] for r in sealed.orderBy("id").collect()]
        assert first != second and b"secret" not in first
        assert rows(sinks.decrypt_columns(sealed, ["a", "b"], key), "id") == [(1, "secret", None), (2, "secret", "b")]


def test_expired_runs_leave_a_new_version(spark, tmp_path):
    table = spark.createDataFrame([("h", i, i * 10) for i in range(5)], "host string, run_id int, x int")
    expired = spark.createDataFrame([("h", 1), ("h", 3)], "host string, run_id int")
    path = sinks.drop_expired(table, expired, str(tmp_path / "t"), "2")
    assert [r["run_id"] for r in spark.read.parquet(path).orderBy("run_id").collect()] == [0, 2, 4]


def test_missing_folders_need_no_results(spark):
    assert verify.missing_run_folders(
        spark.createDataFrame([("h", "a", "/x", [1])], "host string, run_id string, run_folder string, results array<int>"),
        spark.createDataFrame([("/x",)], "run_folder string")).count() == 0


def test_hosts_that_share_a_run_id_are_validated_apart(spark, tmp_path):
    whole, cut = gzip.compress(b"x\n-- Dump completed\n"), gzip.compress(b"x\n")
    for host, data in (("h1", whole), ("h2", cut)):
        folder = tmp_path / host / "2026-01-01_02-00-00"
        folder.mkdir(parents=True)
        (folder / "app.sql.gz").write_bytes(data)
    result = {"name": "app", "status": "success", "artifact_sha256": "", "sql_sha256": ""}
    history = spark.createDataFrame(
        [(h, "2026-01-01_02-00-00", str(tmp_path / h / "2026-01-01_02-00-00"), [result], T(2026, 1, 1)) for h in ("h1", "h2")],
        f"host string, run_id string, run_folder string, results array<struct<{schemas.RESULT}>>, ts timestamp")
    checked, fields = jobs.validate_runs(history)
    assert rows(checked.select("host", "valid"), "host") == [("h1", True), ("h2", False)]
    told = {r["host"]: r for r in fields.collect()}
    assert told["h1"]["validation_status"] == "success" and told["h2"]["validation_status"] == "failed"
    assert told["h2"]["validation_databases"][0]["database"] == "app" and not told["h2"]["validation_databases"][0]["valid"]
    assert told["h1"]["validation_checked_at"] is not None


def test_manifests_of_hosts_with_one_run_id(spark, tmp_path):
    runs = jobs._as(spark.createDataFrame([("r", "success", "h1"), ("r", "failed", "h2"), ("r", "partial", "h2")],
                                          "run_id string, status string, hostname string"), schemas.RUN)
    sinks.write_manifests(runs, str(tmp_path / "m"))
    assert rows(sources.read_manifests(spark, str(tmp_path / "m")).select("host", "run_id", "status"), "host", "status") == [
        ("h1", "r", "success"), ("h2", "r", "failed"), ("h2", "r", "partial")]


def test_object_keys_of_hosts_with_one_run_id(spark):
    files = spark.createDataFrame([("h1", "r", "a b", 1), ("h2", "r", "a b", 2)], "host string, run_id string, rel_path string, size int")
    assert rows(sinks.plan_upload(files, "/p/", host="host").select("object_key", "size"), "size") == [("p/h1/r/a%20b", 1), ("p/h2/r/a%20b", 2)]
    assert rows(sinks.plan_upload(files, "", host="host").select("object_key", "size"), "size")[0] == ("h1/r/a%20b", 1)
    assert rows(sinks.plan_upload(files, "p").select("object_key").distinct()) == [("p/r/a%20b",)]


def test_failed_export_leaves_nothing(spark, tmp_path):
    good = spark.range(10)
    bad = spark.range(10).select(F.raise_error(F.lit("torn page")).alias("x"))
    root = str(tmp_path / "out")
    with pytest.raises(Exception, match="torn page"):
        sinks.export_tables(spark, {"a": good, "b": bad}, root, "run", "main", parallel=1)
    assert sinks.read_export(spark, root, "run", "main") == {}
    assert [p.name for p in (tmp_path / "out" / "run").iterdir() if not p.name.startswith(".")] == []
    # An attempt whose driver was lost: files without a commit record are not read, and the next attempt replaces them.
    good.write.parquet(f"{root}/run/main/a")
    good.write.parquet(f"{root}/run/{sinks.STAGING}-main-x/a")
    assert sinks.read_export(spark, root, "run", "main") == {}
    assert sinks.clean_exports(spark, root, "run") == [f"{sinks.STAGING}-main-x", "main"]
    good.write.parquet(f"{root}/run/main/old")
    sinks.export_tables(spark, {"a": good}, root, "run", "main")
    assert {n: df.count() for n, df in sinks.read_export(spark, root, "run", "main").items()} == {"a": 10}
    assert sinks.clean_exports(spark, root, "run") == []
    with pytest.raises(FileExistsError):
        sinks.export_tables(spark, {"a": good}, root, "run", "main")


def test_database_that_fails_while_it_is_written_is_recorded(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "good" / "t.parquet"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "t.parquet").write_bytes(b"PAR1 no parquet file at all PAR1")
    run = jobs.snapshot_tables(spark, {"good": TableSource(folder=str(tmp_path / "good")), "bad": TableSource(folder=str(tmp_path / "bad"))},
                               str(tmp_path / "out"), str(tmp_path / "hist"), "h", T(2026, 1, 2))
    assert {r["name"]: r["status"] for r in run.collect()[0]["results"]} == {"good": "success", "bad": "failed"}


def test_digest_tree(spark):
    leaves = [("h", "r", "d", t, f"p{i}", f"{t}{i}") for t in "ab" for i in range(40)]
    names = "host string, run_id string, db string, table_name string, part string, sha256 string"
    recorded = spark.createDataFrame(leaves, names)
    assert digest_tree.root_digests(recorded).collect() == digest_tree.root_digests(recorded.orderBy(F.rand(1))).collect()
    assert digest_tree.broken_parts(recorded, recorded).collect() == []
    changed = [(*x[:5], "other" if x[3:5] == ("a", "p3") else x[5]) for x in leaves if x[3:5] != ("b", "p7")]
    found = spark.createDataFrame([*changed, ("h", "r", "d", "b", "new", "n"), ("h", "r", "e", "c", "p", "x")], names)
    assert rows(digest_tree.broken_parts(recorded, found), "db", "table_name", "part") == [
        ("h", "r", "d", "a", "p3", "changed"), ("h", "r", "d", "b", "new", "unexpected"), ("h", "r", "d", "b", "p7", "missing"),
        ("h", "r", "e", "c", "p", "unexpected")]


def test_snapshots_pass_their_validation_until_a_part_breaks(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "src" / "t.parquet"))
    source = {"main": TableSource(folder=str(tmp_path / "src"))}
    for host in ("h1", "h2", "h3"):
        jobs.snapshot_tables(spark, source, str(tmp_path / host), str(tmp_path / "hist"), host, T(2026, 1, 2))
    root = tmp_path / "h2" / "2026-01-02_00-00-00"
    parts = sorted((root / "main" / "t").glob("part-*.parquet"))
    parts[0].write_bytes(b"broken")
    (root / "main" / "t" / ("." + parts[0].name + ".crc")).unlink(missing_ok=True)
    parts[1].unlink()
    history = sources.read_run_history(spark, str(tmp_path / "hist"))
    wrong = history.where("host = 'h3'").withColumn("results", F.transform("results", lambda r: r.withField("artifact_sha256", F.lit("beef"))))
    checked, fields = jobs.validate_runs(history.where("host != 'h3'").unionByName(wrong))
    told = {r["host"]: r["error"] for r in checked.collect()}
    assert told["h1"] == "" and told["h3"].startswith("artifact sha256 mismatch: manifest=beef actual=")
    assert told["h2"] == f"part changed: table=t file={parts[0].name} (2 in all)"
    assert {r["host"]: r["validation_status"] for r in fields.collect()} == {"h1": "success", "h2": "failed", "h3": "failed"}
