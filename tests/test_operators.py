"""Operators against literal cases and against direct simulation in Python."""

import hashlib
import random
from datetime import datetime as T, timedelta

import pytest
from pyspark.sql import functions as F

from tidekeep.operators import alerts, catalog, filters, logs, metrics, retention, runs, verify
from tidekeep.functions.text import fuzzy_match
from tidekeep.operators.ordered_hash import ordered_sha256
from tidekeep.operators.running import Running, balanced_chunk, running, time_chunk


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- running values -----------------------------------------------------------------

@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_running_equals_a_plain_scan(spark, chunk):
    rng = random.Random(chunk)
    data = [(rng.choice(["hot", "hot", "a", "b"]), i, rng.choice([None, rng.randint(-5, 5)])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    v = F.col("v")
    got = running(df, ["k"], ["i"], {
        "s": Running("sum", v), "lo": Running("min", v), "hi": Running("max", v), "la": Running("last", v),
        "pl": Running("last", v, before=True)}, F.floor(F.col("i") / chunk).cast("bigint"))
    want, seen = [], {}
    for k, i, value in data:
        past = seen.setdefault(k, [])
        known = [x for x in past if x is not None]
        before = known[-1] if known else None
        past.append(value)
        known = [x for x in past if x is not None]
        want.append((k, i, value, *((sum(known), min(known), max(known), known[-1]) if known else (None,) * 4), before))
    assert sorted(
        rows(got.select("k", "i", "v", "s", "lo", "hi", "la", "pl")), key=lambda r: r[1]) == want


def test_balanced_chunks(spark):
    crowded = spark.range(10_000).select(F.timestamp_micros(F.lit(10 ** 15) + F.col("id")).alias("ts"), "id")
    spread = spark.range(100).select(F.timestamp_seconds(F.col("id") * 10 ** 6).alias("ts"), (F.col("id") + 20_000).alias("id"))
    df = crowded.union(spread)
    sizes = df.groupBy(balanced_chunk(df, "ts", 50).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("c").collect()
    assert max(r["n"] for r in sizes) <= 2 * 10_100 / 50 + 2
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    got = running(df.withColumn("k", F.lit("hot")), ["k"], ["ts"], {"n": Running("sum", F.lit(1))},
                  balanced_chunk(df, "ts", 50))
    assert got.agg(F.max("n"), F.count_distinct("n")).collect()[0][:] == (10_100, 10_100)


# --- retention ----------------------------------------------------------------------

def simulate_retention(times, daily, weekly, monthly):
    newest_first, keep = sorted(times, reverse=True), set()
    for slots, bucket in [(daily, lambda t: t.date()), (weekly, lambda t: t.isocalendar()[:2]),
                          (monthly, lambda t: (t.year, t.month))]:
        seen = []
        for t in newest_first:
            if bucket(t) not in seen:
                seen.append(bucket(t))
                if len(seen) <= slots:
                    keep.add(t)
    return keep


def test_retention_equals_simulation(spark):
    rng = random.Random(1)
    data = {f"h{h}": sorted({T(2024, 11, 1) + timedelta(hours=rng.randint(0, 4000)) for _ in range(rng.randint(1, 200))})
            for h in range(8)}
    df = spark.createDataFrame([(h, t.strftime("%Y-%m-%d_%H-%M-%S"), t) for h, ts in data.items() for t in ts],
                               "host string, run_id string, ts timestamp_ntz")
    got = retention.gfs_retention(df, 5, 3, 2)
    kept = {(r["host"], r["ts"]) for r in got.where("keep").collect()}
    assert kept == {(h, t) for h, ts in data.items() for t in simulate_retention(ts, 5, 3, 2)}
    assert got.count() == df.count()
    expired = retention.expired_runs(df, retention.kept_runs(df, 5, 3, 2))
    assert expired.count() == df.count() - len(kept)


def test_current_run_takes_no_slot(spark):
    df = spark.createDataFrame([("h", "a", T(2026, 1, 1, 1)), ("h", "b", T(2026, 1, 2, 1)), ("h", "c", None)],
                               "host string, run_id string, ts timestamp_ntz")
    current = df.where("run_id = 'b'").select("host", "run_id")
    assert rows(retention.gfs_retention(df, 1, 0, 0, current).select("run_id", "keep")) == [("a", True)]


# --- runs ---------------------------------------------------------------------------

def test_run_status_and_upload_failure(spark):
    df = spark.createDataFrame(
        [("a", 2, 2, 0, None, None), ("b", 2, 1, 1, None, None), ("c", 2, 0, 2, "", None), ("d", 1, 1, 0, "disk", None),
         ("e", 2, 2, 0, None, "s3 unavailable"), ("f", 2, 1, 1, None, "s3 unavailable")],
        "run_id string, databases_total bigint, databases_succeeded bigint, databases_failed bigint, "
        "failure_reason string, logical_upload_error string")
    done = runs.apply_upload_failure(runs.run_status(df))
    assert rows(done.select("run_id", "status", "failure_reason"), "run_id") == [
        ("a", "success", ""), ("b", "partial", "1 of 2 database backups failed"),
        ("c", "failed", "2 of 2 database backups failed"), ("d", "partial", "disk"),
        ("e", "failed", "logical backup upload failed: s3 unavailable"), ("f", "partial", "1 of 2 database backups failed")]


def test_policy_violations(spark):
    df = spark.createDataFrame([("root", "runner"), ("root", " "), ("root", "api"), ("developer", "runner")],
                               "os_user string, execution_source string")
    assert rows(runs.policy_violations(df)) == [("root", "runner"), ("root", " ")]
    assert rows(runs.policy_violations(df, allow_root=True)) == []


def test_upsert_replaces_only_the_last_record(spark):
    history = spark.createDataFrame([("h", "x", 1, "failed"), ("h", "x", 2, "failed"), ("h", "y", 3, "ok")],
                                    "host string, run_id string, ts int, status string")
    changes = spark.createDataFrame([("h", "x", "fixed"), ("h", "gone", "new")], "host string, run_id string, status string")
    assert rows(runs.upsert_run_history(history, changes), "ts") == [
        ("h", "x", 1, "failed"), ("h", "x", 2, "fixed"), ("h", "y", 3, "ok")]
    assert rows(runs.unknown_changes(history, changes)) == [("h", "gone", "new")]


def test_attempts_are_numbered_through_equal_rows(spark):
    data = [("r", "d", 1, "failed", "x"), ("r", "d", 1, "failed", "x"), ("r", "d", 5000, "success", None),
            ("r", "e", 3, "failed", "Slow down")]
    df = spark.createDataFrame(data, "run_id string, name string, attempt_key int, status string, error string")
    numbered = runs.number_attempts(df)
    assert rows(numbered.select("name", "attempt", "status"), "name", "attempt") == [
        ("d", 1, "failed"), ("d", 2, "failed"), ("d", 3, "success"), ("e", 1, "failed")]
    assert rows(runs.final_attempt(numbered).select("name", "attempt", "status", "error", "attempts"), "name") == [
        ("d", 3, "success", None, 3), ("e", 1, "failed", "Slow down", 1)]
    assert rows(runs.attempt_rollup(numbered, 3).select("name", "attempts", "rate_limit_retries"), "name") == [
        ("d", 3, 0), ("e", 1, 1)]


def test_carry_forward_across_chunks(spark):
    start = T(2026, 1, 1)
    data = [("h", i, start + timedelta(hours=10 * i), s, v, f) for i, (s, v, f) in enumerate([
        ("failed", None, ""), ("success", None, "/a"), ("failed", "success", ""), ("skipped", None, ""),
        ("failed", None, "/b"), ("skipped", "failed", "")])]
    df = spark.createDataFrame(data, "host string, run_id int, ts timestamp_ntz, status string, "
                                     "validation_status string, run_folder string")
    out = runs.carry_forward(df, time_chunk("ts", 3600)).orderBy("run_id").collect()
    hours = [None if r["last_success"] is None else int((r["last_success"] - start).total_seconds() // 36000) for r in out]
    assert hours == [None, 1, 1, 1, 1, 1]
    assert [r["validation_gauge"] for r in out] == [-1, -1, 1, 1, 1, 0]
    assert [r["snapshot_run"] for r in out] == [0, 1, 2, 2, 4, 4]
    assert [r["last_cleanup"] and (r["last_cleanup"] - start).total_seconds() // 36000 for r in out] == [None, 1, 1, 1, 4, 4]


def test_skipped_run_repeats_the_snapshot(spark):
    base = dict(duration="2s", cleanup_error=None, size_bytes=5, databases_total=1, databases_succeeded=1,
                databases_failed=0, uploaded=None, logical_due=True, physical_due=False, adaptive_load_per_cpu=0.5,
                adaptive_logical_parallel=2, adaptive_physical_parallel=4, adaptive_xbcloud_parallel=6)
    schema = ("host string, run_id string, ts timestamp_ntz, status string, run_folder string, duration string, "
              "cleanup_error string, size_bytes bigint, databases_total int, databases_succeeded int, databases_failed int, "
              "uploaded boolean, logical_due boolean, physical_due boolean, adaptive_load_per_cpu double, "
              "adaptive_logical_parallel int, adaptive_physical_parallel int, adaptive_xbcloud_parallel int")
    df = spark.createDataFrame([("h", "a", T(2026, 1, 1), "success", "/a", *base.values()),
                                ("h", "b", T(2026, 1, 5), "skipped", "", *base.values())], schema)
    df = df.withColumn("physical_backup", F.expr(
        "CAST(NULL AS struct<status: string, duration: string, attempts: int, rate_limit_retries: int, "
        "xtrabackup_parallel: int, xbcloud_parallel: int>)"))
    got = {(r["run_id"], r["metric"]): r["value"] for r in metrics.run_to_samples(df).collect()}
    assert len(got) == 2 * len(metrics.NAMES)
    for name in metrics.NAMES:
        if name != "backup_metrics_last_update_timestamp":
            assert got["a", name] == got["b", name], name
    assert got["a", "backup_last_status"] == 1 and got["a", "backup_upload_success"] == 0
    assert got["a", "backup_logical_validation_last_status"] == -1
    assert got["b", "backup_metrics_last_update_timestamp"] - got["a", "backup_metrics_last_update_timestamp"] == 4 * 86400


# --- alerts and progress ------------------------------------------------------------

def simulate_alerts(samples):
    """samples: (host, seconds, metric, value); one evaluation per host and time."""
    fired = set()
    for host in {s[0] for s in samples}:
        gauges, open_since, done = {}, {}, set()
        for t in sorted({s[1] for s in samples if s[0] == host}):
            gauges.update({m: v for h, at, m, v in samples if h == host and at == t})
            for rule in alerts.RULES:
                known = all(m in gauges for m in rule.metrics)
                on = known and bool(rule.condition(lambda m: gauges[m], lambda m: t - gauges[m]))
                if not on:
                    open_since.pop(rule.name, None)
                    done.discard(rule.name)
                    continue
                begin = open_since.setdefault(rule.name, t)
                if t - begin >= rule.hold_seconds and rule.name not in done:
                    done.add(rule.name)
                    fired.add((host, rule.name, begin, t))
    return fired


def random_samples(seed, hosts=3, n=250):
    rng, out = random.Random(seed), {}
    for h in range(hosts):
        t = 1_000_000
        for _ in range(n):
            t += rng.choice([10, 60, 200, 400, 3000])
            metric = rng.choice(alerts.rule_metrics(alerts.RULES))
            if metric.endswith("timestamp"):
                value = t - rng.choice([0, 100, 50000])
            elif metric.endswith("seconds"):
                value = rng.choice([100, 8000])
            else:
                value = rng.choice([0, 0, 1, -1] if "validation" in metric else [0, 0, 0, 1])
            out[f"h{h}", t, metric] = float(value)
    return [(h, t, m, v) for (h, t, m), v in out.items()]


@pytest.mark.parametrize("chunk", [500, 10_000_000])
def test_alerts_equal_simulation(spark, chunk):
    samples = random_samples(chunk)
    df = spark.createDataFrame(samples, "host string, t bigint, metric string, value double")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = alerts.alert_firing(df, chunk=time_chunk("ts", chunk)).select(
        "host", "rule", F.unix_timestamp("started_at"), F.unix_timestamp("fired_at"))
    want = simulate_alerts(samples)
    assert len(want) > 20 and set(rows(got)) == want


def test_vector_and_ignores_label_order(spark):
    schema = "labels map<string,string>, ts int, value int"
    left = spark.createDataFrame([({"a": "1", "b": "2"}, 1, 5), ({"a": "1"}, 1, 6), ({"a": "1", "b": "2"}, 2, 7)], schema)
    right = spark.createDataFrame([({"b": "2", "a": "1"}, 1, 0)], schema)
    assert [r["value"] for r in alerts.vector_and(left, right).collect()] == [5]


def fold(events):
    total = current = completed = 0
    db = stage = None
    for kind, n, place, name in events:
        if kind == "found":
            total, stage = n, "discovered databases"
        elif kind == "processing":
            total, current, db, stage = n or total, place or current, name, f"processing {name}"
        elif kind == "starting":
            db, stage = name, f"dumping {name}"
            current = completed + 1 if not total else min(completed + 1, total)
        elif kind == "completed":
            completed = completed + 1 if not total else min(completed + 1, total)
            current, stage = max(current, completed), f"completed {name}"
        else:
            stage = {"upload": "uploading to S3", "cleanup": "cleanup"}[kind]
        yield total, current, completed, db, stage


def log_line(kind, n, place, name):
    return {"found": f"found {n} databases: x", "processing": f"[{place}/{n}] processing {name}",
            "starting": f"starting dump for database={name}", "upload": "s3 upload: x", "cleanup": "cleanup: x",
            "completed": f"completed dump for database={name} output=/x"}[kind]


@pytest.mark.parametrize("chunk", [1, 5, 1 << 16])
def test_progress_equals_the_fold(spark, chunk):
    rng, data, want = random.Random(chunk), [], {}
    for run in range(6):
        events = [(rng.choice(["found", "processing", "starting", "completed", "completed", "upload", "cleanup"]),
                   rng.randint(0, 6), rng.randint(0, 6), rng.choice("abc")) for _ in range(60)]
        data += [(run, i, log_line(*e)) for i, e in enumerate(events)] + [(run, 1000, "nothing to see")]
        want.update({(run, i): state for i, state in enumerate(fold(events))})
    df = spark.createDataFrame(data, "run_id int, line_no int, msg string")
    got = logs.progress_timeline(df, ["run_id"], chunk_lines=chunk).drop("percent").collect()
    assert {(r[0], r[1]): tuple(r)[2:] for r in got} == want


def test_progress_golden_percentages(spark):
    lines = ["found 4 databases: a, b, c, d", "[1/4] processing a",
             "completed dump for database=a output=/tmp/a.sql.gz size_bytes=123", "[2/4] processing b"]
    df = spark.createDataFrame([("r", i, m) for i, m in enumerate(lines)], "run_id string, line_no int, msg string")
    assert [r["percent"] for r in logs.progress_timeline(df, ["run_id"]).orderBy("line_no").collect()] == [0.0, 0.0875, 0.25, 0.3375]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_lines_without_a_time_take_the_one_before(spark, chunk):
    rng, data, want = random.Random(chunk), [], []
    for host, run in [("a", "r"), ("b", "r"), ("b", None)]:
        now = at = None
        for n in range(1, 60):
            own = n * 10 if rng.random() < 0.2 else None
            now, at = (own, n) if own else (now, at)
            data.append((host, run, n, own, f"m{n}"))
            want.append((host, run, n, now, f"m{n}", None if own else at))
    lines = spark.createDataFrame(data, "host string, run_id string, line_no bigint, ts bigint, msg string").repartition(5)
    got = logs.continued_lines(lines, chunk_lines=chunk)
    assert got.columns == [*lines.columns, "continues"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert logs.continued_lines(lines.limit(0)).collect() == []


def test_tail_and_error_summary(spark):
    df = spark.createDataFrame([("r", "t", i, m) for i, m in enumerate(
        ["a", "No space left on device 1", " Errno 28 ", "later", " "])] + [("r", "u", 0, " "), ("r", "u", 1, " x ")],
        "run_id string, tool string, line_no int, line string")
    assert rows(logs.stream_error_summary(df), "tool") == [("r", "t", "Errno 28"), ("r", "u", "x")]
    tail = logs.tail_lines(df, 2, keys=("run_id", "tool"))
    assert rows(tail.select("tool", "line_no", "total_lines"), "tool", "line_no") == [
        ("t", 3, 5), ("t", 4, 5), ("u", 0, 2), ("u", 1, 2)]


# --- catalogue, profiles, verification ----------------------------------------------

def test_scope(spark):
    requested = spark.createDataFrame([("d", t) for t in ("action", "notification_delivery_rule", "backup")],
                                      "db string, table_name string")
    found = spark.createDataFrame([("d", "action"), ("d", "backup")], "db string, table_name string")
    assert rows(catalog.available_tables(requested, found), "table_name") == [("d", "action"), ("d", "backup")]
    assert rows(catalog.missing_tables(requested, found)) == [("d", "notification_delivery_rule")]
    dbs = spark.createDataFrame([("pf_main",), ("bk_pf_main",), ("pf_central",)], "db string")
    assert rows(catalog.select_databases(dbs), "db") == [("pf_central",), ("pf_main",)]
    allow = spark.createDataFrame([("bk_pf_main",), ("other",)], "db string")
    assert rows(catalog.select_databases(dbs, allow)) == [("bk_pf_main",)]
    objs = spark.createDataFrame([("accounts",), ("broken_view",)], "name string")
    assert rows(catalog.drop_broken_views(objs, spark.createDataFrame([("broken_view",)], "view_name string"))) == [("accounts",)]


def test_fingerprint_does_not_depend_on_order(spark):
    objs = [("view", "v_users"), ("table", "orders"), ("table", "users"), ("trigger", "trg"), ("table", "users")]
    text = "\n".join(f"{s}:{n}" for s, n in sorted(objs))
    for order in (objs, objs[::-1]):
        df = spark.createDataFrame([("d", *o) for o in order], "db string, section string, name string")
        assert rows(catalog.schema_fingerprint(df)) == [("d", hashlib.sha256(text.encode()).hexdigest())]


def test_ordered_hash_of_a_group_larger_than_a_block(spark):
    data = spark.range(300_000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("k"),
                                       F.lpad(F.col("id").cast("string"), 8, "0").alias("line"))
    got = dict(rows(ordered_sha256(data, ["k"], ["line"], "line", "sha")))
    for name, keep in [("hot", lambda i: i % 10 != 0), ("small", lambda i: i % 10 == 0)]:
        text = "\n".join(f"{i:08d}" for i in range(300_000) if keep(i))
        assert got[name] == hashlib.sha256(text.encode()).hexdigest()


def test_validation_summary(spark):
    df = spark.createDataFrame([("r", 0, "ok", True, None), ("r", 2, "b", False, ""), ("r", 1, "a", False, "bad"), ("s", 0, "x", True, "")],
                               "run_id string, position int, db string, valid boolean, error string")
    assert rows(verify.validation_summary(df, keys=["run_id"]), "run_id") == [("r", "validation failed for a: bad, b"), ("s", "")]
    errors = spark.createDataFrame([("r", "gone"), ("t", "none")], "run_id string, error string")
    assert rows(verify.validation_summary(df, errors, ["run_id"]), "run_id") == [("r", "gone"), ("s", ""), ("t", "none")]
    assert rows(verify.validation_rollup(df, ["run_id"]), "run_id") == [("r", False), ("s", True)]


def test_count_comparison_names_the_first_failing_rule(spark):
    schema = "db string, table_name string, mode string, row_count bigint"
    left = spark.createDataFrame([("a", "t", "exact", 1), ("b", "t", "exact", 1), ("b", "u", "exact", 2), ("c", "t", "exact", 1),
                                  ("d", "t", "estimate", 9), ("e", "t", "exact", 4)], schema)
    right = spark.createDataFrame([("a", "t", 1), ("b", "t", 1), ("c", "u", 1), ("d", "t", 1), ("e", "t", 5)],
                                  "db string, table_name string, row_count bigint")
    assert dict(rows(verify.compare_table_counts(left, right).select("db", "error"))) == {
        "a": "", "b": "exact table row count set mismatch: manifest_tables=2 restored_tables=1",
        "c": "exact row count missing restored table: t", "d": "",
        "e": "exact row count mismatch table=t manifest=4 restored=5"}


def test_filters(spark):
    lines = spark.createDataFrame([('mysqldump: Couldn\'t find table: "x"',), ("note: dumped 10 tables",),
                                   ("xtrabackup: Transaction log of lsn (1) to (2) was copied.",),
                                   ("xtrabackup: Streaming ./x.ibd",), ("xbcloud: Upload completed.",)], "line string")
    assert filters.keep_dump_warnings(lines).count() == 1
    assert [r[0][:14] for r in rows(filters.keep_physical_events(lines))] == ["xtrabackup: Tr", "xbcloud: Uploa"]
    assert filters.search(lines, " ", ["line"]).count() == 5
    files = spark.createDataFrame([("h", "/b", p, u) for p, u in [
        ("old-run", 0), ("old-run/bk.sql.gz", 0), ("owned.log", 1000), ("a/b/c/d", 0)]], "host string, root string, rel_path string, uid int")
    assert rows(filters.ownership_drift(files, 1000).select("rel_path"), "place") == [("old-run",), ("old-run/bk.sql.gz",)]


def test_layers(spark):
    def layer(data, extra=""):
        return spark.createDataFrame(data, "host string, key string, value string" + extra)
    base = layer([("h", "DB_USER", "file"), ("h", "DB_PASS", "file"), ("h", "DB_HOST", "file"), ("h", "MINE", "file"),
                  ("h", "DB_PORT", "3306")])
    later, earlier = T(2030, 1, 1), T(2020, 1, 1)
    overrides = layer([("h", "DB_USER", "override", later), ("h", "DB_PASS", "override", later),
                       ("h", "DB_HOST", "override", earlier), ("h", "MINE", "override", later)], ", expires_at timestamp")
    env = layer([("h", "DB_PASS", "env"), ("h", "MINE", "env"), ("h", "DB_PORT", " ")])
    got = filters.layer_settings(base, overrides, env, F.lit("2026-01-01").cast("timestamp"))
    assert dict(rows(got.select("key", "value"))) == {
        "DB_USER": "override", "DB_PASS": "env", "DB_HOST": "file", "MINE": "file", "DB_PORT": None}
    masked = filters.mask_secrets(layer([("h", "DB_PASS", "x"), ("h", "DB_USER", "u"), ("h", "BACKUP_S3_KEY_ID", " ")]))
    assert dict(rows(masked.select("key", "value"))) == {"DB_PASS": "********", "DB_USER": "u", "BACKUP_S3_KEY_ID": ""}


def test_fuzzy_match_is_linear(spark):
    df = spark.createDataFrame([("a" * 200_000,), ("xaxaxbx^]",), ("ab\ncd",)], "t string")
    assert [r[0] for r in df.select(fuzzy_match("t", "aaab")).collect()] == [False, False, False]
    assert [r[0] for r in df.select(fuzzy_match("t", "aab^]")).collect()] == [False, True, False]
    assert [r[0] for r in df.select(fuzzy_match("t", "ad")).collect()] == [False, False, True]


def test_progress_of_hosts_that_share_a_run_id(spark):
    df = spark.createDataFrame([("a", "r", 1, "Found 3 databases"), ("b", "r", 1, "Found 7 databases")],
                               "host string, run_id string, line_no int, msg string")
    assert logs.progress_timeline(df).select("host").distinct().count() == 2 or logs.progress_timeline(df).count() == 0
