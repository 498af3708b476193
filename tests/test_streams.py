"""Streams give what the batch operators give, however the input is cut into micro-batches."""

import json
import os
import random
from datetime import datetime as T, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import random_samples
from tidekeep.operators import alerts, logs
from tidekeep.session import work_path
from tidekeep.streaming import inputs, state, tables, windows
from tidekeep.streaming.run import run_available


def arriving(spark, frames, **options):
    """A stream that gets each frame in a micro-batch of its own."""
    path = work_path(spark, "arriving")
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{path}/part={i:03d}")
    schema = frames[0].schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .option("latestFirst", False).options(**options).parquet(path))


def cut(spark, df, order, pieces):
    total = df.count()
    numbered = df.orderBy(order).coalesce(1).withColumn("_n", F.monotonically_increasing_id()).cache()
    size = -(-total // pieces)
    return [numbered.where(F.floor(F.col("_n") / size) == i).drop("_n") for i in range(pieces)]


@pytest.mark.parametrize("pieces,jumble", [(1, 0), (4, 0), (4, 1500)])
def test_alert_stream_equals_batch(spark, pieces, jumble):
    samples = spark.createDataFrame(random_samples(pieces + jumble), "host string, t bigint, metric string, value double")
    samples = samples.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    end = spark.createDataFrame([("end", "backup_last_status", 1.0, T(2030, 1, 1))], "host string, metric string, value double, ts timestamp")
    rng = random.Random(3)
    jumbled = samples.withColumn("_o", F.unix_timestamp("ts") + F.rand(rng.randint(0, 9)) * jumble)
    frames = [f.drop("_o") for f in cut(spark, jumbled, "_o", pieces)] + [end.select(samples.columns)]
    stream = state.alert_stream(arriving(spark, frames), late="2 hours")
    got, _ = run_available(stream, "alerts", passes=2)
    firing = got.where("state = 'firing'").select("host", "rule", "severity", "started_at", F.col("at").alias("fired_at"))
    want = alerts.alert_firing(samples)
    assert {tuple(r) for r in firing.collect()} == {tuple(r) for r in want.select(firing.columns).collect()}
    ends = {(r["host"], r["rule"], r["started_at"]) for r in got.where("state = 'resolved'").collect()}
    assert ends <= {(r["host"], r["rule"], r["started_at"]) for r in firing.collect()}


@pytest.mark.parametrize("pieces", [1, 5])
def test_live_progress_equals_batch(spark, pieces):
    rng, data, start = random.Random(pieces), [], T(2026, 1, 1)
    for i in range(300):
        run, db = rng.randint(0, 3), rng.choice("abc")
        line = rng.choice([f"found {rng.randint(0, 5)} databases: a", f"[{rng.randint(0, 5)}/{rng.randint(0, 5)}] processing {db}",
                           f"starting dump for database={db}", f"completed dump for database={db} output=/x", "s3 upload: x", "noise"])
        data.append((f"h{run % 2}", f"r{run}", i, start + timedelta(seconds=i), line))
    df = spark.createDataFrame(data, "host string, run_id string, line_no bigint, ts timestamp, msg string")
    stream = state.live_progress(arriving(spark, cut(spark, df, "line_no", pieces)).withWatermark("ts", "1 hour"), order="line_no")
    got, _ = run_available(stream, "progress")
    want = logs.progress_timeline(df, ["run_id"])
    columns = want.columns
    assert {tuple(r) for r in got.select(columns).collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("pieces", [1, 3])
def test_stale_series(spark, pieces):
    start = T(2026, 1, 1)
    def at(seconds):
        return start + timedelta(seconds=seconds)
    on = "backup_run_in_progress"
    data = [("a", at(0), on, 1.0), ("a", at(100), "x", 5.0), ("a", at(300), "x", 5.0), ("a", at(310), on, 0.0), ("a", at(900), "x", 1.0),
            ("b", at(0), on, 1.0), ("b", at(120), "x", 1.0), ("b", at(241), "x", 1.0), ("z", at(5000), "x", 1.0)]
    df = spark.createDataFrame(data, "host string, ts timestamp, metric string, value double")
    got, _ = run_available(state.stale_series(arriving(spark, cut(spark, df, "ts", pieces)), late="10 seconds"), "stale", passes=2)
    assert {(r["host"], r["last_update"], r["stale_at"]) for r in got.collect()} == {
        ("a", at(100), at(220)), ("b", at(120), at(240)), ("b", at(241), at(361))}


def test_daily_rollup_counts_late_lines(spark):
    day = T(2026, 1, 1, 12)
    first = [("h", "r1", day, "failed"), ("h", "r1", day, "ok"), ("h", "r2", day, "ok"), ("g", "r3", day, "retry"),
             ("h", "r4", day + timedelta(days=3), "ok")]
    late = [("h", "r1", day, "late"), ("h", "r4", day + timedelta(days=3), "ok")]
    schema = "host string, run_id string, ts timestamp, msg string"
    later = [("h", "r4", day + timedelta(days=3), "ok")]
    frames = [spark.createDataFrame(part, schema) for part in (first, later, late)]
    stream = windows.daily_log_rollup(arriving(spark, frames).withWatermark("ts", "1 hour"))
    got, query = run_available(stream, "days")
    assert {tuple(r)[0:1] + tuple(r)[2:] for r in got.collect()} == {("h", 3, 2, 1), ("g", 1, 1, 1)}
    assert windows.late_lines(query) >= 1


def test_metric_ticks(spark):
    start = T(2026, 1, 1)
    def at(seconds):
        return start + timedelta(seconds=seconds)
    on, began = "backup_run_in_progress", "backup_current_run_start_timestamp"
    data = [("h", at(0), on, 0.0), ("h", at(4), on, 1.0), ("h", at(4), began, float(int(at(2).timestamp()))), ("h", at(6), "backup_last_status", 1.0),
            ("h", at(100), on, 0.0)]
    df = spark.createDataFrame(data, "host string, ts timestamp, metric string, value double")
    df = df.withColumn("value", F.when(F.col("metric") == began, F.unix_timestamp(F.lit(at(2)))).otherwise(F.col("value")).cast("double"))
    got, _ = run_available(windows.live_metric_snapshot(arriving(spark, [df])), "ticks")
    rows = {r["tick_start"]: r for r in got.collect()}
    assert set(rows) == {at(0), at(5)}
    assert rows[at(0)][on] == 1.0 and rows[at(0)]["in_progress"] and rows[at(0)]["elapsed_seconds"] == 3.0
    assert rows[at(5)]["backup_last_status"] == 1.0 and not rows[at(5)]["in_progress"]


def test_run_history_is_deduplicated(spark, tmp_path):
    record = {"timestamp": "2026-05-28T10:00:00Z", "run_id": "a", "status": "success", "hostname": "h"}
    (tmp_path / "1.json").write_text(json.dumps(record) + "\n" + json.dumps(record) + "\n")
    (tmp_path / "2.json").write_text(json.dumps(record) + "\n" + json.dumps({**record, "run_id": "b"}) + "\n")
    got, _ = run_available(inputs.stream_run_history(spark, str(tmp_path), maxFilesPerTrigger=1), "seen")
    assert sorted(r["run_id"] for r in got.collect()) == ["a", "b"]


def test_run_logs_stream(spark, tmp_path):
    (tmp_path / "h1").mkdir()
    (tmp_path / "h1" / "2026-01-01_00-00-00.log").write_text("2026/01/01 00:00:01.000002 hello\nno time\n")
    (tmp_path / "h1" / "2026-01-01.log").write_text("2026/01/01 00:00:01.000002 hello\n")
    got, _ = run_available(inputs.stream_run_logs(spark, str(tmp_path)), "lines")
    rows = {r["msg"]: r for r in got.collect()}
    assert set(rows) == {"hello", "no time"} and rows["hello"]["ts"] == T(2026, 1, 1, 0, 0, 1, 2)
    assert (rows["hello"]["host"], rows["hello"]["run_id"]) == ("h1", "2026-01-01_00-00-00")


def test_upserts_are_idempotent(spark, tmp_path):
    history = spark.createDataFrame([("h", "a", 1, "failed"), ("h", "a", 2, "failed"), ("h", "b", 3, "failed")],
                                    "host string, run_id string, ts int, status string")
    schema = "host string, run_id string, status string"
    frames = [spark.createDataFrame([("h", "a", "one"), ("h", "b", "one")], schema), spark.createDataFrame([("h", "a", "two")], schema)]
    folder = str(tmp_path / "changes")
    assert tables.current_history(spark, history, folder).count() == 3
    stream = arriving(spark, frames)
    for checkpoint in ("c1", "c2"):  # the second run repeats every batch
        tables.upsert_stream(stream, folder, str(tmp_path / checkpoint)).awaitTermination()
        now = tables.current_history(spark, history, folder)
        assert [tuple(r) for r in now.orderBy("ts").collect()] == [("h", "a", 1, "failed"), ("h", "a", 2, "two"), ("h", "b", 3, "one")]
    compacted = tables.compact_history(spark, history, folder, str(tmp_path / "compact"))
    assert compacted.where("status = 'two'").count() == 1


def test_a_line_without_time_makes_no_other_line_late(spark, tmp_path):
    for i, (host, text) in enumerate((("h1", "2026/01/05 00:00:01.000002 hello\nno time\n"),
                                      ("h2", "2026/01/04 23:00:01.000002 hello\n" * 10), ("h3", "2026/01/09 00:00:01.000002 end\n"))):
        (tmp_path / host).mkdir()
        path = tmp_path / host / "2026-01-01_00-00-00.log"
        path.write_text(text)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    lines = inputs.stream_run_logs(spark, str(tmp_path), late="2 hours", maxFilesPerTrigger=1)
    got, _ = run_available(windows.daily_log_rollup(lines), "days", passes=2)
    assert {(r["host"], r["lines"]) for r in got.collect()} == {("h1", 1), ("h2", 10)}


def test_the_last_record_of_a_run_comes_through(spark, tmp_path):
    record = {"timestamp": "2026-05-28T10:00:00Z", "run_id": "a", "status": "failed", "hostname": "h"}
    (tmp_path / "1.json").write_text(json.dumps(record) + "\n" + json.dumps({**record, "status": "success"}) + "\n")
    got, _ = run_available(inputs.stream_run_history(spark, str(tmp_path)), "seen")
    assert sorted(r["status"] for r in got.collect()) == ["failed", "success"]


def test_changes_after_a_compaction_only(spark, tmp_path):
    schema, folder = "host string, run_id string, status string", str(tmp_path / "changes")
    history = spark.createDataFrame([("h", "a", 1, "failed"), ("h", "b", 1, "failed")], "host string, run_id string, ts int, status string")

    def send(rows, checkpoint):
        stream = arriving(spark, [spark.createDataFrame(rows, schema)])
        tables.upsert_stream(stream, folder, str(tmp_path / checkpoint)).awaitTermination()

    send([("h", "a", "one")], "c1")
    target = str(tmp_path / "compact")
    compacted = tables.compact_history(spark, history, folder, target)
    edited = compacted.withColumn("status", F.when(F.col("run_id") == "a", "by hand").otherwise(F.col("status")))
    now = tables.current_history(spark, edited, folder, applied=target)
    assert {r["run_id"]: r["status"] for r in now.collect()} == {"a": "by hand", "b": "failed"}
    send([("h", "b", "two")], "c2")  # another stream, its first batch
    now = tables.current_history(spark, edited, folder, applied=target)
    assert {r["run_id"]: r["status"] for r in now.collect()} == {"a": "by hand", "b": "two"}


def test_progress_goes_on_from_its_state():
    rng = np.random.default_rng(4)
    kinds = np.array(["found", "processing", "starting", "completed", "upload", "other"], object)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        kind, total, current = kinds[rng.integers(0, 6, n)], rng.integers(0, 5, n), rng.integers(0, 4, n)
        db = np.array([f"db{i}" for i in rng.integers(0, 3, n)], object)
        whole, after = state.progress_values(kind, total, current, db, (0, 0, 0, None))
        parts, before, at = [], (0, 0, 0, None), 0
        while at < n:
            end = at + int(rng.integers(1, 7))
            out, before = state.progress_values(kind[at:end], total[at:end], current[at:end], db[at:end], before)
            parts.append(out)
            at = end
        assert pd.concat(parts, ignore_index=True).equals(whole) and before == after


def test_chunks_of_waiting_samples_keep_equal_times_together():
    frame = pd.DataFrame({"ts": pd.to_datetime([5, 3, 3, 3, 9, 1], unit="us"), "series": [0, 1, 0, 1, 0, 0],
                          "value": [1.0, 2.0, 3.0, 1.0, 5.0, 6.0]})
    waiting = state._Waiting(([7], [1], [4.0]), [frame[:2], frame[2:]], 0)
    waiting.__init__(waiting.kept, [], 1)
    assert [c[0].tolist() for c in waiting.chunks(2)] == [[1, 3, 3, 3], [5, 7], [9]]
    ts, series, value = next(waiting.chunks(9))
    times, points = state._held_values(ts, series, value, np.array([np.nan, 8.0]))
    assert times.tolist() == [1, 3, 5, 7, 9] and points.tolist() == [[6, 3, 1, 1, 5], [8, 2, 2, 4, 4]]


def test_late_lines_are_counted_once_after_any_number_of_batches(spark):
    day = T(2026, 3, 1, 12)
    def part(rows):
        return spark.createDataFrame([("h", run, ts, msg) for run, ts, msg in rows], "host string, run_id string, ts timestamp, msg string")
    late = [("r1", day + timedelta(minutes=i), "late failure reason: x") for i in range(10)]
    parts = [[("r1", day, "one"), ("r2", day, "two"), ("r2", None, "no time")], [("r3", day + timedelta(days=1, hours=1), "next day")],
             late[:4], late[4:], [("r3", day + timedelta(days=2), "after")]]
    path, folder, checkpoint = (work_path(spark, x) for x in ("late-lines", "late-totals", "late-checkpoint"))
    for number, rows in enumerate(parts):
        part(rows).coalesce(1).write.parquet(f"{path}/part={number}")
        stream = spark.readStream.schema(part([]).schema).option("recursiveFileLookup", True).parquet(path)
        windows.store_daily_lines(stream, folder, checkpoint).awaitTermination()
    found = {str(r.day): (r.lines, r.runs, r.failure_lines, r.late_lines) for r in windows.daily_totals(spark, folder).collect()}
    assert found == {"2026-03-01": (2, 2, 0, 10), "2026-03-02": (1, 1, 0, 0)}
    kept = spark.read.parquet(f"{folder}/late")
    assert kept.count() == 10 and set(kept.columns) >= {"host", "run_id", "ts", "msg"}
