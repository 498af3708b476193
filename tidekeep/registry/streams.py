"""Queries that run the streaming operators over files Spark writes from the tables."""

from pyspark.sql import functions as F

from tidekeep.operators import runs as run_ops
from tidekeep.registry.base import query
from tidekeep.registry.jobs import HISTORY_SQL, history_columns, run_records
from tidekeep.registry.runs import ROLLUP_SQL
from tidekeep.registry.signals import ALERTS_SQL, PROGRESS_SQL
from tidekeep.session import work_path
from tidekeep.sinks import files as sinks
from tidekeep.streaming import inputs, state, tables, windows
from tidekeep.streaming.run import run_available


def stream_of(data, frame, label):
    """Writes a frame to files and reads them as a stream."""
    path = work_path(data.spark, label)
    frame.write.parquet(path)
    return data.spark.readStream.schema(frame.schema).parquet(path)


def sample_stream(data):
    rows = data.view("samples").select("series_id", F.col("ts").cast("timestamp").alias("ts"), "metric",
                                       F.col("value").cast("double").alias("value"))
    return stream_of(data, rows, "samples")


@query("stream_run_history", ["runs"], HISTORY_SQL)
def _stream_run_history(data):
    path = work_path(data.spark, "history")
    sinks.append_run_history(run_records(data), path)
    sinks.append_run_history(run_records(data), path)
    rows, _ = run_available(inputs.stream_run_history(data.spark, path), "seen-runs")
    return history_columns(rows)


def log_stream(data):
    """Daily logs as a live source."""
    path = work_path(data.spark, "logs")
    lines = data.view("log_lines").withColumn("day", F.replace(F.substring("value", 1, 10), F.lit("/"), F.lit("-")))
    (lines.repartition("day").sortWithinPartitions("day", "line_no").select("day", "value")
     .write.partitionBy("day").text(path))
    return inputs.stream_run_logs(data.spark, path, name_filter="*.txt")


LOG_TIME = "strptime(left(value, 26), '%Y/%m/%d %H:%M:%S.%f')"


@query("stream_run_logs", ["log_lines"], f"""
SELECT {LOG_TIME} AS ts, substr(value, 28) AS msg FROM log_lines""")
def _stream_run_logs(data):
    rows, _ = run_available(log_stream(data), "lines")
    return rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "msg")


def plain_log_stream(data):
    lines = data.view("log_lines").select(
        (F.col("run_id") % 20).alias("host"), "run_id", "line_no",
        F.to_timestamp(F.substring("value", 1, 26), "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("ts"),
        F.substr("value", F.lit(28)).alias("msg"))
    return stream_of(data, lines, "lines").withWatermark("ts", "10 minutes")


@query("daily_log_rollup", ["log_lines"], f"""
, lined AS (SELECT run_id % 20 AS host, run_id, {LOG_TIME} AS ts, contains(value, 'permission denied') AS bad FROM log_lines)
SELECT host, strftime(ts, '%Y-%m-%d') AS day, count(*) AS lines, count(DISTINCT run_id) AS runs,
 sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS failure_lines FROM lined GROUP BY 1, 2
HAVING strptime(day, '%Y-%m-%d') + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM lined) - INTERVAL 10 MINUTE""")
def _daily_log_rollup(data):
    rows, _ = run_available(windows.daily_log_rollup(plain_log_stream(data)), "days")
    return rows.withColumn("day", F.col("day").cast("string"))


@query("daily_totals", ["log_lines"], f"""
, lined AS (SELECT run_id % 20 AS host, run_id, {LOG_TIME} AS ts, contains(value, 'permission denied') AS bad FROM log_lines)
SELECT host, strftime(ts, '%Y-%m-%d') AS day, count(*) AS lines, count(DISTINCT run_id) AS runs,
 sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS failure_lines, sum(CASE WHEN run_id % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS late_lines
FROM lined GROUP BY 1, 2
HAVING strptime(day, '%Y-%m-%d') + INTERVAL 1 DAY <= (SELECT max(ts) FROM lined) - INTERVAL 10 MINUTE""")
def _daily_totals(data):
    """All lines, then those of some runs once more, when most of their days are over."""
    spark, path, folder = data.spark, work_path(data.spark, "late-input"), work_path(data.spark, "daily")
    lines = data.view("log_lines").select(
        (F.col("run_id") % 20).alias("host"), "run_id",
        F.to_timestamp(F.substring("value", 1, 26), "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("ts"), F.substr("value", F.lit(28)).alias("msg"))
    checkpoint = work_path(spark, "daily-checkpoint")
    for number, part in enumerate((lines, lines.where("run_id % 10 = 0"))):
        part.write.parquet(f"{path}/part={number}")
        stream = spark.readStream.schema(lines.schema).option("recursiveFileLookup", True).parquet(path)
        windows.store_daily_lines(stream, folder, checkpoint).awaitTermination()
    return windows.daily_totals(spark, folder).withColumn("day", F.col("day").cast("string"))


@query("live_progress", ["log_lines"], PROGRESS_SQL)
def _live_progress(data):
    rows, _ = run_available(state.live_progress(plain_log_stream(data), order="line_no"), "progress")
    return rows.drop("host")


TICK_GAUGES = ["backup_last_status", "backup_run_in_progress", "backup_logical_last_status"]


@query("live_metric_snapshot", ["samples"], """
, ticks AS (SELECT *, time_bucket(INTERVAL 5 SECOND, ts) AS tick_start FROM samples)
SELECT series_id, tick_start, """ + ", ".join(
    f"arg_max(value, (ts, value)) FILTER (metric = '{name}')::DOUBLE AS {name}" for name in TICK_GAUGES) + """,
 coalesce(arg_max(value, (ts, value)) FILTER (metric = 'backup_run_in_progress') = 1, false) AS in_progress
FROM ticks GROUP BY series_id, tick_start
HAVING tick_start + INTERVAL 5 SECOND <= (SELECT date_trunc('milliseconds', max(ts)) FROM samples) - INTERVAL 10 SECOND""")
def _live_metric_snapshot(data):
    rows, _ = run_available(windows.live_metric_snapshot(sample_stream(data), "series_id", names=TICK_GAUGES), "ticks")
    return rows.select("series_id", F.col("tick_start").cast("timestamp_ntz").alias("tick_start"), *TICK_GAUGES, "in_progress")


@query("alert_stream", ["samples"], """
, passed AS (SELECT * FROM samples WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM samples) - INTERVAL 10 MINUTE)"""
       + ALERTS_SQL.replace("FROM samples GROUP", "FROM passed GROUP"))
def _alert_stream(data):
    rows, _ = run_available(state.alert_stream(sample_stream(data), keys=["series_id"]), "alerts")
    return rows.where("state = 'firing'").select(
        "series_id", "rule", "severity", F.col("started_at").cast("timestamp_ntz").alias("started_at"),
        F.col("at").cast("timestamp_ntz").alias("fired_at"))


@query("stale_series", ["samples"], """
, edge AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS ts FROM samples),
told AS (SELECT series_id, ts, last_value(CASE WHEN metric = 'backup_run_in_progress' THEN value END IGNORE NULLS) OVER w AS on_now,
 lead(ts) OVER w AS next_ts FROM samples WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series_id, ts AS last_update, ts + INTERVAL 2 MINUTE AS stale_at FROM told
WHERE on_now = 1 AND ts + INTERVAL 2 MINUTE < (SELECT ts FROM edge)
 AND coalesce(next_ts > ts + INTERVAL 2 MINUTE, true)""")
def _stale_series(data):
    rows, _ = run_available(state.stale_series(sample_stream(data), keys=["series_id"]), "stale")
    return rows.select("series_id", F.col("last_update").cast("timestamp_ntz").alias("last_update"),
                       F.col("stale_at").cast("timestamp_ntz").alias("stale_at"))


@query("upsert_stream", ["runs", "db_results"], f"""
, rollup AS ({ROLLUP_SQL})
SELECT host, run_id, ts, CASE WHEN databases_failed IS NULL THEN status WHEN databases_failed = 0 THEN 'success'
 ELSE 'failed' END AS status FROM runs LEFT JOIN rollup USING (run_id)""")
def _upsert_stream(data):
    runs = data.view("runs").select("host", "run_id", "ts", "status")
    changes = runs.select("host", "run_id").join(run_ops.run_rollup(data.view("db_results")), "run_id").select(
        "host", "run_id", F.when(F.col("databases_failed") == 0, "success").otherwise("failed").alias("status"))
    folder = work_path(data.spark, "changes")
    tables.upsert_stream(stream_of(data, changes, "change-input"), folder,
                         work_path(data.spark, "changes-checkpoint")).awaitTermination()
    return tables.current_history(data.spark, runs, folder)
