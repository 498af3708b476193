"""Queries on gauges, alerts and logs."""

from pyspark.sql import functions as F

from tidekeep.operators import alerts, logs, metrics, runs
from tidekeep.registry.base import query
from tidekeep.registry.runs import ROLLUP_SQL
from tidekeep.registry.scalars import EVENT_SQL

SNAPSHOT_SQL = ", ".join(
    f"arg_max(value, (ts, sample_id)) FILTER (metric = '{name}') AS {name}" for name in metrics.NAMES)


@query("metric_snapshot", ["samples"], f"SELECT series_id, {SNAPSHOT_SQL} FROM samples GROUP BY series_id")
def _metric_snapshot(data):
    return metrics.metric_snapshot(data.view("samples"), "series_id", ("ts", "sample_id"))


@query("database_row_gauges", ["db_results"], """
SELECT run_id, 'backup_database_row_count' AS metric, name AS database, row_counts::DOUBLE AS value
FROM db_results WHERE row_counts > 0""")
def _database_row_gauges(data):
    gauges = metrics.database_row_gauges(data.view("db_results"))
    return gauges.select("run_id", "metric", F.col("labels")["database"].alias("database"), "value")


def finished_runs(data):
    """Run records with everything the gauges are made of."""
    base = runs.with_rollup(data.view("runs"), data.view("db_results"))
    base = base.join(runs.total_artifact_size(data.view("db_results")), "run_id", "left")
    return base.select(
        "host", "run_id", "ts", "duration", "cleanup_error", "size_bytes", "databases_total", "databases_succeeded",
        "databases_failed", F.expr("CASE WHEN load_per_cpu > 1.8 THEN 'skipped' ELSE status END AS status"),
        F.expr("CASE WHEN run_id % 2 = 0 THEN logical_upload_error IS NULL END AS uploaded"),
        F.expr("CASE run_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' END AS validation_status"),
        F.expr("CASE WHEN run_id % 3 = 0 THEN '' ELSE '/b/x' END AS run_folder"),
        (F.col("execution_source") != "api").alias("logical_due"), (F.col("run_id") % 4 == 0).alias("physical_due"),
        F.expr("""CASE WHEN run_id % 8 = 0 THEN named_struct('status', CASE WHEN run_id % 16 = 0 THEN 'success' ELSE 'failed' END,
            'duration', '1m30.5s', 'attempts', 2, 'rate_limit_retries', 1, 'xtrabackup_parallel', 3,
            'xbcloud_parallel', 0) END AS physical_backup"""),
        F.col("load_per_cpu").alias("adaptive_load_per_cpu"), F.lit(2).alias("adaptive_logical_parallel"),
        F.lit(4).alias("adaptive_physical_parallel"), F.lit(6).alias("adaptive_xbcloud_parallel"))


OWN_SQL = {
    "backup_last_run_timestamp": "floor(epoch(ts))",
    "backup_last_duration_seconds": "(run_id % 90) * 60 + run_id % 60 + 0.5",
    "backup_last_size_bytes": "coalesce(size_bytes, 0)",
    "backup_last_status": "CASE WHEN st = 'success' AND coalesce(uploaded, true) THEN 1 ELSE 0 END",
    "backup_upload_success": "CASE WHEN uploaded THEN 1 ELSE 0 END",
    "backup_metrics_write_success": "1",
    "backup_cleanup_success": "CASE WHEN cleanup_error IS NULL THEN 1 ELSE 0 END",
    "backup_logical_last_attempted": "CASE WHEN ld THEN 1 ELSE 0 END",
    "backup_logical_last_status": "CASE WHEN ld AND databases_failed = 0 THEN 1 ELSE 0 END",
    "backup_logical_last_total_databases": "CASE WHEN ld THEN databases_total ELSE 0 END",
    "backup_logical_last_succeeded_databases": "CASE WHEN ld THEN databases_succeeded ELSE 0 END",
    "backup_logical_last_failed_databases": "CASE WHEN ld THEN databases_failed ELSE 0 END",
    "backup_physical_last_attempted": "CASE WHEN run_id % 4 = 0 THEN 1 ELSE 0 END",
    "backup_physical_last_status": "CASE WHEN run_id % 16 = 0 THEN 1 ELSE 0 END",
    "backup_physical_last_duration_seconds": "CASE WHEN run_id % 8 = 0 THEN 90.5 ELSE 0 END",
    "backup_adaptive_load_per_cpu": "load_per_cpu",
    "backup_adaptive_logical_parallel": "2",
    "backup_adaptive_xtrabackup_parallel": "CASE WHEN run_id % 8 = 0 THEN 3 ELSE 4 END",
    "backup_adaptive_xbcloud_parallel": "6",
    "backup_physical_retry_count": "CASE WHEN run_id % 8 = 0 THEN 2 ELSE 0 END",
    "backup_physical_rate_limit_retry_count": "CASE WHEN run_id % 8 = 0 THEN 1 ELSE 0 END",
}
REST_SQL = {
    "backup_last_success_timestamp": """floor(epoch(max(CASE WHEN st = 'success' AND coalesce(uploaded, true) THEN ts END) OVER w))""",
    "backup_last_cleanup_timestamp": "floor(epoch(max(CASE WHEN st <> 'skipped' AND run_folder <> '' THEN ts END) OVER w))",
    "backup_metrics_last_update_timestamp": "floor(epoch(ts))",
    "backup_logical_validation_last_status": """coalesce(last_value(CASE run_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END
      IGNORE NULLS) OVER w, -1)""",
}


def _gauge_sql(name):
    if name in REST_SQL:
        return f"coalesce({REST_SQL[name]}, 0)::DOUBLE AS {name}"
    if name in OWN_SQL:
        own = f"CASE WHEN st <> 'skipped' THEN ({OWN_SQL[name]})::DOUBLE END"
        return f"coalesce(last_value({own} IGNORE NULLS) OVER w, 0)::DOUBLE AS {name}"
    return f"0::DOUBLE AS {name}"


SAMPLES_SQL = f"""
, rollup AS ({ROLLUP_SQL}), sizes AS (SELECT run_id, sum(size_bytes)::BIGINT AS size_bytes FROM db_results GROUP BY run_id),
told AS (SELECT r.*, size_bytes, coalesce(databases_total, 0) AS databases_total,
  coalesce(databases_succeeded, 0) AS databases_succeeded, coalesce(databases_failed, 0) AS databases_failed,
  CASE WHEN load_per_cpu > 1.8 THEN 'skipped' ELSE status END AS st, execution_source <> 'api' AS ld,
  CASE WHEN run_id % 2 = 0 THEN logical_upload_error IS NULL END AS uploaded,
  CASE WHEN run_id % 3 = 0 THEN '' ELSE '/b/x' END AS run_folder
 FROM runs r LEFT JOIN rollup USING (run_id) LEFT JOIN sizes USING (run_id)),
wide AS (SELECT host, run_id, ts, {", ".join(map(_gauge_sql, metrics.NAMES))} FROM told
 WINDOW w AS (PARTITION BY host ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT host, run_id, ts, metric, value FROM (UNPIVOT wide ON {", ".join(metrics.NAMES)} INTO NAME metric VALUE value)"""


@query("run_to_samples", ["runs", "db_results"], SAMPLES_SQL)
def _run_to_samples(data):
    return metrics.run_to_samples(finished_runs(data))


ALERT_METRICS = ["backup_last_status", "backup_logical_last_attempted", "backup_logical_last_status",
                 "backup_last_success_timestamp", "backup_run_in_progress"]
ALERTS_SQL = f""", points AS (SELECT series_id, ts, {", ".join(
    f"arg_max(value, sample_id) FILTER (metric = '{m}') AS {m}" for m in ALERT_METRICS)} FROM samples GROUP BY series_id, ts),
state AS (SELECT series_id, ts, {", ".join(
    f"last_value({m} IGNORE NULLS) OVER w AS {m}" for m in ALERT_METRICS)} FROM points
 WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
judged AS (
 SELECT series_id, ts, 'backup_failed_overall' AS rule, 'critical' AS severity, 300 AS hold,
  coalesce(backup_last_status = 0, false) AS c FROM state
 UNION ALL SELECT series_id, ts, 'logical_backup_failed', 'critical', 300,
  coalesce(backup_logical_last_attempted = 1 AND backup_logical_last_status = 0, false) FROM state
 UNION ALL SELECT series_id, ts, 'no_recent_success', 'critical', 900,
  coalesce(epoch(ts) - backup_last_success_timestamp > 43200, false) FROM state),
islands AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY rule, series_id ORDER BY ts) AS island FROM judged),
spells AS (SELECT *, min(ts) OVER (PARTITION BY rule, series_id, island) AS started_at FROM islands WHERE c)
SELECT series_id, rule, severity, started_at, min(ts) AS fired_at FROM spells
WHERE epoch(ts) - epoch(started_at) >= hold GROUP BY ALL"""


@query("alert_firing", ["samples"], ALERTS_SQL)
def _alert_firing(data):
    return alerts.alert_firing(data.view("samples"), keys=["series_id"], tie="sample_id")


@query("alert_conditions", ["samples"], f"""
, latest AS (SELECT series_id, max(ts) AS ts, {SNAPSHOT_SQL} FROM samples GROUP BY series_id)
SELECT series_id, 'backup_failed_overall' AS rule FROM latest WHERE backup_last_status = 0
UNION ALL SELECT series_id, 'logical_backup_failed' FROM latest
 WHERE backup_logical_last_attempted = 1 AND backup_logical_last_status = 0
UNION ALL SELECT series_id, 'no_recent_success' FROM latest WHERE epoch(ts) - backup_last_success_timestamp > 43200""")
def _alert_conditions(data):
    samples = data.view("samples")
    wide = metrics.metric_snapshot(samples, "series_id", ("ts", "sample_id")).join(
        samples.groupBy("series_id").agg(F.max("ts").alias("ts")), "series_id")
    rules = alerts.alert_rules()
    met = alerts.rule_conditions(rules, "", alerts.seconds("ts"))
    names = F.array(*[F.when(met[r.name], F.lit(r.name)) for r in rules])
    return wide.select("series_id", F.explode(F.array_compact(names)).alias("rule"))


@query("vector_and", ["samples"], """
SELECT a.sample_id, a.series_id, a.ts, a.value FROM samples a
WHERE a.metric = 'backup_logical_last_attempted' AND a.value = 1 AND EXISTS (SELECT 1 FROM samples b
 WHERE b.metric = 'backup_logical_last_status' AND b.value = 0 AND a.series_id = b.series_id
  AND date_trunc('day', a.ts) = date_trunc('day', b.ts))""")
def _vector_and(data):
    rows = data.view("samples").withColumns({
        "labels": F.create_map(F.lit("series"), F.col("series_id").cast("string"), F.lit("env"), F.lit("pilot")),
        "day": F.date_trunc("day", "ts")})
    left = rows.where("metric = 'backup_logical_last_attempted' AND value = 1")
    right = rows.where("metric = 'backup_logical_last_status' AND value = 0")
    return alerts.vector_and(left, right, ("labels", "day")).select("sample_id", "series_id", "ts", "value")


@query("tail_lines", ["log_lines"], """
SELECT run_id, line_no, value, count(*) OVER (PARTITION BY run_id) AS total_lines FROM log_lines
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) <= 10""")
def _tail_lines(data):
    return logs.tail_lines(data.view("log_lines"), 10)


@query("stream_error_summary", ["tool_lines"], """
SELECT run_id, tool, coalesce(
 arg_max(trim(line), line_no) FILTER (lower(line) LIKE '%no space left%' OR lower(line) LIKE '%errno 28%'),
 arg_max(trim(line), line_no) FILTER (trim(line) <> '')) AS summary FROM tool_lines GROUP BY run_id, tool""")
def _stream_error_summary(data):
    return logs.stream_error_summary(data.view("tool_lines"))


# The fold as recursion: the lines of a run, numbered without gaps, one after the other.
PROGRESS_SQL = EVENT_SQL + """, steps AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS step
 FROM events_of WHERE kind IS NOT NULL),
fold AS (
 SELECT DISTINCT run_id, 0::BIGINT AS step, NULL::BIGINT AS line_no, 0::BIGINT AS total, 0::BIGINT AS current,
  0::BIGINT AS completed, NULL::VARCHAR AS current_db, NULL::VARCHAR AS stage FROM steps
 UNION ALL
 SELECT s.run_id, s.step, s.line_no,
  CASE WHEN s.kind = 'found' OR (s.kind = 'processing' AND s.total > 0) THEN s.total ELSE f.total END,
  CASE s.kind WHEN 'processing' THEN CASE WHEN s.current > 0 THEN s.current ELSE f.current END
   WHEN 'starting' THEN CASE WHEN f.total > 0 THEN least(f.completed + 1, f.total) ELSE f.completed + 1 END
   WHEN 'completed' THEN greatest(f.current, CASE WHEN f.total > 0 THEN least(f.completed + 1, f.total) ELSE f.completed + 1 END)
   ELSE f.current END,
  CASE WHEN s.kind <> 'completed' THEN f.completed WHEN f.total > 0 THEN least(f.completed + 1, f.total) ELSE f.completed + 1 END,
  CASE WHEN s.kind IN ('processing', 'starting') THEN s.db ELSE f.current_db END,
  CASE s.kind WHEN 'found' THEN 'discovered databases' WHEN 'processing' THEN 'processing ' || s.db
   WHEN 'starting' THEN 'dumping ' || s.db WHEN 'completed' THEN 'completed ' || s.db ELSE f.stage END
 FROM fold f JOIN steps s ON s.run_id = f.run_id AND s.step = f.step + 1)
SELECT run_id, line_no, total, current, completed, current_db, stage, CASE WHEN total <= 0 THEN 0.0::DOUBLE
 WHEN p > 0.99 AND completed < total THEN 0.99 ELSE p END AS percent
FROM (SELECT *, CASE WHEN current > completed THEN greatest(completed / total, (current - 1) / total + 0.35::DOUBLE / total)
 ELSE completed / total END AS p FROM fold WHERE step > 0)"""


@query("progress_timeline", ["log_lines"], PROGRESS_SQL)
def _progress_timeline(data):
    return logs.progress_timeline(data.view("log_lines"), ["run_id"], msg="value")
