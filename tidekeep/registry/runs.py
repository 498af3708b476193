"""Queries on runs, results, attempts, retention and history."""

from pyspark.sql import functions as F

from tidekeep.operators import retention, runs as op
from tidekeep.registry.base import query
from tidekeep.session import work_path
from tidekeep.sinks import buckets

OUTCOME_SQL = """CASE
  WHEN coalesce(trim(failure_reason), '') <> '' THEN failure_reason
  WHEN coalesce(trim(logical_upload_error), '') <> '' THEN 'logical upload failed: ' || logical_upload_error
  WHEN coalesce(trim(cleanup_error), '') <> '' AND status = 'success'
    THEN 'backup completed with cleanup issue: ' || cleanup_error
  WHEN coalesce(trim(cleanup_error), '') <> '' THEN 'cleanup issue: ' || cleanup_error
  WHEN status IN ('partial', 'failed') AND databases_failed > 0 AND databases_total > 0
    THEN databases_failed || ' of ' || databases_total || ' database backups failed'
  WHEN status = 'partial' THEN 'backup completed partially'
  WHEN status = 'failed' AND databases_total = 0 THEN 'backup failed before any database finished'
  WHEN status = 'failed' THEN 'backup failed' ELSE '' END"""

ROLLUP_SQL = """SELECT run_id, count(*) AS databases_total,
  sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END)::BIGINT AS databases_succeeded,
  sum(CASE WHEN status = 'success' THEN 0 ELSE 1 END)::BIGINT AS databases_failed
FROM db_results GROUP BY run_id"""

COUNTED_SQL = f""", rollup AS ({ROLLUP_SQL}),
counted AS (SELECT r.*, coalesce(databases_total, 0) AS databases_total,
  coalesce(databases_succeeded, 0) AS databases_succeeded, coalesce(databases_failed, 0) AS databases_failed
 FROM runs r LEFT JOIN rollup USING (run_id))"""

STATUS_SQL = COUNTED_SQL + """, graded AS (SELECT * EXCLUDE (status, failure_reason),
  CASE WHEN databases_failed = 0 AND coalesce(failure_reason, '') = '' THEN 'success'
       WHEN databases_succeeded > 0 THEN 'partial' ELSE 'failed' END AS status,
  CASE WHEN coalesce(failure_reason, '') <> '' THEN failure_reason
       WHEN databases_failed > 0 THEN databases_failed || ' of ' || databases_total || ' database backups failed'
       ELSE '' END AS failure_reason
 FROM counted)"""

VIEW_COLUMNS = ["host", "run_id", "ts", "status", "failure_reason", "databases_total",
                "databases_succeeded", "databases_failed", "final_outcome"]


def graded_runs(data):
    return op.run_status(op.with_rollup(data.view("runs"), data.view("db_results")))


@query("run_view", ["runs", "db_results"], STATUS_SQL + f"""
SELECT host, run_id, ts, status, failure_reason, databases_total, databases_succeeded, databases_failed,
 {OUTCOME_SQL} AS final_outcome FROM graded""")
def _run_view(data):
    return op.run_view(graded_runs(data)).select(*VIEW_COLUMNS)


@query("final_outcome", ["runs", "db_results"], COUNTED_SQL + f"""
SELECT run_id, {OUTCOME_SQL} AS final_outcome FROM counted""")
def _final_outcome(data):
    runs = op.with_rollup(data.view("runs"), data.view("db_results"))
    return op.run_view(runs).select("run_id", "final_outcome")


@query("run_rollup", ["db_results"], ROLLUP_SQL)
def _run_rollup(data):
    return op.run_rollup(data.view("db_results"))


@query("run_status", ["runs", "db_results"], STATUS_SQL + """
SELECT run_id, CASE WHEN logical_upload_error IS NOT NULL AND status = 'success' THEN 'failed' ELSE status END AS status,
 CASE WHEN logical_upload_error IS NOT NULL AND failure_reason = ''
  THEN 'logical backup upload failed: ' || logical_upload_error ELSE failure_reason END AS failure_reason
FROM graded""")
def _run_status(data):
    return op.apply_upload_failure(graded_runs(data)).select("run_id", "status", "failure_reason")


@query("explode_results", [], """
SELECT l_orderkey * 10 + l_linenumber AS run_id, position, CASE position WHEN 0 THEN 'main' ELSE 'audit' END AS name,
 CASE WHEN position = 0 AND l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status,
 CAST(floor(l_extendedprice) AS BIGINT) * (position + 1) AS size_bytes
FROM lineitem, (VALUES (0), (1)) AS two(position)""")
def _explode_results(data):
    size = F.floor("l_extendedprice").cast("bigint")
    result = [F.struct(F.lit(name).alias("name"), status.alias("status"), (size * factor).alias("size_bytes"))
              for name, status, factor in [
                  ("main", F.when(F.col("l_returnflag") == "R", "failed").otherwise("success"), 1),
                  ("audit", F.lit("success"), 2)]]
    runs = data.table("lineitem").select(
        F.lit("h").alias("host"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"),
        F.array(*result).alias("results"))
    return op.explode_results(runs).drop("host")


@query("total_artifact_size", ["db_results"], """
SELECT run_id, coalesce(sum(CASE WHEN size_bytes > 0 THEN size_bytes END), 0)::BIGINT AS size_bytes
FROM db_results GROUP BY run_id""")
def _total_artifact_size(data):
    return op.total_artifact_size(data.view("db_results"))


@query("folder_size", ["file_inventory"], """
SELECT host, run_id, coalesce(sum(CASE WHEN NOT is_dir THEN size END), 0)::BIGINT AS bytes
FROM file_inventory GROUP BY host, run_id""")
def _folder_size(data):
    return op.folder_size(data.view("file_inventory"))


@query("latest_run", ["runs"], """
SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, run_id DESC) = 1""")
def _latest_run(data):
    return op.latest_run(data.view("runs"))


@query("run_by_id", ["runs"], "SELECT * FROM runs WHERE run_id = 7")
def _run_by_id(data):
    return op.run_by_id(data.view("runs"), 7)


@query("recent_runs", ["runs"], """
SELECT host, run_id, ts, status, row_number() OVER (PARTITION BY host ORDER BY ts DESC, run_id DESC) AS place
FROM runs QUALIFY place <= 10""")
def _recent_runs(data):
    return op.recent_runs(data.view("runs").select("host", "run_id", "ts", "status"), 10)


@query("history_view", ["runs", "db_results"], COUNTED_SQL + """
SELECT host, strftime(ts, '%Y-%m-%d %H:%M') AS time, status,
 databases_succeeded || '/' || databases_total AS dbs, duration, run_id FROM counted""")
def _history_view(data):
    return op.history_view(op.with_rollup(data.view("runs"), data.view("db_results")))


@query("policy_violations", ["runs"], """
SELECT host, run_id, ts FROM runs WHERE os_user = 'root' AND execution_source = 'runner'""")
def _policy_violations(data):
    return op.policy_violations(data.view("runs")).select("host", "run_id", "ts")


@query("hosts_with_several_users", ["runs"], """
SELECT host, count(DISTINCT os_user) AS users, count(*) AS runs FROM runs GROUP BY host HAVING users > 1""")
def _several_users(data):
    return op.hosts_with_several_users(data.view("runs"))


NUMBERED_SQL = """, numbered AS (SELECT *, row_number() OVER
  (PARTITION BY run_id, name ORDER BY attempt_key, status, error NULLS FIRST) AS attempt FROM attempts)"""


@query("final_attempt", ["attempts"], NUMBERED_SQL + """
SELECT run_id, name, attempt, status, error, count(*) OVER (PARTITION BY run_id, name) AS attempts
FROM numbered QUALIFY row_number() OVER
 (PARTITION BY run_id, name ORDER BY status = 'success' DESC, attempt DESC) = 1""")
def _final_attempt(data):
    return op.final_attempt(op.number_attempts(data.view("attempts")))


@query("attempt_rollup", ["attempts"], NUMBERED_SQL + """
SELECT run_id, name, max(attempt) AS attempts, sum(CASE WHEN status <> 'success' AND attempt < 3
  AND error = 'Please reduce your request rate' THEN 1 ELSE 0 END)::BIGINT AS rate_limit_retries
FROM numbered GROUP BY run_id, name""")
def _attempt_rollup(data):
    return op.attempt_rollup(op.number_attempts(data.view("attempts")), allowed=3)


VALIDATIONS_SQL = """, validations AS (SELECT run_id, checked_at AS validation_checked_at,
  CASE WHEN valid THEN 'success' ELSE 'failed' END AS validation_status, position, coalesce(error, '') AS error
 FROM db_validations)"""


def validations(data):
    return data.view("db_validations").select(
        "run_id", F.col("checked_at").alias("validation_checked_at"), "position",
        F.when(F.col("valid"), "success").otherwise("failed").alias("validation_status"),
        F.coalesce("error", F.lit("")).alias("error"))


@query("runs_with_validation", ["runs", "db_validations"], VALIDATIONS_SQL + """,
latest AS (SELECT * FROM validations QUALIFY row_number() OVER (PARTITION BY run_id
  ORDER BY validation_checked_at DESC, position DESC, validation_status DESC, error DESC) = 1)
SELECT r.run_id, r.status, validation_checked_at, validation_status FROM runs r LEFT JOIN latest USING (run_id)""")
def _runs_with_validation(data):
    order = ["validation_checked_at", "position", "validation_status", "error"]
    joined = op.runs_with_validation(data.view("runs"), validations(data), order=order)
    return joined.select("run_id", "status", "validation_checked_at", "validation_status")


UPSERT_SQL = f"""
, rollup AS ({ROLLUP_SQL}), history AS (SELECT host, run_id, ts, status, cleanup_error FROM runs
  UNION ALL SELECT host, run_id, ts - INTERVAL 1 HOUR, 'failed', NULL FROM runs WHERE status = 'partial'),
changes AS (SELECT host, run_id, CASE WHEN databases_failed = 0 THEN 'success' ELSE 'failed' END AS status,
  databases_failed || ' bad' AS cleanup_error FROM runs JOIN rollup USING (run_id))
SELECT h.host, h.run_id, h.ts, CASE WHEN c.run_id IS NOT NULL THEN c.status ELSE h.status END AS status,
 CASE WHEN c.run_id IS NOT NULL THEN c.cleanup_error ELSE h.cleanup_error END AS cleanup_error
FROM (SELECT *, row_number() OVER (PARTITION BY host, run_id ORDER BY ts DESC) AS age FROM history) h
LEFT JOIN changes c ON h.host = c.host AND h.run_id = c.run_id AND h.age = 1"""


def history_and_changes(data):
    runs = data.view("runs").select("host", "run_id", "ts", "status", "cleanup_error")
    earlier = runs.where(F.col("status") == "partial").select(
        "host", "run_id", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit("failed").alias("status"),
        F.lit(None).cast("string").alias("cleanup_error"))
    rollup = op.run_rollup(data.view("db_results"))
    changes = runs.select("host", "run_id").join(rollup, "run_id").select(
        "host", "run_id", F.when(F.col("databases_failed") == 0, "success").otherwise("failed").alias("status"),
        F.concat(F.col("databases_failed").cast("string"), F.lit(" bad")).alias("cleanup_error"))
    return runs.unionByName(earlier), changes


@query("upsert_run_history", ["runs", "db_results"], UPSERT_SQL)
def _upsert_run_history(data):
    return op.upsert_run_history(*history_and_changes(data))


@query("bucketed_history", ["runs", "db_results"], UPSERT_SQL)
def _bucketed_history(data):
    """Stored in buckets, updated there, and read back by the manifest."""
    (history, changes), root = history_and_changes(data), work_path(data.spark, "bucketed")
    buckets.write_buckets(history, root, buckets=64)
    buckets.update_buckets(changes, root)
    return buckets.read_buckets(data.spark, root)


CARRY_SQL = """, told AS (SELECT host, run_id, ts, CASE WHEN load_per_cpu > 1.8 THEN 'skipped' ELSE status END AS status,
  CASE run_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' END AS validation_status,
  CASE WHEN run_id % 3 = 0 THEN '' ELSE '/b/x' END AS run_folder FROM runs)"""


def told_runs(data):
    return data.view("runs").select(
        "host", "run_id", "ts", F.expr("CASE WHEN load_per_cpu > 1.8 THEN 'skipped' ELSE status END AS status"),
        F.expr("CASE run_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' END AS validation_status"),
        F.expr("CASE WHEN run_id % 3 = 0 THEN '' ELSE '/b/x' END AS run_folder"))


@query("carry_forward", ["runs"], CARRY_SQL + """
SELECT host, run_id, ts, status,
 max(CASE WHEN status = 'success' THEN ts END) OVER upto AS last_success,
 max(CASE WHEN status <> 'skipped' AND run_folder <> '' THEN ts END) OVER upto AS last_cleanup,
 coalesce(last_value(CASE validation_status WHEN 'success' THEN 1 WHEN 'failed' THEN 0 END IGNORE NULLS) OVER upto, -1)
  AS validation_gauge,
 last_value(CASE WHEN status <> 'skipped' THEN run_id END IGNORE NULLS) OVER upto AS snapshot_run
FROM told WINDOW upto AS (PARTITION BY host ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _carry_forward(data):
    return op.carry_forward(told_runs(data)).drop("validation_status", "run_folder")


@query("run_age", ["runs"], CARRY_SQL + """
SELECT host, CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(CASE WHEN status <> 'skipped' THEN ts END))) AS BIGINT) AS run_age,
 CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(CASE WHEN status = 'success' THEN ts END))) AS BIGINT) AS success_age,
 CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(CASE WHEN status <> 'skipped' AND run_folder <> '' THEN ts END))) AS BIGINT) AS cleanup_age,
 CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts))) AS BIGINT) AS metrics_update_age
FROM told GROUP BY host""")
def _run_age(data):
    return op.run_age(told_runs(data), F.lit("2030-01-01 00:00:00").cast("timestamp"))


TIERS_SQL = """, ranked AS (SELECT host, run_id, ts,
  row_number() OVER (PARTITION BY host, ts::DATE ORDER BY ts DESC, run_id DESC) = 1 AS d1,
  dense_rank() OVER (PARTITION BY host ORDER BY ts::DATE DESC) AS d2,
  row_number() OVER (PARTITION BY host, isoyear(ts), weekofyear(ts) ORDER BY ts DESC, run_id DESC) = 1 AS w1,
  dense_rank() OVER (PARTITION BY host ORDER BY isoyear(ts) DESC, weekofyear(ts) DESC) AS w2,
  row_number() OVER (PARTITION BY host, year(ts), month(ts) ORDER BY ts DESC, run_id DESC) = 1 AS m1,
  dense_rank() OVER (PARTITION BY host ORDER BY year(ts) DESC, month(ts) DESC) AS m2
 FROM runs), flagged AS (SELECT host, run_id, ts, d1 AND d2 <= 7 AS keep_daily, w1 AND w2 <= 4 AS keep_weekly,
  m1 AND m2 <= 12 AS keep_monthly FROM ranked)"""


@query("gfs_retention", ["runs"], TIERS_SQL + """
SELECT *, keep_daily OR keep_weekly OR keep_monthly AS keep FROM flagged""")
def _gfs_retention(data):
    return retention.gfs_retention(data.view("runs").select("host", "run_id", "ts"))


@query("kept_runs", ["runs"], TIERS_SQL + """
SELECT host, run_id, keep_daily, keep_weekly, keep_monthly FROM flagged
WHERE keep_daily OR keep_weekly OR keep_monthly""")
def _kept_runs(data):
    return retention.kept_runs(data.view("runs"))


@query("expired_runs", ["runs"], TIERS_SQL + """
SELECT host, run_id, ts FROM flagged WHERE NOT (keep_daily OR keep_weekly OR keep_monthly)""")
def _expired_runs(data):
    runs = data.view("runs").select("host", "run_id", "ts")
    return retention.expired_runs(runs, retention.kept_runs(runs))
