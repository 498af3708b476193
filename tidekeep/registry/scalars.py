"""Queries that apply the column functions to whole tables."""

from pyspark.sql import functions as F

from tidekeep.functions import durations, outcomes, progress, schedules, text
from tidekeep.operators.schedules import schedule_due
from tidekeep.registry.base import query

CATEGORY_SQL = """CASE WHEN error IS NULL THEN ''
 WHEN run_id % 101 = 0 THEN 'timeout'
 WHEN lower(error) LIKE '%access denied%' THEN 'auth' WHEN lower(error) LIKE '%no space left on device%' THEN 'disk'
 WHEN lower(error) LIKE '%references invalid table%' THEN 'view'
 WHEN lower(error) LIKE '%server has gone away%' THEN 'connect'
 WHEN lower(error) LIKE '%error 3024%' THEN 'timeout' WHEN lower(error) LIKE '%doesn''t exist%' THEN 'schema'
 ELSE 'command' END"""


def category():
    return outcomes.classify_failure(F.lit("dump"), "error", F.col("run_id") % 101 == 0)


@query("classify_failure", ["db_results"], f"""
SELECT run_id, name, size_bytes, {CATEGORY_SQL} AS category FROM db_results""")
def _classify_failure(data):
    return data.view("db_results").select("run_id", "name", "size_bytes", category().alias("category"))


@query("is_retryable", ["db_results"], f"""
SELECT run_id, name, size_bytes, {CATEGORY_SQL} NOT IN ('auth', 'disk', 'view', 'schema') AS retryable
FROM db_results""")
def _is_retryable(data):
    return data.view("db_results").select(
        "run_id", "name", "size_bytes", outcomes.is_retryable(category()).alias("retryable"))


@query("is_rate_limited", ["db_results"], """
SELECT run_id, name, size_bytes, coalesce(contains(lower(error), 'please reduce your request rate'), false) AS limited
FROM db_results""")
def _is_rate_limited(data):
    return data.view("db_results").select(
        "run_id", "name", "size_bytes", outcomes.is_rate_limited("error").alias("limited"))


@query("retry_delay", [], """
SELECT l_orderkey, l_linenumber, l_partkey, least(2 * pow(2.0, l_linenumber - 1), 20.0) AS delay FROM lineitem""")
def _retry_delay(data):
    return data.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", outcomes.retry_delay("l_linenumber").alias("delay"))


@query("parse_duration", ["runs"], r"""
SELECT run_id, CASE WHEN run_id % 19 = 0 THEN 0.0 ELSE
 CAST(regexp_extract(duration, '(\d+)m', 1) AS DOUBLE) * 60 + CAST(regexp_extract(duration, 'm([\d.]+)s', 1) AS DOUBLE)
 END AS seconds FROM runs""")
def _parse_duration(data):
    spoiled = F.when(F.col("run_id") % 19 == 0, F.concat("duration", F.lit(" later"))).otherwise(F.col("duration"))
    return data.view("runs").select("run_id", durations.parse_duration(spoiled).alias("seconds"))


@query("format_duration", ["runs"], """
SELECT run_id, CASE WHEN m >= 60 THEN m // 60 || 'h' || m % 60 || 'm' || s || '.5s'
 WHEN m > 0 THEN m || 'm' || s || '.5s' WHEN s > 0 THEN s || '.5s' ELSE '500ms' END AS text
FROM (SELECT run_id, run_id % 90 AS m, run_id % 60 AS s FROM runs)""")
def _format_duration(data):
    seconds = durations.parse_duration("duration")
    return data.view("runs").select("run_id", durations.format_duration(seconds).alias("text"))


@query("parse_run_id", ["runs"], """
SELECT run_id, CASE WHEN run_id % 9 <> 0 THEN date_trunc('second', ts) END AS at FROM runs""")
def _parse_run_id(data):
    name = F.concat(F.when(F.col("run_id") % 9 == 0, F.lit("tmp-")).otherwise(F.lit("")),
                    F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"))
    return data.view("runs").select("run_id", durations.parse_run_id(name).alias("at"))


@query("staging_name", [], """
SELECT p_partkey, 'test_restore_' || coalesce(nullif(left(trim(regexp_replace(lower(trim(p_type || ' ' || p_name)),
 '[^a-z0-9]', '_', 'g'), '_'), 42), ''), 'db') || '_' || lower(lpad(to_hex(list_reduce(list_prepend(2166136261::BIGINT,
 list_transform(range(1, length(p_type || ' ' || p_name) + 1),
  lambda i: ascii(substr(p_type || ' ' || p_name, i, 1))::BIGINT)),
 lambda h, b: (xor(h, b) * 16777619) & 4294967295)), 8, '0')) AS staging FROM part""")
def _staging_name(data):
    name = F.concat_ws(" ", "p_type", "p_name")
    return data.table("part").select("p_partkey", text.staging_name(name).alias("staging"))


@query("human_bytes", ["db_results"], """
, sized AS (SELECT run_id, name, size_bytes, size_bytes * size_bytes AS n FROM db_results),
scaled AS (SELECT *, CASE WHEN n < 1000 THEN 0 WHEN n < 1000000 THEN 1 WHEN n < 1000000000 THEN 2
  WHEN n < 1000000000000 THEN 3 ELSE 4 END AS e FROM sized),
tenths AS (SELECT *, CAST(floor(n / pow(1000.0, e) * 10 + 0.5) AS BIGINT) AS t FROM scaled)
SELECT run_id, name, size_bytes, CASE WHEN n < 10 THEN n || ' B'
 WHEN t < 100 THEN t // 10 || '.' || t % 10 || ' ' || ['B', 'kB', 'MB', 'GB', 'TB'][e + 1]
 ELSE CAST(round_even(t / 10.0, 0) AS BIGINT) || ' ' || ['B', 'kB', 'MB', 'GB', 'TB'][e + 1] END AS size FROM tenths""")
def _human_bytes(data):
    squared = F.col("size_bytes") * F.col("size_bytes")
    return data.view("db_results").select("run_id", "name", "size_bytes", text.human_bytes(squared).alias("size"))


@query("age_text", ["runs"], """
SELECT run_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago'
 ELSE (s + 180) // 360 // 10 || '.' || (s + 180) // 360 % 10 || 'h ago' END AS age
FROM (SELECT run_id, run_id * 7 % 100000 AS s FROM runs)""")
def _age_text(data):
    return data.view("runs").select("run_id", text.age_text(F.col("run_id") * 7 % 100000).alias("age"))


@query("label_string", [], """
SELECT c_custkey, 'job="' || CASE WHEN c_custkey % 3 = 0 THEN 'db_backup' ELSE c_name END || '",service="'
 || CASE WHEN c_custkey % 4 = 0 THEN 'mysql' ELSE 'pg "x"' END.replace('"', '\\"') || '",env="' || c_mktsegment || '"'
 || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',region="r' || c_nationkey || '"' END AS labels FROM customer""")
def _label_string(data):
    key = F.col("c_custkey")
    return data.table("customer").select("c_custkey", text.label_string(
        F.when(key % 3 == 0, F.lit("")).otherwise(F.col("c_name")),
        F.when(key % 4 == 0, F.lit(None)).otherwise(F.lit('pg "x"')),
        F.concat(F.lit("  "), F.col("c_mktsegment")),
        F.when(key % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("r"), F.col("c_nationkey").cast("string"))),
    ).alias("labels"))


@query("object_key", [], """
SELECT p_partkey, 'fleet/daily/' || p_partkey || '/' || replace(replace(replace(p_type, ' ', '%20'), '#', '%23'), ',', '%2C')
 || '/' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '+a%2Ab@c~d=e%28f%29.sql.gz' AS object_key FROM part""")
def _object_key(data):
    rel = F.concat(F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit("+a*b@c~d=e(f).sql.gz"))
    return data.table("part").select("p_partkey", text.object_key(
        F.lit(" /fleet/daily/ "), "p_partkey", rel).alias("object_key"))


SCOPE_SQL = """SELECT c_custkey, 'db' || c_custkey % 5 AS db, unnest(['t1', 'x' || c_nationkey]) AS table_name
FROM customer WHERE c_custkey % 5 <> c_custkey % 3
UNION ALL SELECT c_custkey, 'db' || c_custkey % 3, 'only' FROM customer"""


def scope_text():
    key = F.col("c_custkey")
    return F.concat(F.lit("db"), (key % 5).cast("string"), F.lit(": t1 ,, x"), F.col("c_nationkey").cast("string"),
                    F.lit(" ;;plain; :none;db"), (key % 3).cast("string"), F.lit(":only,"))


@query("parse_table_scope", [], SCOPE_SQL)
def _parse_table_scope(data):
    scopes = data.table("customer").select("c_custkey", F.explode(schedules.parse_table_scope(scope_text())).alias("db", "_t"))
    return scopes.select("c_custkey", "db", F.explode("_t").alias("table_name"))


@query("format_table_scope", [], """
SELECT c_custkey, CASE WHEN c_custkey % 5 = c_custkey % 3 THEN 'db' || c_custkey % 3 || ':only'
 WHEN c_custkey % 5 < c_custkey % 3 THEN 'db' || c_custkey % 5 || ':t1,x' || c_nationkey || ';db' || c_custkey % 3 || ':only'
 ELSE 'db' || c_custkey % 3 || ':only;db' || c_custkey % 5 || ':t1,x' || c_nationkey END AS scope FROM customer""")
def _format_table_scope(data):
    scope = schedules.format_table_scope(schedules.parse_table_scope(scope_text()))
    return data.table("customer").select("c_custkey", scope.alias("scope"))


@query("parse_schedule", ["due_cases"], """
SELECT case_id, CASE case_id % 6 WHEN 0 THEN 'daily' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'interval'
  WHEN 4 THEN 'always' ELSE 'disabled' END AS kind,
 CASE case_id % 6 WHEN 0 THEN '120' WHEN 1 THEN '120,600,1080' WHEN 2 THEN '120' END AS minutes,
 CASE case_id % 6 WHEN 2 THEN 0 END AS weekday, CASE case_id % 6 WHEN 3 THEN 21600.0::DOUBLE END AS interval_seconds,
 NULL::VARCHAR AS error FROM due_cases""")
def _parse_schedule(data):
    parsed = data.view("due_cases").select("case_id", schedules.parse_schedule("schedule").alias("p")).select("case_id", "p.*")
    return parsed.withColumn("minutes", F.array_join("minutes", ","))


JUDGED_SQL = """, slots AS (SELECT *, CASE case_id % 6 WHEN 0 THEN [2] WHEN 1 THEN [2, 10, 18] END AS hours,
  date_trunc('day', last_success) AS last_day, date_trunc('day', now) AS today FROM due_cases),
targets AS (SELECT *, CASE
  WHEN case_id % 6 IN (0, 1) AND last_success IS NULL THEN coalesce(
    list_max(list_filter(list_transform(hours, lambda h: today + to_hours(h)), lambda t: t <= now)), today + to_hours(hours[1]))
  WHEN case_id % 6 IN (0, 1) THEN list_min(list_filter(list_concat(
    list_transform(hours, lambda h: last_day + to_hours(h)),
    list_transform(hours, lambda h: last_day + INTERVAL 1 DAY + to_hours(h))), lambda t: t > last_success))
  WHEN case_id % 6 = 2 AND last_success IS NULL THEN today - to_days(dayofweek(now)::INTEGER) + INTERVAL 2 HOUR
  WHEN case_id % 6 = 2 THEN CASE WHEN last_day + to_days(((7 - dayofweek(last_success)) % 7)::INTEGER) + INTERVAL 2 HOUR > last_success
    THEN last_day + to_days(((7 - dayofweek(last_success)) % 7)::INTEGER) + INTERVAL 2 HOUR
    ELSE last_day + INTERVAL 7 DAY + INTERVAL 2 HOUR END
  WHEN case_id % 6 = 3 AND last_success IS NOT NULL THEN last_success + INTERVAL 6 HOUR END AS target FROM slots),
judged AS (SELECT case_id, schedule, last_success, target, CASE case_id % 6 WHEN 4 THEN true WHEN 5 THEN false
  ELSE coalesce(target <= now, true) END AS due, strftime(target, '%Y-%m-%dT%H:%M:%SZ') AS slot FROM targets)"""
DUE_SQL = JUDGED_SQL + """
SELECT case_id, due, target, CASE case_id % 6 WHEN 4 THEN 'schedule=always' WHEN 5 THEN 'schedule=disabled'
 ELSE 'schedule=' || schedule || CASE WHEN target IS NULL THEN ' first run'
  WHEN due AND case_id % 6 = 3 THEN ' due since ' || slot WHEN due THEN ' due at ' || slot
  WHEN last_success IS NULL THEN ' waiting until ' || slot ELSE ' next due at ' || slot END END AS reason FROM judged"""


@query("schedule_due", ["due_cases"], DUE_SQL)
def _schedule_due(data):
    return schedule_due(data.view("due_cases")).select("case_id", "due", "target", "reason")


EVENT_SQL = r""", parsed AS (SELECT run_id, line_no, value, CASE WHEN value LIKE '%found %' THEN 'found'
  WHEN value LIKE '%] processing %' THEN 'processing' WHEN value LIKE '%starting dump%' THEN 'starting'
  WHEN value LIKE '%completed dump%' THEN 'completed' END AS kind FROM log_lines),
events_of AS (SELECT run_id, line_no, kind,
 CASE kind WHEN 'found' THEN CAST(regexp_extract(value, 'found (\d+)', 1) AS BIGINT)
  WHEN 'processing' THEN CAST(regexp_extract(value, '/(\d+)\]', 1) AS BIGINT) END AS total,
 CASE kind WHEN 'processing' THEN CAST(regexp_extract(value, '\[(\d+)/', 1) AS BIGINT) END AS current,
 CASE kind WHEN 'processing' THEN regexp_extract(value, 'processing (\S+)', 1)
  WHEN 'starting' THEN regexp_extract(value, 'database=(\S+)', 1)
  WHEN 'completed' THEN regexp_extract(value, 'database=(\S+)', 1) END AS db FROM parsed)"""


@query("parse_progress_event", ["log_lines"], EVENT_SQL + "\nSELECT * FROM events_of")
def _parse_progress_event(data):
    return data.view("log_lines").select(
        "run_id", "line_no", progress.parse_progress_event("value").alias("e")).select("run_id", "line_no", "e.*")


@query("progress_percent", [], """
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN total <= 0 THEN 0.0 WHEN p > 0.99 AND completed < total THEN 0.99
 ELSE p END AS percent FROM (SELECT *, CASE WHEN current > completed
  THEN greatest(completed / total, (current - 1) / total + 0.35 / total) ELSE completed / total END AS p
 FROM (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_suppkey % 9 AS DOUBLE) AS total,
  CAST(l_linenumber AS DOUBLE) AS current, CAST(l_partkey % 9 AS DOUBLE) AS completed FROM lineitem))""")
def _progress_percent(data):
    return data.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", progress.progress_percent(
        F.col("l_suppkey") % 9, "l_linenumber", F.col("l_partkey") % 9).alias("percent"))


@query("extract_kv", ["log_lines"], r"""
SELECT run_id, line_no, key, regexp_extract(value, key || '=(\S+)', 1) AS value
FROM log_lines, (VALUES ('database'), ('output'), ('size_bytes')) AS k(key) WHERE contains(value, key || '=')""")
def _extract_kv(data):
    return data.view("log_lines").select("run_id", "line_no", F.explode(text.extract_kv("value")).alias("key", "value"))


@query("load_band", ["runs"], """
SELECT run_id, CASE WHEN load_per_cpu >= 1.5 THEN 'very-high-load reduction' WHEN load_per_cpu >= 1 THEN 'high-load reduction'
 WHEN load_per_cpu >= 0.75 THEN 'moderate-load reduction' WHEN load_per_cpu <= 0.1 THEN 'very-low-load boost'
 WHEN load_per_cpu <= 0.2 THEN 'low-load boost' WHEN load_per_cpu <= 0.35 THEN 'light-load boost'
 ELSE 'balanced' END AS band FROM runs""")
def _load_band(data):
    return data.view("runs").select("run_id", outcomes.load_band("load_per_cpu").alias("band"))


@query("scheduler_context", ["runs"], """
SELECT run_id, CASE WHEN execution_source = 'runner' AND os_user = 'root' THEN 'root scheduled runner (blocked)'
 WHEN execution_source = 'runner' THEN 'user-level scheduled runner'
 WHEN execution_source = 'tui' THEN 'interactive TUI/manual invocation' ELSE 'API-triggered invocation' END AS context
FROM runs""")
def _scheduler_context(data):
    return data.view("runs").select("run_id", outcomes.scheduler_context("os_user", "execution_source").alias("context"))


@query("threshold_band", ["runs"], """
SELECT run_id, CASE WHEN s > 1800 THEN 'red' WHEN s >= 900 THEN 'yellow' ELSE 'green' END AS duration_band,
 CASE WHEN s * 20 > 43200 THEN 'red' ELSE 'green' END AS success_band
FROM (SELECT run_id, (run_id % 90) * 60 + run_id % 60 + 0.5 AS s FROM runs)""")
def _threshold_band(data):
    seconds = durations.parse_duration("duration")
    return data.view("runs").select(
        "run_id", outcomes.threshold_band(F.lit("duration"), seconds).alias("duration_band"),
        outcomes.threshold_band(F.lit("success_age"), seconds * 20).alias("success_band"))


@query("status_label", ["samples"], """
SELECT sample_id, CASE WHEN metric = 'backup_last_status' THEN CASE value WHEN 0 THEN 'Failed/Partial' ELSE 'Success' END
 WHEN metric = 'backup_run_in_progress' THEN CASE value WHEN 0 THEN 'Idle' ELSE 'Running' END
 WHEN metric = 'backup_logical_last_status' THEN CASE value WHEN 0 THEN 'Failed' ELSE 'Success' END END AS label
FROM samples""")
def _status_label(data):
    return data.view("samples").select("sample_id", outcomes.status_label("metric", "value").alias("label"))


@query("has_end_marker", [], """
SELECT doc_id, doc_id % 3 = 0 AND 17 + doc_id % 400 <= 256 AS complete FROM documents""")
def _has_end_marker(data):
    ended = F.when(F.col("doc_id") % 3 == 0, F.concat(
        F.col("text"), F.lit("-- Dump completed"), F.repeat(F.lit("x"), (F.col("doc_id") % 400).cast("int"))))
    return data.table("documents").select("doc_id", text.has_end_marker(ended.otherwise(F.col("text"))).alias("complete"))
