"""Queries on the composed jobs, and on sources and sinks through files Spark writes from the tables."""

import os
import re
from datetime import datetime

from pyspark.sql import functions as F

from tidekeep import fixtures
from tidekeep.operators import logs, profile, retention, runs as run_ops, verify
from tidekeep.operators.metrics import NAMES
from tidekeep.plans import jobs
from tidekeep.registry.base import query
from tidekeep.registry.catalog import KEYS, sample_sql
from tidekeep.registry.runs import STATUS_SQL, OUTCOME_SQL, TIERS_SQL, graded_runs
from tidekeep.registry.scalars import JUDGED_SQL
from tidekeep.registry.signals import ALERTS_SQL
from tidekeep.session import work_path
from tidekeep.sinks import files as sinks
from tidekeep.sources import files as sources
from tidekeep.sources.artifacts import artifact_digests, list_folders
from tidekeep.sources.ownership import read_entries
from tidekeep.sources.statistics import declare_key, table_statistics
from tidekeep.sources.tables import TableSource, discover_tables, scan_tables

@query("apply_retention", ["runs"], """
, named AS (SELECT host, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS run_id, date_trunc('second', min(ts)) AS ts
 FROM runs GROUP BY 1, 2)""" + TIERS_SQL.replace("FROM runs", "FROM named") + """
SELECT host, run_id, ts, keep_daily, keep_weekly, keep_monthly, keep_daily OR keep_weekly OR keep_monthly AS keep FROM flagged""")
def _apply_retention(data):
    runs = data.view("runs").select("host", F.date_format("ts", "yyyy-MM-dd_HH-mm-ss").alias("run_id")).distinct()
    other = data.table("region").select(F.lit("host-1").alias("host"), F.col("r_name").alias("run_id"))
    return jobs.apply_retention(runs.unionByName(other))


@query("due_report", ["due_cases"], JUDGED_SQL + """
SELECT 'h' || case_id AS host, 'logical' AS kind, schedule, case_id % 10 <> 0 AND due AS due, target,
 CASE WHEN case_id % 10 = 0 THEN 'disabled' WHEN case_id % 6 = 4 THEN 'schedule=always'
  WHEN case_id % 6 = 5 THEN 'schedule=disabled'
  ELSE 'schedule=' || schedule || CASE WHEN target IS NULL THEN ' first run'
   WHEN due AND case_id % 6 = 3 THEN ' due since ' || slot WHEN due THEN ' due at ' || slot
   WHEN last_success IS NULL THEN ' waiting until ' || slot ELSE ' next due at ' || slot END END AS reason, NULL::VARCHAR AS error
FROM judged UNION ALL
SELECT 'h' || case_id, 'physical', 'always', true, NULL, 'schedule=always', NULL FROM judged""")
def _due_report(data):
    cases = data.view("due_cases").withColumn("host", F.concat(F.lit("h"), F.col("case_id").cast("string")))
    state = cases.select("host", F.lit("logical").alias("kind"), "last_success", F.col("now").alias("_at"))
    settings = cases.select("host", F.inline(F.array(
        F.struct(F.lit("BACKUP_LOGICAL_SCHEDULE").alias("key"), F.col("schedule").alias("value")),
        F.struct(F.lit("BACKUP_LOGICAL_ENABLED").alias("key"),
                 F.when(F.col("case_id") % 10 == 0, "false").otherwise("true").alias("value")))))
    return jobs.due_report(state, settings, F.col("_at"))


HEALTH_SQL = STATUS_SQL + f""", newest AS (SELECT * FROM graded
 QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, run_id DESC) = 1),
viewed AS (SELECT *, {OUTCOME_SQL} AS final_outcome FROM newest),
ages AS (SELECT host, CAST(epoch(TIMESTAMP '2002-01-01') - floor(epoch(max(ts))) AS BIGINT) AS run_age,
  CAST(epoch(TIMESTAMP '2002-01-01') - floor(epoch(max(CASE WHEN status = 'success' THEN ts END))) AS BIGINT) AS success_age
 FROM graded GROUP BY host),
drift AS (SELECT host, root, rel_path, uid, row_number() OVER (PARTITION BY host, root
  ORDER BY string_split(rel_path, '/'), uid) AS place
 FROM (SELECT DISTINCT host, root, rel_path, uid FROM file_inventory)
 WHERE uid <> 1000 AND len(string_split(rel_path, '/')) - 1 <= 2 QUALIFY place <= 5)
SELECT host, 'latest_run' AS check, CASE status WHEN 'success' THEN 'ok' WHEN 'partial' THEN 'warn' ELSE 'error' END AS status,
 run_id || ' ' || status || CASE WHEN final_outcome <> '' THEN ' ' || final_outcome ELSE '' END AS message FROM viewed
UNION ALL SELECT host, 'run_age', CASE WHEN run_age > 43200 THEN 'error' WHEN run_age >= 28800 THEN 'warn' ELSE 'ok' END,
 run_age || 's' FROM ages
UNION ALL SELECT host, 'success_age', CASE WHEN success_age > 43200 THEN 'error' ELSE 'ok' END, success_age || 's' FROM ages
UNION ALL SELECT host, 'ownership ' || root, 'warn', 'ownership drift detected relative to uid=1000: ' ||
 string_agg(rel_path || '(uid=' || uid || ')', ', ' ORDER BY place) FROM drift GROUP BY host, root"""


@query("fleet_health", ["runs", "db_results", "file_inventory"], HEALTH_SQL)
def _fleet_health(data):
    files = data.view("file_inventory").select("host", "root", "rel_path", "uid").distinct()
    return jobs.fleet_health(graded_runs(data), F.lit("2002-01-01").cast("timestamp"), files)


@query("evaluate_alerts", ["samples"], ALERTS_SQL.replace("FROM samples GROUP", "FROM samples WHERE series_id % 3 <> 0 GROUP"))
def _evaluate_alerts(data):
    labelled = data.view("samples").withColumn("labels", F.create_map(
        F.lit("exported_job"), F.when(F.col("series_id") % 3 == 0, "other").otherwise("fleet")))
    return jobs.evaluate_alerts(labelled, ["series_id"], "sample_id", exported_job="fleet")


@query("error_report", ["db_results"], """
, lined AS (SELECT name, coalesce(error, 'fine') || ' failed' AS msg FROM db_results),
cat AS (SELECT name, msg, CASE WHEN lower(msg) LIKE '%access denied%' THEN 'auth'
 WHEN lower(msg) LIKE '%no space left on device%' THEN 'disk' WHEN lower(msg) LIKE '%references invalid table%' THEN 'view'
 WHEN lower(msg) LIKE '%server has gone away%' THEN 'connect' WHEN lower(msg) LIKE '%error 3024%' THEN 'timeout'
 WHEN lower(msg) LIKE '%doesn''t exist%' THEN 'schema' ELSE 'command' END AS category FROM lined)
SELECT name, category, count(*) AS lines, sum(CASE WHEN lower(msg) LIKE '%reduce your request rate%' THEN 1 ELSE 0 END)::BIGINT
 AS rate_limited, category NOT IN ('auth', 'disk', 'view', 'schema') AS retryable FROM cat GROUP BY name, category""")
def _error_report(data):
    lines = data.view("db_results").select("name", F.concat(
        F.coalesce("error", F.lit("fine")), F.lit(" failed")).alias("msg"))
    return jobs.error_report(lines, keys=["name"])


# Three databases made of the TESTDATA tables; their copies lack rows, hold a changed value, or are whole.
DATABASES = {
    "sales": ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"],
    "web": ["events", "pages", "documents"],
    "text": ["benchmark", "labels", "conversations", "embeddings"],
}

@query("verify_copy", [], f"""
WITH sales_counts AS (SELECT count(*) AS l, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END)::BIGINT AS r FROM orders),
web_left AS ({sample_sql("events", 25)}), web_right AS ({sample_sql("events", 25).replace(
    "FROM events", "FROM (SELECT * REPLACE (value + 1 AS value) FROM events)")})
SELECT 'sales' AS db, false AS valid,
 'exact row count mismatch table=orders manifest=' || l || ' restored=' || r AS error FROM sales_counts
UNION ALL SELECT 'web', false, 'sample row hash mismatch table=events manifest=' || web_left.sample_hash
 || ' restored=' || web_right.sample_hash FROM web_left, web_right
UNION ALL SELECT 'text', true, ''""")
def _verify_copy(data):
    recorded = {db: {name: data.table(name) for name in names} for db, names in DATABASES.items()}
    restored = {db: dict(tables) for db, tables in recorded.items()}
    orders, events = data.table("orders"), data.table("events")
    restored["sales"]["orders"] = orders.where(F.col("o_orderpriority") != "1-URGENT")
    restored["web"]["events"] = events.withColumn("value", F.col("value") + 1)
    return jobs.verify_copy(jobs.table_profile(data.spark, recorded, KEYS, 25),
                            jobs.table_profile(data.spark, restored, KEYS, 25))


def run_records(data):
    """Run records with nested results, two databases per run."""
    def result(name, good, factor):
        return F.struct(F.lit(name).alias("name"), F.when(good, "success").otherwise("failed").alias("status"),
                        (F.col("run_id") * factor).alias("size_bytes"),
                        F.create_map(F.lit("t"), F.col("run_id")).alias("table_row_counts"))
    return data.view("runs").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("run_id").cast("string").alias("run_id"),
        F.expr("CASE WHEN load_per_cpu > 1.8 THEN 'skipped' ELSE status END AS status"), "failure_reason", "duration",
        F.lit(2).alias("databases_total"), (F.col("run_id") % 2).cast("int").alias("databases_failed"),
        F.array(result("main", F.lit(True), 3), result("audit", F.col("run_id") % 2 == 0, 0)).alias("results"),
        F.col("load_per_cpu").alias("adaptive_load_per_cpu"), "os_user", "execution_source",
        F.col("host").alias("hostname"))


HISTORY_SQL = """SELECT host, CAST(run_id AS STRING) AS run_id, ts, status, failure_reason, duration,
 2 AS databases_total, run_id % 2 AS databases_failed, 0 AS databases_succeeded, 2 AS results, run_id * 3 AS bytes, load_per_cpu
FROM runs WHERE load_per_cpu <= 1.8"""


def history_columns(runs):
    return runs.select(
        "host", "run_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "failure_reason", "duration",
        "databases_total", "databases_failed", "databases_succeeded", F.size("results").alias("results"),
        F.aggregate("results", F.lit(0).cast("bigint"), lambda a, r: a + r["size_bytes"]).alias("bytes"),
        F.col("adaptive_load_per_cpu").alias("load_per_cpu"))


@query("run_history_files", ["runs"], HISTORY_SQL)
def _run_history_files(data):
    path = work_path(data.spark, "history")
    sinks.append_run_history(run_records(data), path)
    return history_columns(sources.read_run_history(data.spark, path))


@query("log_files", ["log_lines"], """
SELECT left(value, 10) AS day, CAST(row_number() OVER (PARTITION BY left(value, 10) ORDER BY line_no) AS BIGINT) AS line_no,
 strptime(left(value, 26), '%Y/%m/%d %H:%M:%S.%f') AS ts, substr(value, 28) AS msg FROM log_lines""")
def _log_files(data):
    """Writes daily logs, as runs do, and reads them back with their line numbers."""
    path = work_path(data.spark, "logs")
    lines = data.view("log_lines").withColumn("day", F.replace(F.substring("value", 1, 10), F.lit("/"), F.lit("-")))
    (lines.repartition("day").sortWithinPartitions("day", "line_no").select("day", "value")
     .write.partitionBy("day").text(path))
    files = sources.number_lines(sources.text_lines(data.spark, path))
    return sources.split_log_line(files).select(
        F.replace(F.regexp_extract("_file", r"day=([^/]+)/", 1), F.lit("-"), F.lit("/")).alias("day"), "line_no",
        F.col("ts").cast("timestamp_ntz").alias("ts"), "msg")


@query("continued_lines", ["log_lines"], """
, told AS (SELECT run_id, line_no, CASE WHEN NOT contains(value, 'dump for database') THEN strptime(left(value, 26), '%Y/%m/%d %H:%M:%S.%f') END AS own,
 substr(value, 28) AS msg FROM log_lines)
SELECT run_id, line_no, msg, last_value(own IGNORE NULLS) OVER w AS ts,
 CASE WHEN own IS NULL THEN last_value(CASE WHEN own IS NOT NULL THEN line_no END IGNORE NULLS) OVER w END AS continues
FROM told WINDOW w AS (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _continued_lines(data):
    """Logs in which lines about single dumps carry no time of their own."""
    text = F.when(F.contains("value", F.lit("dump for database")), F.substr("value", F.lit(28))).otherwise(F.col("value"))
    lines = sources.split_log_line(data.view("log_lines").withColumn("value", text)).drop("value")
    return logs.continued_lines(lines, ["run_id"], chunk_lines=1 << 12).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


GAUGES_SQL = """, latest AS (SELECT 'h' || series_id % 50 AS host, metric, arg_max(value, (ts, sample_id)) AS value
 FROM samples GROUP BY 1, 2)
"""


def gauge_files(data):
    """Writes one gauge file for each of 50 hosts."""
    path = work_path(data.spark, "gauges")
    host = F.concat(F.lit("h"), (F.col("series_id") % 50).cast("string"))
    latest = data.view("samples").groupBy(host.alias("host"), "metric").agg(
        F.max_by("value", F.struct("ts", "sample_id")).cast("double").alias("value"))
    labels = F.concat(F.lit('job="fleet",service="mysql",region="r '), F.col("host"), F.lit('"'))
    sinks.write_metric_text(latest.withColumn("labels", labels), path)
    return path


@query("metric_files", ["samples"], GAUGES_SQL + """
SELECT host, metric, 'fleet' AS job, 'r ' || host AS region, value::DOUBLE AS value FROM latest""")
def _metric_files(data):
    return sources.read_metric_text(data.spark, gauge_files(data)).select(
        "host", "metric", F.col("labels")["job"].alias("job"), F.col("labels")["region"].alias("region"), "value")


@query("observability_report", ["samples"], GAUGES_SQL + f"""
, names AS (SELECT unnest([{', '.join(f"'{n}'" for n in NAMES)}]) AS metric)
SELECT host, 'failed-or-unknown' AS last_write_result, n.metric,
 coalesce(value, CASE WHEN n.metric = 'backup_logical_validation_last_status' THEN -1 ELSE 0 END)::DOUBLE AS value
FROM (SELECT DISTINCT host FROM latest) CROSS JOIN names n LEFT JOIN latest USING (host, metric)""")
def _observability_report(data):
    return jobs.observability_report(data.spark, gauge_files(data)).drop("last_update", "label")


def _document_dumps(data, path, marked=True):
    """Compressed files of up to a thousand documents each; if ``marked``, the last line marks the end."""
    docs = data.table("documents").select(F.floor(F.col("doc_id") / 1000).alias("bucket"), "doc_id", "text")
    ends = docs.select("bucket").distinct().select(
        "bucket", F.lit(2 ** 62).alias("doc_id"), F.lit("-- Dump completed").alias("text"))
    (docs.unionByName(ends if marked else ends.limit(0)).repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text")
     .write.partitionBy("bucket").option("compression", "gzip").text(path))
    files = data.spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/*").select("path", "length")
    return files.select(F.lit("run").alias("run_id"), F.regexp_extract("path", r"bucket=(\d+)/", 1).alias("db"),
                        "path", F.col("length").alias("bytes"))


@query("artifact_digests", [], """
SELECT CAST(doc_id // 1000 AS STRING) AS db, sha256(string_agg(text || chr(10), '' ORDER BY doc_id) || '-- Dump completed' || chr(10))
 AS payload_sha256, sum(strlen(text) + 1)::BIGINT + 18 AS payload_bytes, true AS has_end_marker, '' AS gzip_error
FROM documents GROUP BY 1""")
def _artifact_digests(data):
    digests = artifact_digests(_document_dumps(data, work_path(data.spark, "dumps")))
    return digests.select("db", "payload_sha256", "payload_bytes", "has_end_marker",
                          F.coalesce("gzip_error", F.lit("")).alias("gzip_error"))


@query("verify_artifacts", [], """
WITH payloads AS (SELECT CAST(doc_id // 1000 AS STRING) AS db,
 sha256(string_agg(text || chr(10), '' ORDER BY doc_id) || '-- Dump completed' || chr(10)) AS sha FROM documents GROUP BY 1)
SELECT host, 'run' AS run_id, 0 AS position, db, host = 'h1' AS valid,
 CASE host WHEN 'h1' THEN '' WHEN 'h2' THEN 'missing ''-- Dump completed'' signature at end of file'
  ELSE 'sql sha256 mismatch: manifest=' || sha256('other') || ' actual=' || sha END AS error
FROM payloads, (VALUES ('h1'), ('h2'), ('h3')) AS v(host)
UNION ALL SELECT 'h2', 'run', 0, 'absent', false, 'file missing'""")
def _verify_artifacts(data):
    """Three hosts with the same run: one with the right digests, one whose dumps lack the end marker (and that records
    a dump that is not there), one with a wrong digest of the payload."""
    files = [_document_dumps(data, work_path(data.spark, "dumps"), marked).withColumn("host", F.lit(host))
             for host, marked in (("h1", True), ("h2", False), ("h3", True))]
    artifacts = files[0].unionByName(files[1]).unionByName(files[2])
    lines = F.sort_array(F.collect_list(F.struct("doc_id", F.concat("text", F.lit("\n")).alias("line"))))["line"]
    payloads = data.table("documents").groupBy(F.floor(F.col("doc_id") / 1000).cast("string").alias("name")).agg(
        F.sha2(F.concat(F.array_join(lines, ""), F.lit("-- Dump completed\n")), 256).alias("sha"))  # 1,000 documents each
    names = artifacts.select("host", F.col("db").alias("name")).unionByName(
        data.spark.createDataFrame([("h2", "absent")], "host string, name string"))
    expected = F.when(F.col("host") == "h1", F.col("sha")).when(F.col("host") == "h3", F.sha2(F.lit("other"), 256)).otherwise("")
    results = names.join(payloads, "name", "left").select("host", F.lit("run").alias("run_id"), F.lit(0).alias("position"), "name",
                                                          F.lit("").alias("artifact_sha256"), expected.alias("sql_sha256"))
    return verify.verify_artifacts(results, artifact_digests(artifacts))


@query("validate_runs", [], """
WITH counted AS (SELECT (""" + " + ".join(f"(SELECT count(*) FROM {name})" for name in fixtures.TABLES) + """)::BIGINT AS n)
SELECT host, '2026-01-02_03-04-05' AS run_id, 'main' AS db, host = 'h1' AS valid,
 CASE WHEN host = 'h1' THEN '' ELSE 'part changed: table=orders file=* (2 in all)' END AS error, n AS row_counts
FROM counted, (VALUES ('h1'), ('h2')) AS v(host)""")
def _validate_runs(data):
    """Two hosts snapshot all tables under one run id; of the second, a part of orders is replaced by one of region."""
    spark, target, source = data.spark, work_path(data.spark, "snapshot"), {"main": TableSource(folder=data.sf_dir)}
    started = datetime(2026, 1, 2, 3, 4, 5)
    run_id = started.strftime(jobs.RUN_ID)
    for host in ("h1", "h2"):
        jobs.snapshot_tables(spark, source, f"{target}/{host}", f"{target}/history", host, started)
    parts = sinks.committed_parts(spark, f"{target}/h2", run_id, "main").where("table_name IN ('orders', 'region')")
    first = {r.table_name: f"{target}/h2/{run_id}/main/{r.table_name}/{r.part}"
             for r in parts.groupBy("table_name").agg(F.min("part").alias("part")).collect()}
    sinks.move_file(spark, first["region"], first["orders"])
    history = sources.read_run_history(spark, f"{target}/history")
    checked, _ = jobs.validate_runs(history)
    counts = run_ops.explode_results(history).select("host", "run_id", F.col("name").alias("db"), "row_counts")
    return checked.join(counts, ["host", "run_id", "db"]).select(
        "host", "run_id", "db", "valid", F.regexp_replace("error", "file=[^ ]+", "file=*").alias("error"), "row_counts")


@query("manifest_files", [], """
SELECT 'h' || s_suppkey % 2 AS host, 'run-' || s_suppkey // 2 AS run_id, s_nationkey AS databases_total FROM supplier""")
def _manifest_files(data):
    """Manifests of two hosts that share their run ids, written and read back."""
    path = work_path(data.spark, "manifests")
    runs = data.table("supplier").select(
        F.concat(F.lit("h"), F.col("s_suppkey") % 2).alias("hostname"),
        F.concat(F.lit("run-"), F.floor(F.col("s_suppkey") / 2)).alias("run_id"), F.col("s_nationkey").cast("int").alias("databases_total"))
    sinks.write_manifests(runs, path)
    return sources.read_manifests(data.spark, path).select("host", "run_id", "databases_total")


@query("artifact_files", [], """
SELECT 'h' || doc_id // 1000 % 2 AS host, 'run' AS run_id, CAST(doc_id // 1000 AS STRING) AS db, true AS sized, count(*) AS documents
FROM documents GROUP BY ALL""")
def _artifact_files(data):
    """Dumps of two hosts with one run id, listed with their hosts, and the lines in them."""
    root = work_path(data.spark, "artifacts")
    dumped = data.table("documents").select(F.floor(F.col("doc_id") / 1000).alias("bucket"), "doc_id")
    placed = dumped.withColumns({"host": F.concat(F.lit("h"), F.col("bucket") % 2), "value": F.col("doc_id").cast("string")})
    staged = work_path(data.spark, "artifacts-staged")
    placed.repartition("bucket").select("host", "bucket", "value").write.partitionBy("host", "bucket") \
        .option("compression", "gzip").text(staged)
    for found in data.spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{staged}/*/*").select("path").collect():
        host, bucket = re.search(r"host=([^/]+)/bucket=(\d+)/", found.path).groups()  # one file for 1,000 documents
        sinks.move_file(data.spark, found.path, f"{root}/{host}/run/{bucket}.sql.gz")
    files = sources.read_artifacts(data.spark, root, hosts=True)
    lines = sources.read_dump_lines(data.spark, f"{root}/*/*/*.sql.gz").groupBy("path").agg(F.count(F.lit(1)).alias("documents"))
    inventory = sources.read_inventory(data.spark, root, hosts=True).select(
        "host", "run_id", F.regexp_extract("rel_path", r"^([^/]+)\.sql\.gz$", 1).alias("db"), "size")
    by_file = F.regexp_replace("path", "^file:/+", "/")
    return files.withColumn("path", by_file).join(lines.withColumn("path", by_file), "path").join(inventory, ["host", "run_id", "db"]) \
        .select("host", "run_id", "db", (F.col("bytes") == F.col("size")).alias("sized"), "documents")


@query("missing_run_folders", [], """
SELECT host, b AS run_id, 'Local backup files have been removed (retention period exceeded)' AS error
FROM (SELECT DISTINCT doc_id // 1000 AS b FROM documents), (VALUES ('h2')) AS v(host)""")
def _missing_run_folders(data):
    """Two hosts with the same runs; the folders of one are there."""
    path = work_path(data.spark, "dumps")
    there = _document_dumps(data, path).select(F.col("db").cast("bigint").alias("run_id"))
    runs = there.select(F.explode(F.array(F.lit("h1"), F.lit("h2"))).alias("host"), "run_id").withColumn(
        "run_folder", F.when(F.col("host") == "h1", F.concat(F.lit(f"{path}/bucket="), "run_id"))
        .otherwise(F.concat(F.lit(f"{path}/gone-"), "run_id"))).withColumn("results", F.array(F.lit(1)))
    folders = list_folders(runs).where("rel_path IS NULL").select("run_folder")
    return verify.missing_run_folders(runs, folders)


@query("read_dump_lines", [], """
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents
 UNION ALL SELECT '-- Dump completed' FROM (SELECT DISTINCT doc_id // 1000 FROM documents)) GROUP BY line""")
def _read_dump_lines(data):
    path = work_path(data.spark, "dumps")
    _document_dumps(data, path)
    lines = sources.read_dump_lines(data.spark, f"{path}/*/*.gz")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("discover_tables", [], "SELECT * FROM (VALUES " + ", ".join(
    f"('table', '{name}')" for name in sorted(fixtures.TABLES)) + ") AS t(section, name)")
def _discover_tables(data):
    return discover_tables(data.spark, TableSource(folder=data.sf_dir))


@query("export_tables", [], " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}" for name in fixtures.TABLES))
def _export_tables(data):
    """Exports every table and counts what can be read back."""
    target = work_path(data.spark, "export")
    tables = scan_tables(data.spark, TableSource(folder=data.sf_dir), fixtures.TABLES)
    sinks.export_tables(data.spark, tables, target, "run", "main")
    copies = sinks.read_export(data.spark, target, "run", "main")
    return profile.table_row_counts(data.spark, copies, "main").select("table_name", F.col("row_count").alias("rows"))


@query("plan_upload", ["file_inventory"], """
SELECT host, run_id, rel_path, 'fleet/' || host || '/' || run_id || '/' || rel_path AS object_key, size
FROM file_inventory WHERE NOT is_dir""")
def _plan_upload(data):
    files = data.view("file_inventory").where(~F.col("is_dir"))
    return sinks.plan_upload(files, "/fleet/", host="host")


@query("upload_totals", ["file_inventory"], """
SELECT run_id, count(*) AS uploaded, sum(size)::BIGINT AS uploaded_bytes FROM file_inventory WHERE NOT is_dir GROUP BY run_id""")
def _upload_totals(data):
    return run_ops.upload_totals(sinks.plan_upload(data.view("file_inventory").where(~F.col("is_dir")), "fleet"))


@query("expire_runs", ["runs", "db_results"], TIERS_SQL + """
SELECT host, run_id, name, size_bytes FROM db_results JOIN flagged USING (run_id)
WHERE keep_daily OR keep_weekly OR keep_monthly""")
def _expire_runs(data):
    runs = data.view("runs").select("host", "run_id", "ts")
    table = data.view("db_results").join(runs.select("host", "run_id"), "run_id")
    expired = retention.expired_runs(runs, retention.kept_runs(runs))
    return sinks.expire_runs(table, expired).select("host", "run_id", "name", "size_bytes")


@query("encrypt_columns", [], "SELECT c_custkey, c_name, c_mktsegment, true AS changed FROM customer")
def _encrypt_columns(data):
    key, columns = "a key of any length", ["c_name", "c_mktsegment"]
    plain = data.table("customer").select("c_custkey", *columns, F.col("c_name").alias("_plain"))
    sealed = sinks.encrypt_columns(plain, columns, key).withColumn(
        "changed", F.col("c_name") != F.col("_plain").cast("binary")).drop("_plain")
    return sinks.decrypt_columns(sealed, columns, key)


@query("inspect_run", ["file_inventory"], """
, parts AS (SELECT run_id, CASE WHEN rel LIKE 'physical/%' THEN 'physical' ELSE 'logical' END AS kind,
  CASE WHEN rel LIKE 'physical/%' THEN 'physical' ELSE 'a' END AS name, size
 FROM (SELECT run_id, substr(rel_path, position('/' IN rel_path) + 1) AS rel, size FROM file_inventory WHERE NOT is_dir)),
summed AS (SELECT run_id, kind, name, sum(size)::BIGINT AS bytes FROM parts GROUP BY ALL),
tenths AS (SELECT *, CASE WHEN bytes < 1000 THEN 0 WHEN bytes < 1000000 THEN 1 ELSE 2 END AS e,
 CAST(floor(bytes / pow(1000.0, CASE WHEN bytes < 1000 THEN 0 WHEN bytes < 1000000 THEN 1 ELSE 2 END) * 10 + 0.5) AS BIGINT) AS t FROM summed)
SELECT run_id, kind, name, bytes, CASE WHEN bytes < 10 THEN bytes || ' B' WHEN t < 100
 THEN t // 10 || '.' || t % 10 || ' ' || ['B', 'kB', 'MB'][e + 1]
 ELSE CAST(round_even(t / 10.0, 0) AS BIGINT) || ' ' || ['B', 'kB', 'MB'][e + 1] END AS size FROM tenths""")
def _inspect_run(data):
    files = data.view("file_inventory").withColumn(
        "rel_path", F.substr("rel_path", F.instr("rel_path", "/") + 1))
    return jobs.inspect_run(files)


@query("snapshot_tables", [], """
SELECT table_name, rows FROM (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}" for name in fixtures.TABLES) + ")")
def _snapshot_tables(data):
    """Snapshots all tables and reads the recorded counts back from the run history."""
    target = work_path(data.spark, "snapshot")
    jobs.snapshot_tables(data.spark, {"main": TableSource(folder=data.sf_dir)}, target, f"{target}/history", "host-1",
                         datetime(2026, 1, 2, 3, 4, 5), pk_columns={"main": KEYS})
    history = sources.read_run_history(data.spark, f"{target}/history")
    results = run_ops.explode_results(history)
    return results.select(F.explode("table_row_counts").alias("table_name", "rows"))


@query("snapshot_estimates", [], """
SELECT 'main' AS db, 'estimate' AS row_count_mode, false AS counted, (""" + " + ".join(
    f"(SELECT count(*) FROM {name})" for name in fixtures.TABLES) + ")::BIGINT AS row_counts")
def _snapshot_estimates(data):
    """A snapshot with exact counts off: the record has the sum of the stored estimates and no map of counts."""
    target = work_path(data.spark, "snapshot")
    jobs.snapshot_tables(data.spark, {"main": TableSource(folder=data.sf_dir)}, target, f"{target}/history", "host-1",
                         datetime(2026, 1, 2, 3, 4, 5), exact_counts=False)
    results = run_ops.explode_results(sources.read_run_history(data.spark, f"{target}/history"))
    return results.select(F.col("name").alias("db"), "row_count_mode",
                          F.coalesce(F.size("table_row_counts") > 0, F.lit(False)).alias("counted"), "row_counts")


@query("table_statistics", [], " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS table_rows FROM {name}" for name in fixtures.TABLES))
def _table_statistics(data):
    return table_statistics(data.spark, TableSource(folder=data.sf_dir), fixtures.TABLES)


@query("snapshot_keys", [], "SELECT table_name, sample_hash FROM (" + " UNION ALL ".join(
    sample_sql(name, 50) for name in sorted(KEYS)) + ")")
def _snapshot_keys(data):
    """Tables written with their keys in the metadata; the snapshot finds the keys and records a sample digest of each."""
    target, folder = work_path(data.spark, "snapshot"), work_path(data.spark, "keyed")
    for name, key in KEYS.items():
        declare_key(data.table(name), key).write.parquet(f"{folder}/{name}.parquet")
    jobs.snapshot_tables(data.spark, {"main": TableSource(folder=folder)}, target, f"{target}/history", "host-1",
                         datetime(2026, 1, 2, 3, 4, 5))
    results = run_ops.explode_results(sources.read_run_history(data.spark, f"{target}/history"))
    return results.select(F.explode("sample_row_hashes").alias("table_name", "sample_hash"))


@query("folder_health", [], """
WITH folders AS (SELECT DISTINCT 'h' || c_nationkey % 5 AS host, 'nation=' || c_nationkey AS rel_path FROM customer),
placed AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rel_path) AS place FROM folders)
SELECT host, 'warn' AS status, 'ownership drift detected relative to uid=*: '
 || string_agg(rel_path || '(uid=* gid=* mode=0*)', ', ' ORDER BY place) AS message FROM placed WHERE place <= 5 GROUP BY host
UNION ALL SELECT 'h9', 'error', 'gone missing or unreadable'""")
def _folder_health(data):
    """Folders of five hosts written from the customers, all owned by another user than expected, and one that is gone."""
    path = work_path(data.spark, "folders")
    placed = data.table("customer").select(
        F.concat(F.lit("h"), F.col("c_nationkey") % 5).alias("host"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"))
    placed.write.partitionBy("host", "nation").text(path)
    hosts = [row.host for row in placed.select("host").distinct().collect()]  # five
    entries = read_entries(data.spark, [(host, f"{path}/host={host}") for host in hosts] + [("h9", f"{path}/gone")])
    folders = entries.where("is_dir OR rel_path IS NULL")
    plain = F.regexp_replace(F.regexp_replace("message", r"(uid=|gid=|mode=0)\d+", "$1*"), r"^.*/gone (missing or unreadable).*", "gone $1")
    return jobs.folder_health(folders, os.geteuid() + 1).select("host", "status", plain.alias("message"))
