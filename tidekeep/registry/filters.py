"""Queries on filters and projections."""

from pyspark.sql import functions as F

from tidekeep.operators import filters as op
from tidekeep.functions.text import fuzzy_match
from tidekeep.registry.base import query


@query("keep_dump_warnings", ["db_results"], """
SELECT run_id, name, size_bytes, error FROM db_results WHERE contains(lower(error), 'error') OR contains(lower(error), 'warning')
 OR contains(lower(error), 'failed') OR contains(lower(error), 'couldn''t find table') OR contains(lower(error), 'could not')""")
def _dump_warnings(data):
    return op.keep_dump_warnings(data.view("db_results").select("run_id", "name", "size_bytes", "error"), "error")


@query("keep_physical_events", ["tool_lines"], """
SELECT run_id, tool, line_no, line FROM tool_lines WHERE regexp_matches(lower(line), 'error|warning|failed|fatal|no space left|errno 28'
 || '|completed ok|upload completed|transaction log of lsn|backup created in directory|mysql binlog position')""")
def _physical_events(data):
    return op.keep_physical_events(data.view("tool_lines"))


@query("lifecycle_lines", ["log_lines"], """
SELECT run_id, line_no, value FROM log_lines WHERE regexp_matches(value, 'mysql full backup started|run log file:|daily log file:'
 || '|logical backup:|physical backup:|backup folder:|discovering databases|found [0-9]+ databases|processing |starting dump'
 || '|completed dump|deleting old backup folder|cleanup warning|backup summary|backup failure reason|s3 upload|metrics write failed')""")
def _lifecycle_lines(data):
    return op.lifecycle_lines(data.view("log_lines"), "value")


@query("failure_lines", ["log_lines"], """
SELECT run_id, line_no, value FROM log_lines WHERE contains(value, 'failed') OR contains(value, 'warning')
 OR contains(value, 'permission denied') OR contains(value, 'rate limit') OR contains(value, 'retry')""")
def _failure_lines(data):
    return op.failure_lines(data.view("log_lines"), "value")


@query("search", ["doc_lines"], """
SELECT doc_id, line_no, line FROM doc_lines WHERE contains(lower(source || ' ' || line), 'license')""")
def _search(data):
    return op.search(data.view("doc_lines"), " LICENSE ", ["source", "line"]).select("doc_id", "line_no", "line")


@query("fuzzy_match", [], """
SELECT c_custkey, c_name, c_name LIKE '%C%m%0%9%' AS matches FROM customer""")
def _fuzzy_match(data):
    return data.table("customer").select("c_custkey", "c_name", fuzzy_match("c_name", "Cm09").alias("matches"))


@query("fuzzy_match_texts", [], """
SELECT doc_id, text LIKE '%t%h%e%~%q%' AS matches FROM documents""")
def _fuzzy_match_texts(data):
    """Whole texts that mostly don't match."""
    return data.table("documents").select("doc_id", fuzzy_match("text", "the~q").alias("matches"))


@query("ownership_drift", ["file_inventory"], """
SELECT host, root, rel_path, uid, row_number() OVER
 (PARTITION BY host, root ORDER BY string_split(rel_path, '/'), uid) AS place
FROM (SELECT DISTINCT host, root, rel_path, uid FROM file_inventory)
WHERE uid <> 1000 AND len(string_split(rel_path, '/')) - 1 <= 2 QUALIFY place <= 5""")
def _ownership_drift(data):
    files = data.view("file_inventory").select("host", "root", "rel_path", "uid").distinct()
    return op.ownership_drift(files, 1000)


@query("select_series", ["samples"], """
SELECT sample_id, series_id, metric, value FROM samples WHERE series_id % 3 = 1 AND metric <> 'backup_last_status'""")
def _select_series(data):
    labelled = data.view("samples").withColumn("labels", F.create_map(
        F.lit("job"), F.when(F.col("series_id") % 3 == 1, "fleet").otherwise("other"),
        F.lit("service"), F.when(F.col("metric") == "backup_last_status", "pg").otherwise("mysql")))
    scraped = labelled.withColumn("labels", op.scraped_labels("labels"))
    chosen = op.select_series(scraped, exported_job="fleet", service="mysql", region="")
    return chosen.select("sample_id", "series_id", "metric", "value")


@query("mask_secrets", ["settings"], """
SELECT host, key, layer, CASE WHEN key IN ('DB_PASS', 'BACKUP_S3_KEY_SECRET') THEN '********' ELSE value END AS value
FROM settings""")
def _mask_secrets(data):
    return op.mask_secrets(data.view("settings")).drop("unexpired")


@query("layer_settings", ["settings"], """
, usable AS (SELECT * FROM settings WHERE layer = 'file'
  OR (key <> 'UNKNOWN_KEY' AND (layer = 'env' OR unexpired)))
SELECT host, key, layer, value FROM usable QUALIFY row_number() OVER (PARTITION BY host, key
 ORDER BY CASE layer WHEN 'env' THEN 0 WHEN 'override' THEN 1 ELSE 2 END) = 1""")
def _layer_settings(data):
    rows = data.view("settings").withColumn("expires_at", F.when(
        F.col("unexpired"), F.lit("2030-01-01")).otherwise(F.lit("2020-01-01")).cast("timestamp"))
    base, overrides, env = (rows.where(F.col("layer") == layer) for layer in ("file", "override", "env"))
    return op.layer_settings(base, overrides, env, F.lit("2026-01-01").cast("timestamp"))
