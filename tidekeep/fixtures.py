"""Stand-in inputs: views that read the TESTDATA tables as fleet records.

Each view is one SQL text. Spark and DuckDB differ in three expressions only,
written as ``[[SEC n | ts]]`` (add n seconds), ``[[EPOCH ts]]`` (unix seconds)
and ``[[STAMP ts]]`` (log time stamp). Table names stand in braces.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    # One run of one host.
    "runs": """
SELECT 'host-' || CAST(o_custkey % 20 AS STRING) AS host, o_orderkey AS run_id,
 [[SEC o_orderkey % 86400 | o_orderdate]] AS ts,
 CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status,
 CASE WHEN o_orderkey % 11 = 0 THEN 'root' ELSE 'backup' END AS os_user,
 CASE o_orderkey % 3 WHEN 0 THEN 'runner' WHEN 1 THEN 'tui' ELSE 'api' END AS execution_source,
 CASE WHEN o_orderkey % 29 = 0 THEN 'permission denied' END AS cleanup_error,
 CASE WHEN o_orderkey % 17 = 0 THEN 's3 unavailable' END AS logical_upload_error,
 CASE WHEN o_orderkey % 13 = 0 THEN 'physical backup timed out' END AS failure_reason,
 CAST(o_orderkey % 400 AS DOUBLE) / 200 AS load_per_cpu,
 CAST(o_orderkey % 90 AS STRING) || 'm' || CAST(o_orderkey % 60 AS STRING) || '.5s' AS duration
FROM {orders}""",
    # One database of one run.
    "db_results": """
SELECT l_orderkey AS run_id, 'db_' || CAST(l_linenumber AS STRING) AS name,
 CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status,
 CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, CAST(l_quantity AS BIGINT) AS row_counts,
 CASE WHEN l_returnflag <> 'R' THEN NULL ELSE CASE l_suppkey % 8 WHEN 0 THEN 'Access denied for user'
  WHEN 1 THEN 'No space left on device' WHEN 2 THEN 'Lost connection: server has gone away'
  WHEN 3 THEN 'Error 3024: max_execution_time exceeded' WHEN 4 THEN 'Table x doesn''t exist'
  WHEN 5 THEN 'Please reduce your request rate' WHEN 6 THEN 'View references invalid table(s)'
  ELSE 'exit status 2' END END AS error
FROM {lineitem}""",
    # One try of one dump; attempt_key, status, error give the order of the tries.
    "attempts": """
SELECT l_orderkey AS run_id, 'db_' || CAST(l_linenumber AS STRING) AS name, l_suppkey AS attempt_key,
 CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status,
 CASE WHEN l_returnflag = 'R' AND l_suppkey % 4 = 0 THEN 'Please reduce your request rate'
      WHEN l_returnflag = 'R' THEN 'exit status 1' END AS error
FROM {lineitem}""",
    # Gauge samples of 150 series keys.
    "samples": """
SELECT user_id AS series_id, ts, event_id AS sample_id,
 CASE event_type WHEN 'error' THEN 'backup_last_status' WHEN 'signup' THEN 'backup_run_in_progress'
  WHEN 'click' THEN 'backup_logical_last_attempted' WHEN 'view' THEN 'backup_logical_last_status'
  ELSE 'backup_last_success_timestamp' END AS metric,
 CASE event_type WHEN 'purchase' THEN [[EPOCH ts]] ELSE CAST(event_id % 2 AS BIGINT) END AS value
FROM {events}""",
    # Raw lines of run logs.
    "log_lines": """
SELECT user_id AS run_id, event_id AS line_no, [[STAMP ts]] || ' ' ||
 CASE event_type WHEN 'signup' THEN 'found ' || CAST(event_id % 7 + 1 AS STRING) || ' databases: a, b'
  WHEN 'click' THEN '[' || CAST(event_id % 7 + 1 AS STRING) || '/7] processing db_' || CAST(event_id % 7 AS STRING)
  WHEN 'view' THEN 'starting dump for database=db_' || CAST(event_id % 7 AS STRING)
  WHEN 'purchase' THEN 'completed dump for database=db_' || CAST(event_id % 7 AS STRING)
    || ' output=/b/x.sql.gz size_bytes=' || CAST(event_id AS STRING)
  ELSE 'backup failure reason: permission denied' END AS value
FROM {events}""",
    # Whole document texts, one row per line.
    "doc_lines": """
SELECT doc_id, source, line_no, line FROM (
 SELECT doc_id, source, [[LINES text]] FROM {documents}) AS split_lines""",
    "due_cases": """
SELECT o_orderkey AS case_id,
 CASE WHEN o_orderkey % 7 <> 0 THEN [[SEC o_orderkey % 86400 | o_orderdate]] END AS last_success,
 [[SEC o_orderkey % 86400 + (o_custkey % 10) * 21600 | o_orderdate]] AS now,
 CASE o_orderkey % 6 WHEN 0 THEN 'daily@02:00' WHEN 1 THEN 'daily@02:00,10:00,18:00'
  WHEN 2 THEN 'weekly@sun,02:00' WHEN 3 THEN 'interval@6h' WHEN 4 THEN 'always' ELSE 'disabled' END AS schedule
FROM {orders}""",
    "file_inventory": """
SELECT 'host-' || CAST(l_suppkey % 20 AS STRING) AS host, '/backup' AS root,
 'run-' || CAST(l_orderkey AS STRING) || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '/a.sql.gz'
   WHEN 2 THEN '/physical/x.ibd' ELSE '/physical/d/y.ibd' END AS rel_path,
 l_orderkey AS run_id, l_linenumber % 4 = 0 AS is_dir,
 CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1000 END AS uid,
 CAST(floor(l_extendedprice) AS BIGINT) AS size
FROM {lineitem}""",
    "requested": """
SELECT DISTINCT 'db_' || CAST(p_size % 50 AS STRING) AS db,
 'tbl_' || CAST(p_partkey % 97 AS STRING) AS table_name FROM {part}""",
    "discovered": """
SELECT DISTINCT 'db_' || CAST(l_partkey % 50 AS STRING) AS db,
 'tbl_' || CAST(l_suppkey % 89 AS STRING) AS table_name FROM {lineitem}""",
    # A view reads the discovered table of its row, or one that is not there.
    "view_deps": """
SELECT DISTINCT 'db_' || CAST(l_partkey % 50 AS STRING) AS db,
 'v_' || CAST(l_orderkey % 40 AS STRING) AS view_name,
 CASE WHEN l_orderkey % 997 = 0 THEN 'gone_' || CAST(l_linenumber AS STRING)
  ELSE 'tbl_' || CAST(l_suppkey % 89 AS STRING) END AS table_name
FROM {lineitem}""",
    "catalog_objects": """
SELECT DISTINCT 'db_' || CAST(l_partkey % 50 AS STRING) AS db,
 CASE l_linenumber % 5 WHEN 0 THEN 'event' WHEN 1 THEN 'table' WHEN 2 THEN 'view' WHEN 3 THEN 'trigger' ELSE 'routine' END AS section,
 'obj_' || CAST(l_suppkey AS STRING) AS name FROM {lineitem}""",
    # Databases as a server lists them: system, copy and user databases.
    "databases": """
SELECT DISTINCT 'host-' || CAST(c_custkey % 20 AS STRING) AS host,
 CASE c_custkey % 13 WHEN 0 THEN 'information_schema' WHEN 1 THEN 'mysql' WHEN 2 THEN ' sys '
  WHEN 3 THEN '  ' WHEN 4 THEN 'BK_' || c_mktsegment WHEN 5 THEN 'bk_' || CAST(c_nationkey AS STRING)
  ELSE lower(c_mktsegment) || '_' || CAST(c_nationkey AS STRING) END AS db,
 c_custkey % 97 = 0 AS is_template
FROM {customer}""",
    "constraints": """
SELECT DISTINCT 'db_' || CAST(l_partkey % 50 AS STRING) AS table_schema,
 'tbl_' || CAST(l_suppkey % 89 AS STRING) AS table_name,
 CASE WHEN l_linenumber % 3 = 0 THEN 'uq_' || CAST(l_linenumber AS STRING) ELSE 'PRIMARY' END AS constraint_name,
 CASE WHEN l_linenumber % 3 = 0 THEN 'UNIQUE' ELSE 'PRIMARY KEY' END AS constraint_type
FROM {lineitem}""",
    "key_usage": """
SELECT DISTINCT 'db_' || CAST(l_partkey % 50 AS STRING) AS table_schema,
 'tbl_' || CAST(l_suppkey % 89 AS STRING) AS table_name,
 CASE WHEN l_linenumber % 3 = 0 THEN 'uq_' || CAST(l_linenumber AS STRING) ELSE 'PRIMARY' END AS constraint_name,
 l_linenumber AS ordinal_position, 'c_' || CAST(8 - l_linenumber AS STRING) AS column_name
FROM {lineitem}""",
    "settings": """
SELECT 'host-' || CAST(c_custkey % 20 AS STRING) AS host,
 CASE c_custkey % 6 WHEN 0 THEN 'DB_PASS' WHEN 1 THEN 'DB_USER' WHEN 2 THEN 'BACKUP_LOGICAL_SCHEDULE'
  WHEN 3 THEN 'BACKUP_RETENTION_DAILY' WHEN 4 THEN 'BACKUP_S3_KEY_SECRET' ELSE 'UNKNOWN_KEY' END AS key,
 CASE c_nationkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'override' ELSE 'env' END AS layer,
 max(c_name) AS value, max(c_acctbal) > 5000 AS unexpired
FROM {customer} GROUP BY 1, 2, 3""",
    # Per-database outcome of a validation; the newest check of a run counts.
    "db_validations": """
SELECT l_orderkey AS run_id, l_linenumber AS position, 'db_' || CAST(l_linenumber AS STRING) AS db,
 l_shipdate AS checked_at, l_returnflag <> 'R' AS valid,
 CASE WHEN l_returnflag <> 'R' THEN NULL WHEN l_suppkey % 3 = 0 THEN 'file missing'
  WHEN l_suppkey % 3 = 1 THEN 'artifact sha256 mismatch' ELSE '' END AS error
FROM {lineitem}""",
    # Stored row estimates per table, some unknown.
    "table_stats": """
SELECT 'db_' || CAST(p_size % 50 AS STRING) AS db, 'tbl_' || CAST(p_partkey AS STRING) AS table_name,
 CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS BIGINT) END AS table_rows
FROM {part}""",
    # Two profiles per database: the recorded one and that of a restored copy.
    "profile_recorded": """
SELECT 'db_' || CAST(o_custkey % 500 AS STRING) AS db,
 count(*) AS table_count, count(DISTINCT o_orderstatus) AS view_count,
 count(DISTINCT o_orderpriority) AS trigger_count,
 sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS routine_count,
 sum(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS event_count,
 CASE WHEN min(o_orderkey) % 9 = 0 THEN '' ELSE 'fp-' || CAST(max(o_orderkey) AS STRING) END AS schema_fingerprint
FROM {orders} GROUP BY 1""",
    "profile_restored": """
SELECT 'db_' || CAST(o_custkey % 500 AS STRING) AS db,
 count(*) - CASE WHEN min(o_orderkey) % 11 = 0 THEN 1 ELSE 0 END AS table_count,
 count(DISTINCT CASE WHEN o_custkey % 17 = 0 THEN 'x' ELSE o_orderstatus END) AS view_count,
 count(DISTINCT o_orderpriority) AS trigger_count,
 sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS routine_count,
 sum(CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 13 <> 0 THEN 1 ELSE 0 END) AS event_count,
 'fp-' || CAST(max(CASE WHEN o_custkey % 19 = 0 THEN 0 ELSE o_orderkey END) AS STRING) AS schema_fingerprint
FROM {orders} GROUP BY 1""",
    # Row counts per table of a database, recorded and restored.
    "counts_recorded": """
SELECT 'db_' || CAST(l_partkey % 50 AS STRING) AS db, 'tbl_' || CAST(l_suppkey % 89 AS STRING) AS table_name,
 CASE WHEN l_partkey % 50 % 10 = 0 THEN 'estimate' ELSE 'exact' END AS mode, count(*) AS row_count
FROM {lineitem} GROUP BY 1, 2, 3""",
    "counts_restored": """
SELECT 'db_' || CAST(l_partkey % 50 AS STRING) AS db,
 CASE WHEN l_partkey % 50 = 7 AND l_suppkey % 89 = 3 THEN 'renamed' ELSE 'tbl_' || CAST(l_suppkey % 89 AS STRING) END AS table_name,
 sum(CASE WHEN l_partkey % 50 = 5 AND l_suppkey % 89 = 4 AND l_returnflag = 'R' THEN 0 ELSE 1 END) AS row_count
FROM {lineitem} WHERE NOT (l_partkey % 50 = 9 AND l_suppkey % 89 = 2) GROUP BY 1, 2""",
    # Tool output lines of a run, for the error summary.
    "tool_lines": """
SELECT user_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 'xbcloud' ELSE 'xtrabackup' END AS tool,
 event_id AS line_no,
 CASE event_type WHEN 'signup' THEN '   ' WHEN 'click' THEN ' completed OK! ' || CAST(event_id AS STRING)
  WHEN 'view' THEN 'xbcloud: uploaded chunk ' || CAST(event_id AS STRING)
  WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN ' errno 28 at ' || CAST(event_id AS STRING) ELSE 'note' END
  ELSE 'No Space Left on device ' || CAST(user_id AS STRING) END AS line
FROM {events}""",
}

def _render(text: str, dialect: str) -> str:
    spark = dialect == "spark"

    def seconds(match):
        n, ts = match.group(1).strip(), match.group(2).strip()
        if spark:
            return f"timestampadd(SECOND, CAST({n} AS INT), {ts})"
        return f"({ts} + to_seconds(CAST({n} AS BIGINT)))"

    def epoch(match):
        ts = match.group(1).strip()
        return f"unix_timestamp({ts})" if spark else f"CAST(floor(epoch({ts})) AS BIGINT)"

    def stamp(match):
        ts = match.group(1).strip()
        if spark:
            return f"date_format({ts}, 'yyyy/MM/dd HH:mm:ss.SSSSSS')"
        return f"strftime({ts}, '%Y/%m/%d %H:%M:%S.%f')"

    def lines(match):
        col = match.group(1).strip()
        if spark:
            return f"posexplode(split({col}, '\\n')) AS (line_no, line)"
        return (f"unnest(range(len(string_split({col}, chr(10))))) AS line_no, "
                f"unnest(string_split({col}, chr(10))) AS line")

    text = re.sub(r"\[\[SEC (.*?)\|(.*?)\]\]", seconds, text)
    text = re.sub(r"\[\[EPOCH (.*?)\]\]", epoch, text)
    text = re.sub(r"\[\[STAMP (.*?)\]\]", stamp, text)
    return re.sub(r"\[\[LINES (.*?)\]\]", lines, text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(_render(text, "spark"), **{t: table(spark, sf_dir, t) for t in used})


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views for DuckDB (texts may add recursive ones)."""
    parts = []
    for name in names:
        text = _render(VIEWS[name], "duckdb")
        parts.append(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', text)})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
