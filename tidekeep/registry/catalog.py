"""Queries on catalogues, profiles and their comparison."""

from pyspark.sql import functions as F

from tidekeep import fixtures
from tidekeep.operators import catalog as op, profile, verify
from tidekeep.registry.base import query

# Key columns of the TESTDATA tables; lineitem has none.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"],
    "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
    "embeddings": ["vec_id"],
}

COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "#c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "#s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "#p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "#o_totalprice", "@o_orderdate", "o_orderpriority"],
    "events": ["event_id", "@ts", "user_id", "event_type", "#value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"], "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"], "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"], "embeddings": ["vec_id", "*embedding", "label"],
}


def _canonical_sql(column):
    """DuckDB text of a column: ``#`` marks doubles, ``@`` time stamps and ``*`` lists of floats."""
    name = column.lstrip("#@*")
    if column.startswith("*"):
        return (f"coalesce('[' || array_to_string(list_transform({name}, lambda x: "
                "coalesce(CAST(CAST(CAST(x AS DOUBLE) AS DECIMAL(38,6)) AS STRING), 'NULL')), ',') || ']', 'NULL')")
    if column.startswith("#"):
        return f"coalesce(CAST(CAST({name} AS DECIMAL(38,6)) AS STRING), 'NULL')"
    if column.startswith("@"):
        return f"coalesce(strftime({name}, '%Y-%m-%d %H:%M:%S.%f'), 'NULL')"
    return f"coalesce(CAST({name} AS STRING), 'NULL')"


def sample_sql(table, n):
    line = "concat_ws(chr(9), " + ", ".join(map(_canonical_sql, COLUMNS[table])) + ") || chr(10)"
    keys = ", ".join(KEYS[table])
    return (f"SELECT 'main' AS db, '{table}' AS table_name, sha256(string_agg(line, '' ORDER BY {keys})) AS sample_hash "
            f"FROM (SELECT {keys}, {line} AS line FROM {table} ORDER BY {keys} LIMIT {n})")


COUNTS_SQL = " UNION ALL ".join(
    f"SELECT 'main' AS db, '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in sorted(fixtures.TABLES))


def all_tables(data):
    return {name: data.table(name) for name in fixtures.TABLES}


def user_databases(data):
    return op.exclude_system_databases(data.view("databases"))


USER_SQL = """, named AS (SELECT host, trim(db) AS db, is_template FROM databases),
user_databases AS (SELECT host, db FROM named
 WHERE db NOT IN ('', 'information_schema', 'performance_schema', 'mysql', 'sys') AND NOT is_template)"""


@query("exclude_system_databases", ["databases"], USER_SQL + "\nSELECT host, db FROM user_databases")
def _exclude_system(data):
    return user_databases(data).select("host", "db")


@query("select_databases", ["databases"], USER_SQL + """
SELECT host, db FROM user_databases WHERE lower(db) NOT LIKE 'bk\\_%' ESCAPE '\\'""")
def _select_databases(data):
    return op.select_databases(user_databases(data)).select("host", "db")


ALLOW_SQL = """, allowed AS (SELECT DISTINCT lower(n_name) AS db FROM nation UNION SELECT 'bk_' || n_nationkey FROM nation
 UNION SELECT lower(c_mktsegment) || '_3' FROM customer)"""


def allow_list(data):
    nation, customer = data.table("nation"), data.table("customer")
    return (nation.select(F.lower("n_name").alias("db"))
            .union(nation.select(F.concat(F.lit("bk_"), F.col("n_nationkey").cast("string"))))
            .union(customer.select(F.concat(F.lower("c_mktsegment"), F.lit("_3")))).distinct())


@query("selected_databases", ["databases"], USER_SQL + ALLOW_SQL + """
SELECT host, db FROM user_databases WHERE db IN (SELECT db FROM allowed)""")
def _selected_databases(data):
    return op.select_databases(user_databases(data), allow_list(data)).select("host", "db")


@query("available_tables", ["requested", "discovered"], """
SELECT db, table_name FROM requested SEMI JOIN discovered USING (db, table_name)""")
def _available_tables(data):
    return op.available_tables(data.view("requested"), data.view("discovered"))


@query("missing_tables", ["requested", "discovered"], """
SELECT db, table_name FROM requested ANTI JOIN discovered USING (db, table_name)""")
def _missing_tables(data):
    return op.missing_tables(data.view("requested"), data.view("discovered"))


BROKEN_SQL = """, broken AS (SELECT DISTINCT db, view_name FROM view_deps ANTI JOIN discovered USING (db, table_name))"""


@query("broken_views", ["view_deps", "discovered"], BROKEN_SQL + "\nSELECT db, view_name FROM broken")
def _broken_views(data):
    return op.broken_views(data.view("view_deps"), data.view("discovered"))


@query("drop_broken_views", ["view_deps", "discovered"], BROKEN_SQL + """, objs AS (
 SELECT DISTINCT db, view_name AS name FROM view_deps UNION ALL SELECT db, table_name FROM discovered)
SELECT db, name FROM objs WHERE (db, name) NOT IN (SELECT (db, view_name) FROM broken)""")
def _drop_broken_views(data):
    deps, tables = data.view("view_deps"), data.view("discovered")
    objs = deps.select("db", F.col("view_name").alias("name")).distinct().unionAll(tables)
    return op.drop_broken_views(objs, op.broken_views(deps, tables))


@query("primary_keys", ["constraints", "key_usage"], """
SELECT k.table_schema, k.table_name, string_agg(column_name, ',' ORDER BY ordinal_position) AS pk_columns
FROM key_usage k JOIN constraints c USING (table_schema, table_name, constraint_name)
WHERE constraint_type = 'PRIMARY KEY' GROUP BY 1, 2""")
def _primary_keys(data):
    keys = op.primary_keys(data.view("constraints"), data.view("key_usage"))
    return keys.withColumn("pk_columns", F.array_join("pk_columns", ","))


@query("ordered_names", ["catalog_objects"], "SELECT db, section, name FROM catalog_objects ORDER BY 1, 2, 3")
def _ordered_names(data):
    return op.ordered_names(data.view("catalog_objects"))


OBJECTS_SQL = "SELECT db, " + ", ".join(
    f"sum(CASE WHEN section = '{s}' THEN 1 ELSE 0 END)::BIGINT AS {s}_count" for s in op.SECTIONS
) + " FROM catalog_objects GROUP BY db"


@query("object_counts", ["catalog_objects"], OBJECTS_SQL)
def _object_counts(data):
    return op.object_counts(data.view("catalog_objects"))


@query("schema_fingerprint", ["catalog_objects"], """
SELECT db, sha256(string_agg(section || ':' || name, chr(10) ORDER BY section, name)) AS schema_fingerprint
FROM catalog_objects GROUP BY db UNION ALL SELECT 'db_without_objects', sha256('')""")
def _schema_fingerprint(data):
    objs = data.view("catalog_objects")
    databases = objs.select("db").distinct().union(
        data.table("region").select(F.lit("db_without_objects"))).distinct()
    return op.schema_fingerprint(objs, databases=databases)


@query("estimated_row_counts", ["table_stats"], """
SELECT db, coalesce(sum(table_rows), 0)::BIGINT AS row_counts FROM table_stats GROUP BY db""")
def _estimated(data):
    return op.estimated_row_counts(data.view("table_stats"))


@query("counted_or_estimated", ["table_stats", "counts_recorded"], """
, est AS (SELECT db, coalesce(sum(table_rows), 0)::BIGINT AS n FROM table_stats GROUP BY db),
exact AS (SELECT db, sum(row_count)::BIGINT AS n FROM counts_recorded WHERE mode = 'exact' GROUP BY db)
SELECT db, coalesce(exact.n, est.n) AS row_counts, CASE WHEN exact.n IS NOT NULL THEN 'exact' ELSE 'estimate' END
 AS row_count_mode FROM est FULL JOIN exact USING (db)""")
def _counted_or_estimated(data):
    counted = data.view("counts_recorded").where(F.col("mode") == "exact")
    return op.counted_or_estimated(op.estimated_row_counts(data.view("table_stats")),
                                   profile.db_row_counts(counted))


@query("table_row_counts", [], COUNTS_SQL)
def _table_row_counts(data):
    return profile.table_row_counts(data.spark, all_tables(data), "main")


@query("db_row_counts", [], f"""
WITH counts AS ({COUNTS_SQL}) SELECT c.db, total.row_counts, c.table_name, c.row_count FROM counts c
JOIN (SELECT db, sum(row_count)::BIGINT AS row_counts FROM counts GROUP BY db) total USING (db)""")
def _db_row_counts(data):
    totals = profile.db_row_counts(profile.table_row_counts(data.spark, all_tables(data), "main"))
    return totals.select("db", "row_counts", F.explode("table_row_counts").alias("table_name", "row_count"))


@query("head_by_key", [], "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25")
def _head_by_key(data):
    return profile.head_by_key(data.table("orders"), ["o_orderkey"], 25)


@query("sample_row_hashes", [], " UNION ALL ".join(sample_sql(t, 50) for t in sorted(KEYS)))
def _sample_row_hashes(data):
    return profile.sample_row_hashes(data.spark, all_tables(data), KEYS, 50, "main")


@query("compare_profiles", ["profile_recorded", "profile_restored"], """
SELECT db, error = '' AS valid, error FROM (SELECT a.db, CASE
 WHEN a.table_count <> b.table_count THEN 'base table count mismatch: manifest=' || a.table_count || ', restored=' || b.table_count
 WHEN a.view_count <> b.view_count THEN 'view count mismatch: manifest=' || a.view_count || ', restored=' || b.view_count
 WHEN a.trigger_count <> b.trigger_count THEN 'trigger count mismatch: manifest=' || a.trigger_count || ', restored=' || b.trigger_count
 WHEN a.routine_count <> b.routine_count THEN 'routine count mismatch: manifest=' || a.routine_count || ', restored=' || b.routine_count
 WHEN a.event_count <> b.event_count THEN 'event count mismatch: manifest=' || a.event_count || ', restored=' || b.event_count
 WHEN a.schema_fingerprint <> '' AND a.schema_fingerprint <> b.schema_fingerprint
  THEN 'schema fingerprint mismatch: manifest=' || a.schema_fingerprint || ', restored=' || b.schema_fingerprint
 ELSE '' END AS error FROM profile_recorded a JOIN profile_restored b USING (db))""")
def _compare_profiles(data):
    return verify.compare_profiles(data.view("profile_recorded"), data.view("profile_restored"))


def paired_sql(left, right, value, missing, mismatch, set_text, total):
    return f""", paired AS (SELECT coalesce(a.db, b.db) AS db, coalesce(a.table_name, b.table_name) AS table_name,
  a.{value} AS l, b.{value} AS r, CASE
   WHEN b.db IS NULL THEN '{missing}' || a.table_name
   WHEN a.{value} <> b.{value} THEN '{mismatch} table=' || a.table_name || ' manifest=' || a.{value} || ' restored=' || b.{value}
  END AS issue {', a.mode' if total else ''} FROM {left} a FULL JOIN {right} b ON a.db = b.db AND a.table_name = b.table_name),
per_db AS (SELECT db, count(l) AS lt, count(r) AS rt, arg_min(issue, table_name) FILTER (issue IS NOT NULL) AS issue
 {', max(mode) AS mode, sum(l)::BIGINT AS lsum, sum(r)::BIGINT AS rsum' if total else ''} FROM paired GROUP BY db),
judged AS (SELECT db, CASE {"WHEN mode <> 'exact' THEN ''" if total else ''}
  WHEN lt <> rt THEN '{set_text}: manifest_tables=' || lt || ' restored_tables=' || rt
  WHEN issue IS NOT NULL THEN issue
  {"WHEN lsum <> rsum THEN 'exact row count mismatch: manifest=' || lsum || ', restored=' || rsum" if total else ''}
  ELSE '' END AS error FROM per_db WHERE lt > 0)
SELECT db, error = '' AS valid, error FROM judged"""


@query("compare_table_counts", ["counts_recorded", "counts_restored"], paired_sql(
    "counts_recorded", "counts_restored", "row_count", "exact row count missing restored table: ",
    "exact row count mismatch", "exact table row count set mismatch", True))
def _compare_table_counts(data):
    return verify.compare_table_counts(data.view("counts_recorded"), data.view("counts_restored"))


HASHED_SQL = """, left_hashes AS (SELECT db, table_name, sha256(CAST(row_count AS STRING)) AS sample_hash FROM counts_recorded),
right_hashes AS (SELECT db, table_name, sha256(CAST(row_count AS STRING)) AS sample_hash FROM counts_restored)"""


@query("compare_sample_hashes", ["counts_recorded", "counts_restored"], HASHED_SQL + paired_sql(
    "left_hashes", "right_hashes", "sample_hash", "sample row hash missing restored table: ",
    "sample row hash mismatch", "sample row hash table set mismatch", False))
def _compare_sample_hashes(data):
    def hashed(name):
        return data.view(name).select("db", "table_name", F.sha2(F.col("row_count").cast("string"), 256).alias("sample_hash"))
    return verify.compare_sample_hashes(hashed("counts_recorded"), hashed("counts_restored"))


@query("validation_rollup", ["db_validations"], """
SELECT run_id, bool_and(valid) AS valid FROM db_validations GROUP BY run_id""")
def _validation_rollup(data):
    return verify.validation_rollup(data.view("db_validations"), ["run_id"])


@query("validation_summary", ["db_validations"], """
, named AS (SELECT run_id, position, valid, CASE WHEN coalesce(error, '') <> '' THEN db || ': ' || error ELSE db END AS name
 FROM db_validations)
SELECT run_id, coalesce('validation failed for ' || string_agg(name, ', ' ORDER BY position, name) FILTER (NOT valid), '')
 AS summary FROM named GROUP BY run_id""")
def _validation_summary(data):
    return verify.validation_summary(data.view("db_validations"), keys=["run_id"])
