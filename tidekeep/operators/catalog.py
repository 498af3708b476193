"""Databases, tables, views and keys: what is there and what is in scope."""

from pyspark.sql import DataFrame, functions as F

from tidekeep.functions.text import strip
from tidekeep.operators.ordered_hash import ordered_sha256

# Databases of the server itself, and the prefix of copies.
SYSTEM_DATABASES = ["information_schema", "performance_schema", "mysql", "sys"]
COPY_PREFIX = "bk_"

SECTIONS = ["table", "view", "trigger", "routine", "event"]


def exclude_system_databases(objs: DataFrame) -> DataFrame:
    """Named, trimmed user databases; templates are left out where they are marked."""
    named = objs.withColumn("db", strip("db")).where((F.col("db") != "") & ~F.col("db").isin(SYSTEM_DATABASES))
    if "is_template" in objs.columns:
        named = named.where(~F.col("is_template"))
    return named


def select_databases(objs: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Without an allow-list all but copies; with one (column ``db``) exactly the listed ones."""
    if allow is None:
        return objs.where(~F.lower(strip("db")).startswith(COPY_PREFIX))
    return selected_databases(objs, allow)


def selected_databases(discovered: DataFrame, allow: DataFrame) -> DataFrame:
    on = [c for c in ("host", "db") if c in allow.columns]
    return discovered.join(allow.select(*on), on, "left_semi")


def _table_key(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in ("host", "db", "table_name") if c in left.columns and c in right.columns]


def available_tables(requested: DataFrame, discovered: DataFrame) -> DataFrame:
    return requested.join(discovered, _table_key(requested, discovered), "left_semi")


def missing_tables(requested: DataFrame, discovered: DataFrame) -> DataFrame:
    return requested.join(discovered, _table_key(requested, discovered), "left_anti")


def broken_views(view_deps: DataFrame, tables: DataFrame) -> DataFrame:
    """Views that read a table which is not there."""
    broken = view_deps.join(tables, _table_key(view_deps, tables), "left_anti")
    return broken.select(*[c for c in ("host", "db") if c in view_deps.columns], "view_name").distinct()


def drop_broken_views(objs: DataFrame, broken: DataFrame) -> DataFrame:
    on = [c for c in ("host", "db") if c in objs.columns and c in broken.columns]
    return objs.join(broken.withColumnRenamed("view_name", "name"), [*on, "name"], "left_anti")


def primary_keys(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Primary-key columns of each table in ordinal order."""
    on = ["table_schema", "table_name", "constraint_name"]
    usage = key_usage.join(constraints.where(F.col("constraint_type") == "PRIMARY KEY"), on, "left_semi")
    columns = F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name")))
    return (usage.groupBy("table_schema", "table_name").agg(columns.alias("_columns"))
            .select("table_schema", "table_name", F.col("_columns.column_name").alias("pk_columns")))


def object_counts(objs: DataFrame, keys=("db",)) -> DataFrame:
    return objs.groupBy(*keys).agg(*[
        F.count_if(F.col("section") == s).alias(f"{s}_count") for s in SECTIONS])


def ordered_names(objs: DataFrame, keys=("db",)) -> DataFrame:
    return objs.orderBy(*keys, "section", "name")


def schema_fingerprint(objs: DataFrame, keys=("db",), databases: DataFrame | None = None) -> DataFrame:
    """Digest of the ``section:name`` lines of a database, sorted, duplicates kept.

    Databases of ``databases`` without any object get the digest of the empty text.
    """
    lines = objs.withColumn("_line", F.concat_ws(":", "section", "name"))
    found = ordered_sha256(lines, list(keys), ["section", "name"], "_line", "schema_fingerprint")
    if databases is None:
        return found
    empty = F.sha2(F.lit(""), 256)
    return databases.select(*keys).join(found, list(keys), "left").withColumn(
        "schema_fingerprint", F.coalesce("schema_fingerprint", empty))


def estimated_row_counts(stats: DataFrame, keys=("db",)) -> DataFrame:
    """Sum of the stored row estimates of a database."""
    return stats.groupBy(*keys).agg(F.coalesce(F.sum("table_rows"), F.lit(0)).cast("bigint").alias("row_counts"))


def counted_or_estimated(estimates: DataFrame, exact: DataFrame, keys=("db",)) -> DataFrame:
    """Exact counts where there are any, estimates elsewhere, with the mode."""
    joined = estimates.join(exact.select(*keys, F.col("row_counts").alias("_exact")), list(keys), "full_outer")
    return joined.select(
        *keys, F.coalesce("_exact", "row_counts").alias("row_counts"),
        F.when(F.col("_exact").isNotNull(), "exact").otherwise("estimate").alias("row_count_mode"))
