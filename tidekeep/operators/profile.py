"""Profiles of tables: row counts and hashes of the first rows by key."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidekeep.session import union_all


def table_row_counts(spark: SparkSession, tables: dict[str, DataFrame], db: str) -> DataFrame:
    """Exact row count of every table, one job for all of them.

    Each table is read without any column, so Parquet answers from its
    footers, and counts are added up before the one shuffle.
    """
    names = spark.createDataFrame([(db, name) for name in sorted(tables)], "db string, table_name string")
    if not tables:
        return names.withColumn("row_count", F.lit(0).cast("bigint"))
    rows = union_all(df.select(F.lit(name).alias("table_name")) for name, df in tables.items())
    counts = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    return names.join(counts, "table_name", "left").select(
        "db", "table_name", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def db_row_counts(table_counts: DataFrame, keys=("db",)) -> DataFrame:
    """Total of a database and its map table -> count (as many entries as it has tables)."""
    entries = F.sort_array(F.collect_list(F.struct("table_name", "row_count")))
    return table_counts.groupBy(*keys).agg(
        F.sum("row_count").alias("row_counts"), F.map_from_entries(entries).alias("table_row_counts"))


def canonical_text(field: T.StructField) -> Column:
    """Text of a value that is the same in every engine and session."""
    return F.coalesce(_text(F.col(f"`{field.name}`"), field.dataType), F.lit("NULL"))


def _text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(value.cast("double").try_cast("decimal(38,6)").cast("string"), value.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda v: F.coalesce(_text(v, kind.elementType), F.lit("NULL")))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(kind, T.StructType):
        parts = [F.coalesce(_text(value[f.name], f.dataType), F.lit("NULL")) for f in kind.fields]
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    if isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.concat(
            _text(e["key"], kind.keyType), F.lit("="),
            F.coalesce(_text(e["value"], kind.valueType), F.lit("NULL")))))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return value.cast("string")


def row_text(df: DataFrame) -> Column:
    """Canonical text of a row, columns separated by tabs."""
    return F.concat_ws("\t", *[canonical_text(f) for f in df.schema.fields])


def head_by_key(table: DataFrame, pk: list[str], n: int) -> DataFrame:
    """The first n rows by key. The n-th key is found from the first key column alone, by a subquery of the same job;
    Parquet then skips the row groups behind it."""
    first = F.col(f"`{pk[0]}`")
    bound = table.select(first.alias("_k")).orderBy("_k").limit(n).agg(F.max("_k")).scalar()
    return table.where(first.isNull() | (first <= bound)).orderBy(*pk).limit(n)


def table_sample_hash(table: DataFrame, pk: list[str], n: int) -> DataFrame:
    """Digest of the first n rows by key, one line per row; n bounds what is gathered."""
    keys = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(pk)]
    rows = head_by_key(table, pk, n).select(F.struct(*keys, row_text(table).alias("_line")).alias("_row"))
    lines = F.transform(F.sort_array(F.collect_list("_row")), lambda r: F.concat(r["_line"], F.lit("\n")))
    return rows.agg(F.sha2(F.array_join(lines, ""), 256).alias("sample_hash"))


def sample_row_hashes(spark: SparkSession, tables: dict[str, DataFrame], pk_columns: dict[str, list[str]],
                      n: int, db: str) -> DataFrame:
    """Sample digest of every table that has a key; empty when n is below one."""
    hashes = [table_sample_hash(df, pk_columns[name], n).select(
                  F.lit(db).alias("db"), F.lit(name).alias("table_name"), "sample_hash")
              for name, df in sorted(tables.items()) if n >= 1 and pk_columns.get(name)]
    if not hashes:
        return spark.createDataFrame([], "db string, table_name string, sample_hash string")
    return union_all(hashes)
