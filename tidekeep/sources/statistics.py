"""What is known of tables without reading their rows: row estimates and primary keys."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidekeep.operators.catalog import primary_keys
from tidekeep.session import union_all
from tidekeep.sources.artifacts import _locate
from tidekeep.sources.tables import TableSource

KEY_MARK = "primary_key"
ROWS = "table_name string, table_rows bigint"


def footer_rows(paths: DataFrame) -> DataFrame:
    """Adds the number of rows in the footer of each Parquet file (column ``path``); a broken file has none.

    Returns (table_name, table_rows) of each file; only footers are read, by the tasks.
    """
    def rows(batches):
        for batch in batches:
            names, counts = batch.column("table_name"), []
            for path in batch.column("path").to_pylist():
                filesystem, name = _locate(path)
                try:
                    with filesystem.open_input_file(name) as file:
                        counts.append(pq.ParquetFile(file).metadata.num_rows)
                except (OSError, pa.ArrowException):  # an estimate does without it
                    counts.append(None)
            yield pa.RecordBatch.from_arrays([names, pa.array(counts, pa.int64())], names=["table_name", "table_rows"])

    return paths.select("table_name", "path").mapInArrow(rows, ROWS)


def table_statistics(spark: SparkSession, source: TableSource, tables: list[str]) -> DataFrame:
    """Stored row estimates (table_name, table_rows) of tables; NULL where nothing is stored.

    Folders answer from Parquet footers, a catalogue from its statistics, a JDBC source from the server's.
    """
    if not tables:
        return spark.createDataFrame([], ROWS)
    if source.folder:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "*.parquet").load([f"{source.folder}/{name}.parquet" for name in tables]).select("path"))
        base = source.folder.rstrip("/").rsplit("/", 1)[-1]
        name = F.regexp_replace(F.regexp_extract("path", rf"/\Q{base}\E/([^/]+)", 1), r"\.parquet$", "")
        return footer_rows(files.select(name.alias("table_name"), "path")).groupBy("table_name").agg(
            F.sum("table_rows").alias("table_rows"))
    if source.database:
        def stored(name):
            told = spark.sql(f"DESCRIBE EXTENDED `{source.database}`.`{name}`").where("col_name = 'Statistics'")
            rows = F.regexp_extract("data_type", r"(\d+) rows", 1).try_cast("bigint")
            return told.agg(F.max(rows).alias("table_rows")).select(F.lit(name).alias("table_name"), "table_rows")
        return union_all([stored(name) for name in tables])
    if source.jdbc_url.startswith("jdbc:postgresql:"):
        query = ("SELECT c.relname AS table_name, CAST(c.reltuples AS bigint) AS table_rows FROM pg_class c "
                 "JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind = 'r' AND n.nspname = 'public'")
    else:
        query = ("SELECT table_name AS table_name, table_rows AS table_rows FROM information_schema.tables "
                 "WHERE table_type = 'BASE TABLE' AND table_schema = DATABASE()")
    found = spark.read.jdbc(source.jdbc_url, f"({query}) t", properties=source.jdbc_properties)
    return found.where(F.col("table_name").isin(tables))


def declare_key(table: DataFrame, columns: list[str]) -> DataFrame:
    """Marks the primary key, in this order, in the columns' metadata, which Parquet files and catalogues keep."""
    for place, name in enumerate(columns, 1):
        table = table.withMetadata(name, {**table.schema[name].metadata, KEY_MARK: place})
    return table


def declared_key(table: DataFrame) -> list[str]:
    marked = [(field.metadata[KEY_MARK], field.name) for field in table.schema.fields if KEY_MARK in field.metadata]
    return [name for _, name in sorted(marked)]


def discover_keys(spark: SparkSession, source: TableSource, tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Primary keys of the tables that have one: from the server of a JDBC source, else as marked by ``declare_key``."""
    if not source.jdbc_url:
        return {name: key for name, table in tables.items() if (key := declared_key(table))}

    def schema_table(name, columns):
        query = f"SELECT {', '.join(f'{c} AS {c}' for c in columns)} FROM information_schema.{name}"
        return spark.read.jdbc(source.jdbc_url, f"({query}) t", properties=source.jdbc_properties)

    on = ["table_schema", "table_name", "constraint_name"]
    keys = primary_keys(schema_table("table_constraints", [*on, "constraint_type"]),
                        schema_table("key_column_usage", [*on, "column_name", "ordinal_position"]))
    rows = keys.where(F.col("table_name").isin(list(tables))).collect()  # one row a table of the database
    return {row["table_name"]: list(row["pk_columns"]) for row in rows}
