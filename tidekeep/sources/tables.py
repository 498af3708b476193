"""Table sources: folders of Parquet, catalogue databases and JDBC."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass
class TableSource:
    """Where tables come from; exactly one of the three is set.

    ``folder`` holds one Parquet file or folder per table. A snapshot is
    consistent when the source does not change meanwhile: an immutable folder,
    a versioned table, or a JDBC source that is not written to.
    """

    folder: str | None = None
    database: str | None = None
    jdbc_url: str | None = None
    jdbc_properties: dict = field(default_factory=dict)


def discover_tables(spark: SparkSession, source: TableSource) -> DataFrame:
    """Tables and views of a source in name order: (section, name)."""
    if source.folder:
        below = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "*.parquet").load(source.folder).select("path"))
        base = source.folder.rstrip("/").rsplit("/", 1)[-1]
        first = F.regexp_extract("path", rf"/{base}/([^/]+)", 1)
        found = below.select(F.lit("table").alias("section"), F.regexp_replace(first, r"\.parquet$", "").alias("name"))
        return found.distinct().orderBy("name")
    if source.database:
        listed = spark.sql(f"SHOW TABLES IN `{source.database}`").select(F.col("tableName").alias("name"))
        views = spark.sql(f"SHOW VIEWS IN `{source.database}`").select(F.col("viewName").alias("name"))
        tables = listed.join(views, "name", "left_anti").select(F.lit("table").alias("section"), "name")
        return tables.union(views.select(F.lit("view").alias("section"), "name")).orderBy("name")
    query = ("SELECT table_name AS name, CASE table_type WHEN 'VIEW' THEN 'view' ELSE 'table' END AS section "
             "FROM information_schema.tables WHERE table_type IN ('BASE TABLE', 'VIEW')")
    found = spark.read.jdbc(source.jdbc_url, f"({query}) t", properties=source.jdbc_properties)
    return found.select("section", "name").orderBy("name")


def scan_tables(spark: SparkSession, source: TableSource, tables: list[str],
                partitioning: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """One lazy frame per table. ``partitioning`` gives JDBC tables their
    column, lowerBound, upperBound and numPartitions."""
    def scan(name):
        if source.folder:
            return spark.read.parquet(f"{source.folder}/{name}.parquet")
        if source.database:
            return spark.table(f"`{source.database}`.`{name}`")
        return spark.read.jdbc(source.jdbc_url, name, properties=source.jdbc_properties,
                               **(partitioning or {}).get(name, {}))
    return {name: scan(name) for name in tables}
