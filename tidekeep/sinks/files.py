"""File sinks: snapshots, manifests, history, gauge text, upload plans."""

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidekeep.functions.text import object_key
from tidekeep.operators.metrics import GAUGES, ROW_GAUGE
from tidekeep.sources.artifacts import file_sha256


COMMITS, STAGING = "_commits", "_staging"


def _filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _delete(spark: SparkSession, path: str) -> None:
    system, found = _filesystem(spark, path)
    system.delete(found, True)


def move_file(spark: SparkSession, source: str, target: str) -> None:
    """Moves one file, over one that is there; folders of the target are made."""
    system, place = _filesystem(spark, target)
    system.mkdirs(place.getParent())
    for name in (target, f"{target.rsplit('/', 1)[0]}/.{target.rsplit('/', 1)[1]}.crc"):  # a checksum of the old bytes
        _delete(spark, name)
    if not system.rename(_filesystem(spark, source)[1], place):
        raise OSError(f"could not move {source} to {target}")


def export_tables(spark: SparkSession, tables: dict[str, DataFrame], target: str, run_id: str, db: str,
                  codec: str = "zstd", parallel: int = 4) -> DataFrame:
    """Publishes every table as ``<target>/<run>/<db>/<table>``, all or none, and lists (table, files, bytes).

    Tables are written to a staging folder of this attempt, which is moved to its place when all are there; last, a
    commit record with a row for each file is written. Readers follow the record (``committed_parts``,
    ``read_export``), so they see nothing of an attempt that fails at any point; its files are removed here or, if the
    driver was lost, by ``clean_exports``. Several tables are written at a time so that small ones do not leave the
    cluster idle.
    """
    root, folder = f"{target}/{run_id}", f"{target}/{run_id}/{db}"
    record = f"{root}/{COMMITS}/{db}"
    system, place = _filesystem(spark, folder)
    if system.exists(_filesystem(spark, f"{record}/_SUCCESS")[1]):
        raise FileExistsError(f"{folder} is already published")
    for left in (folder, record):  # of an attempt whose driver was lost
        _delete(spark, left)
    staged = f"{root}/{STAGING}-{db}-{uuid.uuid4().hex}"

    def write(item):
        name, df = item
        df.write.mode("errorifexists").option("compression", codec).parquet(f"{staged}/{name}")

    try:
        system.mkdirs(_filesystem(spark, staged)[1])
        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(write, tables.items()))
        if not system.rename(_filesystem(spark, staged)[1], place):
            raise OSError(f"could not move {staged} to {folder}")
        parts = _listed_parts(spark, folder)
        missing = set(tables) - {r.table_name for r in parts.select("table_name").distinct().collect()}
        if missing:
            raise OSError(f"export wrote no file for table {min(missing)}")
        file_sha256(parts).drop("path").write.parquet(record)
    except BaseException:
        for left in (staged, folder, record):
            _delete(spark, left)
        raise
    return spark.read.parquet(record).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def _listed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The data files of an export: (table_name, part, path, bytes)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.parquet").load(folder).select("path", "length"))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("table_name"),
                        F.regexp_extract("path", r"([^/]+)$", 1).alias("part"), "path", F.col("length").alias("bytes"))


def committed_parts(spark: SparkSession, target: str, run_id: str, db: str) -> DataFrame:
    """The commit record of an export: (table_name, part, bytes, sha256); an error where there is none."""
    return spark.read.parquet(f"{target}/{run_id}/{COMMITS}/{db}")


def read_export(spark: SparkSession, target: str, run_id: str, db: str) -> dict[str, DataFrame]:
    """The tables of a published export; none of an export without a commit record."""
    system, found = _filesystem(spark, f"{target}/{run_id}/{COMMITS}/{db}/_SUCCESS")
    if not system.exists(found):
        return {}
    names = committed_parts(spark, target, run_id, db).select("table_name").distinct().collect()
    return {r.table_name: spark.read.parquet(f"{target}/{run_id}/{db}/{r.table_name}") for r in names}


def clean_exports(spark: SparkSession, target: str, run_id: str) -> list[str]:
    """Removes what lost attempts of a run left: staging folders and databases without a commit record; names them.

    Only for runs that no job writes any more.
    """
    system, root = _filesystem(spark, f"{target}/{run_id}")
    removed = []
    if system.exists(root):
        for status in system.listStatus(root):
            name = status.getPath().getName()
            done = system.exists(_filesystem(spark, f"{target}/{run_id}/{COMMITS}/{name}/_SUCCESS")[1])
            if status.isDirectory() and name != COMMITS and not done:
                system.delete(status.getPath(), True)
                removed.append(name)
    return sorted(removed)


def _without_zeros(df: DataFrame) -> DataFrame:
    """Zero numbers as NULL, which JSON leaves out; counts of a run are always written."""
    always = {"databases_total", "databases_succeeded", "databases_failed"}
    return df.select(*[
        F.nullif(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType)) and f.name not in always else F.col(f.name)
        for f in df.schema.fields])


def write_manifests(runs: DataFrame, root: str) -> None:
    """One manifest file per run of a host in ``<root>/host=<host>/run=<run>/``; the record itself is whole."""
    placed = _without_zeros(runs).withColumns({"host": F.coalesce("hostname", F.lit("")), "run": F.col("run_id")})
    placed.repartition("host", "run").write.mode("append").option("maxRecordsPerFile", 1).partitionBy("host", "run").json(root)


def append_run_history(runs: DataFrame, path: str) -> None:
    """Adds run records; skipped runs are not recorded."""
    _without_zeros(runs.where(F.col("status") != "skipped")).write.mode("append").json(path)


def write_history_version(history: DataFrame, root: str, version: str) -> str:
    """A whole history in a folder of its own; readers switch when it is complete."""
    path = f"{root}/version={version}"
    history.write.mode("errorifexists").parquet(path)
    return path


def metric_text(samples: DataFrame) -> DataFrame:
    """Lines (host, gauge place, part, line) of the text form: help, type, then one line per sample.

    ``samples`` has host, metric, value, ``labels`` as text, and optionally ``database``.
    """
    rows = [(i, name, help_text, decimals) for i, (name, help_text, decimals) in enumerate([*GAUGES, ROW_GAUGE])]
    known = samples.sparkSession.createDataFrame(rows, "place int, metric string, help string, decimals int")
    named = samples.join(F.broadcast(known), "metric")  # 29 fixed rows
    database = F.col("database") if "database" in samples.columns else F.lit(None).cast("string")
    labels = F.concat_ws(",", "labels", F.when(database.isNotNull(), F.concat(F.lit('database="'), database, F.lit('"'))))
    number = (F.when(F.col("decimals") == 0, F.col("value").cast("bigint").cast("string"))
              .otherwise(F.format_string("%.3f", "value")))
    line = F.concat(F.col("metric"), F.lit("{"), labels, F.lit("} "), number)
    heads = named.select("host", "place", "metric", "help").distinct().select("host", "place", F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.concat_ws(" ", F.lit("# HELP"), "metric", "help").alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat_ws(" ", F.lit("# TYPE"), "metric", F.lit("gauge")).alias("line")))))
    return heads.unionByName(named.select("host", "place", F.lit(2).alias("part"), line.alias("line")))


def write_metric_text(samples: DataFrame, path: str) -> None:
    """One gauge file per host in ``<path>/host=<host>/``; a host has a few dozen gauges and its databases."""
    lines = metric_text(samples).repartition("host").sortWithinPartitions("host", "place", "part", "line")
    lines.select("host", "line").write.mode("overwrite").partitionBy("host").text(path)


def plan_upload(artifacts: DataFrame, prefix: str, run="run_id", rel="rel_path", size="size", host: str | None = None) -> DataFrame:
    """Object key and size of every file of a run.

    Runs of several hosts may have one id: name the column ``host`` to put it in front of the run in the key.
    """
    place = F.lit(prefix) if host is None else F.concat_ws("/", F.nullif(F.btrim(F.lit(prefix), F.lit("/ ")), F.lit("")), host)
    kept = [run, rel] if host is None else [host, run, rel]
    return artifacts.select(*kept, object_key(place, run, rel).alias("object_key"), F.col(size).alias("size"))


def expire_runs(table: DataFrame, expired: DataFrame, keys=("host", "run_id")) -> DataFrame:
    """The rows of a table that stay when the expired runs are removed."""
    return table.join(expired.select(*keys), list(keys), "left_anti")


def drop_expired(table: DataFrame, expired: DataFrame, root: str, version: str, keys=("host", "run_id")) -> str:
    """Writes what stays as a new version of the table."""
    return write_history_version(expire_runs(table, expired, keys), root, version)


def _fixed_key(key: str):
    """32 key bytes: cut, or filled up with NUL."""
    return F.lit(bytearray(key.encode()[:32].ljust(32, b"\0")))


def encrypt_columns(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """AES-GCM per value with a random vector in front; take hashes before."""
    return df.withColumns({c: F.aes_encrypt(F.col(c).cast("string").cast("binary"), _fixed_key(key), F.lit("GCM"))
                           for c in cols})


def decrypt_columns(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    return df.withColumns({c: F.aes_decrypt(F.col(c), _fixed_key(key), F.lit("GCM")).cast("string") for c in cols})
