"""Run history in hash buckets: an update rewrites the buckets its keys fall into, and no others.

Below ``root``, ``data/<id>/_bucket=<n>/`` holds the rows of a bucket as one update left them, and
``manifest/version=<n>/`` is one file that names the folder of every bucket. Readers follow the newest manifest. It is
written last and as a whole, so an update that fails leaves the version before it, and running it again is safe.

Rules for odd input: rows with a null in a key have a bucket too, but no change meets them. Repeated rows of the
history are kept. Several changes of one key are not allowed for; give the last of each. No changes, or only such of
buckets without rows, make no new version. One writer at a time; readers never wait.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidekeep.operators.runs import upsert_run_history

BUCKETS, SHARES = 256, 8
MANIFEST = "version int, buckets int, bucket int, path string, rows bigint"


def bucket_of(keys, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The newest manifest: a row a bucket that has rows; empty where nothing was written."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], MANIFEST)
        raise
    newest = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == F.lit(newest))


def _write(history: DataFrame, root: str, keys, buckets: int) -> list:
    """Writes rows by bucket into a folder of its own; (bucket, path, rows) of each.

    A key that holds many rows is written by several tasks: rows of a bucket are dealt by all their columns.
    """
    spark, folder = history.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    named = history.withColumn("_bucket", bucket_of(keys, buckets))
    share = F.pmod(F.hash(*[F.col(c).cast("string") for c, kind in history.dtypes if not kind.startswith("map")]), F.lit(SHARES))
    named.repartition("_bucket", share).write.partitionBy("_bucket").parquet(folder)
    schema = named.select(*history.columns, "_bucket").schema
    counts = spark.read.schema(schema).parquet(folder).groupBy("_bucket").count().collect()  # a row a bucket
    return [(r["_bucket"], f"{folder}/_bucket={r['_bucket']}", r["count"]) for r in counts]


def _commit(spark: SparkSession, root: str, version: int, buckets: int, entries: list) -> None:
    rows = spark.createDataFrame([(buckets, *e) for e in sorted(entries)], "buckets int, bucket int, path string, rows bigint")
    rows.coalesce(1).write.mode("overwrite").json(f"{root}/manifest/version={version}")


def write_buckets(history: DataFrame, root: str, keys=("host", "run_id"), buckets: int = BUCKETS) -> None:
    """Stores a history as the next version, whatever was there before."""
    spark = history.sparkSession
    version = manifest(spark, root).agg(F.max("version")).first()[0] or 0
    _commit(spark, root, version + 1, buckets, _write(history, root, list(keys), buckets))


def read_buckets(spark: SparkSession, root: str, only=None) -> DataFrame:
    """The history as the newest manifest has it, or the rows of some buckets."""
    entries = manifest(spark, root)
    paths = [r["path"] for r in (entries if only is None else entries.where(F.col("bucket").isin(list(only)))).collect()]
    if not paths:
        raise ValueError(f"no stored rows below {root}")
    return spark.read.parquet(*paths)


def update_buckets(changes: DataFrame, root: str, keys=("host", "run_id"), order=("ts",)) -> list[int]:
    """Gives the last record of every changed run its new fields; the buckets rewritten, in order.

    What is read and written grows with the buckets touched, not with the history.
    """
    spark, keys = changes.sparkSession, list(keys)
    stored = manifest(spark, root).collect()  # a row a bucket
    if not stored:
        return []
    buckets, version = stored[0]["buckets"], stored[0]["version"]
    hit = {r[0] for r in changes.select(bucket_of(keys, buckets)).distinct().collect()}  # ``buckets`` at most
    touched = [r for r in stored if r["bucket"] in hit]
    if not touched:
        return []
    part = spark.read.parquet(*[r["path"] for r in touched])
    new = _write(upsert_run_history(part, changes, keys, order), root, keys, buckets)
    _commit(spark, root, version + 1, buckets,
            new + [(r["bucket"], r["path"], r["rows"]) for r in stored if r["bucket"] not in hit])
    return sorted(r["bucket"] for r in touched)


def update_stream(changes: DataFrame, root: str, checkpoint: str, keys=("host", "run_id"), order=("ts",),
                  newest: Column | None = None, **trigger):
    """Starts a query that applies every micro-batch; of several changes of a run the one with the greatest ``newest``
    counts (default: all its fields in their order). A batch that is run again sets the same fields again."""
    keys = list(keys)
    fields = [c for c in changes.columns if c not in keys]

    def apply(batch: DataFrame, _: int):
        row = F.struct(*fields)
        last = batch.groupBy(*keys).agg(F.max_by(row, row if newest is None else newest).alias("_row")).select(*keys, "_row.*")
        update_buckets(last, root, keys, order)

    return (changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
