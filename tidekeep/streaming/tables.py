"""Run history kept up to date by a stream of changes."""

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidekeep.operators.runs import upsert_run_history


def upsert_stream(changes: DataFrame, folder: str, checkpoint: str, **trigger):
    """Starts a query that stores every micro-batch of changes under its stream and batch number.

    A stream is known by its checkpoint, so streams with checkpoints of their
    own never write over each other. A batch that is run again replaces its
    own folder, so each change counts once. The history itself is not rewritten by every batch; see
    ``current_history`` and ``compact_history``.
    """
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def store(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{folder}/stream=s{stream}/batch={batch_id}")

    return (changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stored_changes(spark: SparkSession, folder: str, applied: str | None = None) -> DataFrame | None:
    """The stored changes with their ``stream`` and ``batch``; without those that a compaction contains."""
    try:
        changes = spark.read.option("basePath", folder).parquet(f"{folder}/stream=*/batch=*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if applied is not None:
        done = spark.read.parquet(f"{applied}.applied").select("stream", F.col("batch").alias("_done"))
        changes = changes.join(done, "stream", "left").where("_done IS NULL OR batch > _done").drop("_done")
    return changes


def current_history(spark: SparkSession, history: DataFrame, folder: str, keys=("host", "run_id"),
                    order=("ts",), applied: str | None = None) -> DataFrame:
    """The history with the stored changes applied; the change of the latest batch wins.

    ``applied`` is the target of the compaction that ``history`` comes from: only later changes are applied to it.
    """
    changes = stored_changes(spark, folder, applied)
    if changes is None:
        return history
    fields = [c for c in changes.columns if c not in keys and c not in ("batch", "stream")]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct("batch", *fields)).alias("_row"))
    return upsert_run_history(history, latest.select(*keys, "_row.*"), keys, order)


def compact_history(spark: SparkSession, history: DataFrame, folder: str, target: str, **options) -> DataFrame:
    """Writes the current history to a folder of its own and reads it back.

    ``<target>.applied`` keeps the last batch of each stream that it contains; it is read before the changes are, so
    changes that arrive meanwhile are applied once more rather than lost.
    """
    changes = stored_changes(spark, folder)
    schema = "stream string, batch int"
    last = spark.createDataFrame([], schema) if changes is None else \
        changes.groupBy("stream").agg(F.max("batch").cast("int").alias("batch")).select("stream", "batch")
    spark.createDataFrame(last.collect(), schema).write.mode("errorifexists").parquet(f"{target}.applied")  # a row a stream
    current_history(spark, history, folder, **options).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)
