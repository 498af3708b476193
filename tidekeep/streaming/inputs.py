"""Live sources: run logs and run history as files arrive."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidekeep import schemas
from tidekeep.sources.files import record_defaults, split_log_line


def stream_run_logs(spark: SparkSession, folder: str, late: str = "10 minutes", name_filter: str = "*_*.log",
                    **options) -> DataFrame:
    """Lines (host, run_id, ts, msg, arrived) of the per-run logs; their time is the one they carry.

    Lines of another shape have no ``ts``, so they never move the watermark and no window counts them; ``arrived`` is
    the time of their file.
    """
    lines = (spark.readStream.format("text").option("pathGlobFilter", name_filter).option("lineSep", "\n")
             .option("recursiveFileLookup", True).options(**options).load(folder))
    named = lines.select(F.rtrim("value", F.lit("\r")).alias("value"), F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_modification_time").alias("arrived"))
    parsed = split_log_line(named)
    return parsed.select(
        F.regexp_extract("_file", r"([^/]+)/[^/]+\.log$", 1).alias("host"),
        F.regexp_extract("_file", r"([^/]+)\.log$", 1).alias("run_id"), "ts", "msg", "arrived").withWatermark("ts", late)


def stream_run_history(spark: SparkSession, folder: str, late: str = "1 hour", **options) -> DataFrame:
    """Run records as they are appended; a record seen again within the delay comes out once.

    A later record of a run (another time or status) comes out too: the last one counts, as in ``keep_last``.
    """
    runs = record_defaults(spark.readStream.schema(schemas.RUN).options(**options).json(folder))
    return (runs.withColumns({"host": F.col("hostname"), "ts": F.col("timestamp")})
            .withWatermark("ts", late).dropDuplicatesWithinWatermark(["host", "run_id", "ts", "status"]))
