"""Runs a stream over everything that has arrived and hands back what it wrote."""

from pyspark.sql import DataFrame

from tidekeep.session import work_path


def run_available(stream: DataFrame, label: str, passes: int = 1):
    """Processes all available input into files of the shared folder.

    Returns the written rows and the last query.
    """
    spark = stream.sparkSession
    out, checkpoint = work_path(spark, label), work_path(spark, f"{label}-checkpoint")
    for _ in range(passes):
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query
