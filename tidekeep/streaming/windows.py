"""Windowed streams: gauge ticks and daily log totals."""

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidekeep.functions.text import contains_any
from tidekeep.operators.filters import FAILURE_WORDS
from tidekeep.operators.metrics import NAMES


def live_metric_snapshot(samples: DataFrame, key="host", late: str = "10 seconds", tick: str = "5 seconds",
                         names=NAMES, tie="value") -> DataFrame:
    """Per host and tick the last value of each gauge, whether a run is on and for how long."""
    def last(name):
        mine = F.col("metric") == name
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.struct("ts", tie))).alias(name)

    ticks = samples.withWatermark("ts", late).groupBy(F.window("ts", tick), key).agg(*map(last, names))
    running, started = "backup_run_in_progress", "backup_current_run_start_timestamp"
    on = F.coalesce(F.col(running) == 1, F.lit(False)) if running in names else F.lit(False)
    elapsed = (F.when(on & (F.col(started) > 0), F.unix_timestamp(F.col("window.end")) - F.col(started))
               if started in names else F.lit(None).cast("double"))
    return ticks.select(key, F.col("window.start").alias("tick_start"), F.col("window.end").alias("tick_end"),
                        *names, on.alias("in_progress"), elapsed.alias("elapsed_seconds"))


def daily_log_rollup(lines: DataFrame, key="host", run="run_id") -> DataFrame:
    """Lines, runs and failure lines per host and day, once the day is over.

    ``lines`` carries a watermark on ``ts``. Runs are summed up first, so a
    busy host is spread over its runs before its day is added up. Lines later
    than the watermark are not in the totals; ``late_lines`` counts them.
    """
    failing = contains_any(F.col("msg"), FAILURE_WORDS).cast("bigint")
    per_run = lines.groupBy(F.window("ts", "1 day"), key, run).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(failing).alias("failure_lines"))
    per_day = per_run.groupBy(F.window(F.window_time("window"), "1 day"), key).agg(
        F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("runs"), F.sum("failure_lines").alias("failure_lines"))
    return per_day.select(key, F.to_date("window.start").alias("day"), "lines", "runs", "failure_lines")


def late_lines(query) -> int:
    """Rows a running or finished query has dropped for being late, as far as its progress reports go back."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def _day_is_over(by):
    return F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY") <= F.lit(by)


def _edge(spark: SparkSession, folder: str, late: timedelta, before: int | None = None):
    """Time up to which lines are late: the greatest time of the batches (those below ``before``) less the delay."""
    seen = spark.read.schema("at timestamp, batch bigint").option("basePath", f"{folder}/seen").parquet(f"{folder}/seen")
    at = seen.where("true" if before is None else f"batch < {before}").agg(F.max("at")).first()[0]
    return None if at is None else at - late


def store_daily_lines(lines: DataFrame, folder: str, checkpoint: str, late: timedelta = timedelta(minutes=10),
                      key="host", run="run_id", **trigger):
    """Starts a query that keeps the counts of every micro-batch by run and day, and the late lines themselves.

    A line is late if its day was over by the batches before its own. Late lines are split off here, on the input side,
    so each is counted once however many aggregates follow and however many batches there are. Every batch has folders
    of its own (``totals``, ``late``, ``seen``), which it replaces when it runs again. Lines without a time are left out.
    """
    def store(batch: DataFrame, number: int):
        spark = batch.sparkSession
        edge = _edge(spark, folder, late, number) if number else None
        is_late = F.lit(False) if edge is None else _day_is_over(edge)
        timed = batch.where(F.col("ts").isNotNull()).withColumn("is_late", is_late).persist()
        failing = contains_any(F.col("msg"), FAILURE_WORDS).cast("bigint")
        timed.groupBy(key, run, F.to_date("ts").alias("day"), "is_late").agg(
            F.count(F.lit(1)).alias("lines"), F.sum(failing).alias("failure_lines")
        ).write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")
        timed.where("is_late").drop("is_late").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        timed.agg(F.max("ts").alias("at")).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        timed.unpersist()

    return (lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def daily_totals(spark: SparkSession, folder: str, late: timedelta = timedelta(minutes=10), key="host", run="run_id") -> DataFrame:
    """Per host and day that is over: lines, runs and failure lines in time, and the number of late lines."""
    totals = spark.read.option("basePath", f"{folder}/totals").parquet(f"{folder}/totals")
    in_time = ~F.col("is_late")
    per_run = totals.groupBy(key, run, "day").agg(
        F.sum(F.when(in_time, F.col("lines"))).alias("lines"), F.sum(F.when(in_time, F.col("failure_lines"))).alias("failure_lines"),
        F.sum(F.when(F.col("is_late"), F.col("lines"))).alias("late_lines"))
    per_day = per_run.groupBy(key, "day").agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.count("lines").alias("runs"),
        F.coalesce(F.sum("failure_lines"), F.lit(0)).alias("failure_lines"), F.coalesce(F.sum("late_lines"), F.lit(0)).alias("late_lines"))
    return per_day.where(F.col("day").cast("timestamp") + F.expr("INTERVAL 1 DAY") <= F.lit(_edge(spark, folder, late)))
