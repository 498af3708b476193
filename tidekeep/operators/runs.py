"""Runs, their results, attempts and history."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidekeep.functions.outcomes import execution_source, final_outcome, is_rate_limited
from tidekeep.functions.text import blank, strip
from tidekeep.operators.running import MONTH, Running, running, time_chunk


def explode_results(runs: DataFrame) -> DataFrame:
    """One row per database result of a run; runs without results keep one row."""
    rows = runs.select("host", "run_id", F.posexplode_outer("results").alias("position", "result"))
    return rows.select("host", "run_id", "position", "result.*")


def run_rollup(results: DataFrame, keys=("run_id",)) -> DataFrame:
    """Databases of a run: all, succeeded, and everything else as failed."""
    good = F.col("status") == "success"
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("databases_total"),
        F.count_if(good).alias("databases_succeeded"),
        F.count_if(F.coalesce(~good, F.lit(True))).alias("databases_failed"))


def with_rollup(runs: DataFrame, results: DataFrame, keys=("run_id",)) -> DataFrame:
    """Runs with their database counts, zero where a run has no results."""
    counts = ["databases_total", "databases_succeeded", "databases_failed"]
    joined = runs.join(run_rollup(results, keys), list(keys), "left")
    return joined.fillna(0, subset=counts)


def run_status(rollup: DataFrame) -> DataFrame:
    """Sets ``status`` and, where none is given, ``failure_reason`` from the counts."""
    failed, good = F.col("databases_failed"), F.col("databases_succeeded")
    reason = F.col("failure_reason") if "failure_reason" in rollup.columns else F.lit(None).cast("string")
    no_reason = F.coalesce(reason, F.lit("")) == ""
    status = F.when((failed == 0) & no_reason, "success").when(good > 0, "partial").otherwise("failed")
    counted = F.format_string("%d of %d database backups failed", failed, F.col("databases_total"))
    return rollup.withColumns({
        "status": status,
        "failure_reason": F.when(no_reason & (failed > 0), counted).when(no_reason, "").otherwise(reason),
    })


def apply_upload_failure(runs: DataFrame, error="logical_upload_error") -> DataFrame:
    """A failed upload fails a successful run; a partial one stays partial."""
    failed = ~blank(error)
    no_reason = F.coalesce(F.col("failure_reason"), F.lit("")) == ""
    return runs.withColumns({
        "status": F.when(failed & (F.col("status") == "success"), "failed").otherwise(F.col("status")),
        "failure_reason": F.when(failed & no_reason,
                                 F.concat(F.lit("logical backup upload failed: "), F.col(error)))
                           .otherwise(F.col("failure_reason")),
    })


def run_view(runs: DataFrame) -> DataFrame:
    """Run rows with the line that says how the run ended."""
    return runs.withColumn("final_outcome", final_outcome(
        "status", "databases_total", "databases_failed", "failure_reason", "cleanup_error",
        "logical_upload_error"))


def history_view(runs: DataFrame) -> DataFrame:
    return runs.select(
        "host", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), "status",
        F.concat_ws("/", "databases_succeeded", "databases_total").alias("dbs"), "duration", "run_id")


def policy_violations(runs: DataFrame, allow_root: bool = False) -> DataFrame:
    """Scheduled runs executed as root where that is not allowed."""
    if allow_root:
        return runs.where(F.lit(False))
    return runs.where((execution_source("execution_source") == "runner") & (strip("os_user") == "root"))


def hosts_with_several_users(runs: DataFrame) -> DataFrame:
    """Hosts whose runs were started by more than one user."""
    return (runs.groupBy("host").agg(F.count_distinct("os_user").alias("users"),
                                     F.count(F.lit(1)).alias("runs"))
            .where("users > 1"))


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """The last row per key; combines before it shuffles, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*").select(*df.columns)


def latest_run(runs: DataFrame) -> DataFrame:
    return keep_last(runs, ["host"], ["ts", "run_id"])


def run_by_id(runs: DataFrame, run_id, order=("ts",)) -> DataFrame:
    """The last record of a run id, per host."""
    return keep_last(runs.where(F.col("run_id") == F.lit(run_id)), ["host", "run_id"], order)


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """The newest runs of each host with their place, newest first."""
    newest = W.partitionBy("host").orderBy(F.desc("ts"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def total_artifact_size(results: DataFrame, keys=("run_id",)) -> DataFrame:
    size = F.sum(F.when(F.col("size_bytes") > 0, F.col("size_bytes")))
    return results.groupBy(*keys).agg(F.coalesce(size, F.lit(0)).cast("bigint").alias("size_bytes"))


def folder_size(inventory: DataFrame, keys=("host", "run_id")) -> DataFrame:
    """Bytes below a run folder; directories do not count."""
    size = F.sum(F.when(~F.col("is_dir"), F.col("size")))
    return inventory.groupBy(*keys).agg(F.coalesce(size, F.lit(0)).cast("bigint").alias("bytes"))


def upload_totals(plan: DataFrame, keys=("run_id",)) -> DataFrame:
    return plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("uploaded"), F.sum("size").alias("uploaded_bytes"))


def number_attempts(attempts: DataFrame, keys=("run_id", "name"),
                    order=("attempt_key", "status", "error")) -> DataFrame:
    """Attempt number in the given order; equal rows are numbered through."""
    grouped = attempts.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_copies"))
    chunk = F.floor(F.col(order[0]) / 1024).cast("bigint")
    counted = running(grouped, list(keys), list(order), {"_upto": Running("sum", F.col("_copies"))}, chunk)
    numbers = F.sequence(F.col("_upto") - F.col("_copies") + 1, F.col("_upto"))
    return counted.withColumn("attempt", F.explode(numbers)).drop("_copies", "_upto")


def final_attempt(attempts: DataFrame, keys=("run_id", "name")) -> DataFrame:
    """Per database the successful attempt, else the last one, with the number of attempts."""
    good = F.col("status") == "success"
    rank = F.struct(good.alias("good"), F.col("attempt"))
    return attempts.groupBy(*keys).agg(
        F.max_by("attempt", rank).alias("attempt"),
        F.max_by("status", rank).alias("status"),
        F.max_by(F.struct("error"), rank).getField("error").alias("error"),
        F.count(F.lit(1)).alias("attempts"))


def attempt_rollup(attempts: DataFrame, allowed: int = 3, keys=("run_id", "name")) -> DataFrame:
    """Attempts used, and retries caused by throttling: not those of the last allowed attempt."""
    retried = (F.col("status") != "success") & is_rate_limited("error") & (F.col("attempt") < allowed)
    return attempts.groupBy(*keys).agg(F.max("attempt").alias("attempts"),
                                       F.count_if(retried).alias("rate_limit_retries"))


def runs_with_validation(runs: DataFrame, validations: DataFrame, keys=("run_id",), order=("checked_at",)) -> DataFrame:
    """Runs with their latest validation."""
    fields = ["validation_checked_at", "validation_mode", "validation_status", "validation_error"]
    present = [c for c in fields if c in validations.columns]
    last = keep_last(validations.select(*keys, *present, *[c for c in order if c not in present]),
                     list(keys), list(order))
    return runs.join(last.select(*keys, *present), list(keys), "left")


def upsert_run_history(history: DataFrame, changes: DataFrame, keys=("host", "run_id"),
                       order=("ts",)) -> DataFrame:
    """History in which the last record of every changed run has its new fields.

    Other records, older ones of the same run too, stay as they are. Changes
    whose run is not in the history have no effect (see ``unknown_changes``).
    """
    keys, fields = list(keys), [c for c in changes.columns if c not in keys]
    position = F.struct(*order)
    last = (history.join(changes.select(*keys), keys, "left_semi")
            .groupBy(*keys).agg(F.max(position).alias("_last")))
    new = changes.join(last, keys).select(
        *keys, "_last", *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = history.join(new, keys, "left")
    hit = F.col("_last").isNotNull() & (position == F.col("_last"))
    return joined.select(*[
        F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in history.columns])


def unknown_changes(history: DataFrame, changes: DataFrame, keys=("host", "run_id")) -> DataFrame:
    return changes.join(history.select(*keys), list(keys), "left_anti")


def full_success():
    """Success of a run: a needed upload must have worked too (column ``uploaded``, NULL where not needed)."""
    return (F.col("status") == "success") & F.coalesce(F.col("uploaded"), F.lit(True))


def carried_values(runs: DataFrame) -> dict[str, Running]:
    """What a run inherits from the runs before it, and what it sets itself."""
    columns, own = runs.columns, F.col("status") != "skipped"
    success = full_success() if "uploaded" in columns else F.col("status") == "success"
    made_folder = own & ~blank("run_folder") if "run_folder" in columns else own
    values = {
        "last_success": Running("last", F.when(success, F.col("ts"))),
        "last_cleanup": Running("last", F.when(made_folder, F.col("ts"))),
    }
    if "validation_status" in columns:
        status = F.col("validation_status")
        values["validation_gauge"] = Running("last", F.when(status == "success", 1).when(status == "failed", 0))
    return values


def carry_forward(runs: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Values a run inherits: last success, last cleanup, last validation, last own snapshot.

    A skipped run repeats the snapshot of the run before it, named by
    ``snapshot_run``. The validation gauge is -1 before the first validation.
    """
    snapshot = Running("last", F.when(F.col("status") != "skipped", F.col("run_id")))
    out = running(runs, ["host"], ["ts", "run_id"], {**carried_values(runs), "snapshot_run": snapshot},
                  time_chunk("ts", MONTH) if chunk is None else chunk)
    gauge = F.col("validation_gauge") if "validation_gauge" in out.columns else F.lit(None).cast("int")
    return out.withColumn("validation_gauge", F.coalesce(gauge, F.lit(-1)))


def run_age(runs: DataFrame, now: Column) -> DataFrame:
    """Seconds since the last run, success and cleanup of each host.

    Only the newest time of each kind counts, so this is one combined
    aggregate and needs no ordered scan.
    """
    own = F.col("status") != "skipped"
    cleaned = own & ~blank("run_folder") if "run_folder" in runs.columns else own
    latest = runs.groupBy("host").agg(
        F.max(F.when(own, F.col("ts"))).alias("run"),
        F.max(F.when(F.col("status") == "success", F.col("ts"))).alias("success"),
        F.max(F.when(cleaned, F.col("ts"))).alias("cleanup"),
        F.max("ts").alias("metrics_update"))

    def age(name):
        return (F.unix_timestamp(now) - F.unix_timestamp(F.col(name))).alias(f"{name}_age")

    return latest.select("host", age("run"), age("success"), age("cleanup"), age("metrics_update"))
