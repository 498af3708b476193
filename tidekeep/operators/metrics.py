"""Gauges: from runs to samples, and from samples to snapshots."""

from pyspark.sql import Column, DataFrame, functions as F

from tidekeep.functions.durations import parse_duration
from tidekeep.functions.text import blank
from tidekeep.operators.running import MONTH, Running, running, time_chunk
from tidekeep.operators.runs import carried_values, full_success

# Gauge, its help text, and the decimals of its text form.
GAUGES = [
    ("backup_last_run_timestamp", "Unix timestamp when the most recent backup run ended.", 0),
    ("backup_last_success_timestamp", "Unix timestamp when the most recent fully successful backup run ended.", 0),
    ("backup_last_duration_seconds", "Total runtime of the most recent backup job in seconds.", 3),
    ("backup_last_size_bytes", "Size in bytes of the backup artifact produced by the most recent run.", 0),
    ("backup_last_status", "Status of the most recent backup run: 1 for full success, 0 for failure.", 0),
    ("backup_upload_success", "Upload result of the most recent backup run: 1 for success, 0 for failure or not reached.", 0),
    ("backup_metrics_write_success", "Whether the most recent metrics file emission completed successfully: 1 for success, 0 for failure.", 0),
    ("backup_cleanup_success", "Whether cleanup of old backups completed without errors in the most recent run: 1 for success, 0 for failure.", 0),
    ("backup_last_cleanup_timestamp", "Unix timestamp when cleanup of old backups last ran, or the previous value if cleanup was not reached in the most recent run.", 0),
    ("backup_logical_last_attempted", "Whether the logical backup portion was attempted in the most recent run: 1 for attempted, 0 for skipped.", 0),
    ("backup_logical_last_status", "Status of the logical backup portion in the most recent run: 1 for success, 0 for failure or skipped.", 0),
    ("backup_logical_last_total_databases", "Total logical databases selected for the most recent run.", 0),
    ("backup_logical_last_succeeded_databases", "Logical databases backed up successfully in the most recent run.", 0),
    ("backup_logical_last_failed_databases", "Logical databases that failed in the most recent run.", 0),
    ("backup_physical_last_attempted", "Whether the physical backup portion was attempted in the most recent run: 1 for attempted, 0 for skipped.", 0),
    ("backup_physical_last_status", "Status of the physical backup portion in the most recent run: 1 for success, 0 for failure or skipped.", 0),
    ("backup_physical_last_duration_seconds", "Duration in seconds of the physical backup portion in the most recent run.", 3),
    ("backup_adaptive_load_per_cpu", "Observed 1-minute host load average divided by CPU count for the most recent run, or 0 when unavailable.", 3),
    ("backup_adaptive_logical_parallel", "Logical backup parallelism chosen for the most recent run after adaptive tuning.", 0),
    ("backup_adaptive_xtrabackup_parallel", "Physical backup xtrabackup parallelism chosen for the most recent run after adaptive tuning.", 0),
    ("backup_adaptive_xbcloud_parallel", "Physical backup xbcloud upload parallelism chosen for the most recent run after adaptive tuning.", 0),
    ("backup_physical_retry_count", "Total number of physical backup attempts used in the most recent run.", 0),
    ("backup_physical_rate_limit_retry_count", "Number of physical backup retries caused by xbcloud or S3 rate limiting in the most recent run.", 0),
    ("backup_run_in_progress", "Whether a backup run is currently in progress: 1 for running, 0 for idle.", 0),
    ("backup_current_run_start_timestamp", "Unix timestamp when the current in-progress backup run started, or 0 when idle.", 0),
    ("backup_current_run_duration_seconds", "Elapsed seconds for the current in-progress backup run, or 0 when idle.", 3),
    ("backup_metrics_last_update_timestamp", "Unix timestamp when the backup metrics file was last refreshed.", 0),
    ("backup_logical_validation_last_status", "1 if the last validated logical backup was healthy, 0 otherwise.", 0),
]
ROW_GAUGE = ("backup_database_row_count", "Number of rows in the database (exact or estimated).", 0)
NAMES = [name for name, _, _ in GAUGES]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _own_gauges() -> dict[str, Column]:
    """Gauges a run sets by itself; columns as in ``run_to_samples``."""
    logical, physical = F.col("logical_due"), F.col("physical_due")
    part = F.col("physical_backup")

    def when_due(due, value):
        return F.when(due, value).otherwise(F.lit(0))

    def chosen(field, fallback):
        return F.when(physical & (part[field] > 0), part[field]).otherwise(F.col(fallback))

    return {
        "backup_last_run_timestamp": F.unix_timestamp("ts"),
        "backup_last_duration_seconds": parse_duration("duration"),
        "backup_last_size_bytes": F.col("size_bytes"),
        "backup_last_status": _flag(full_success()),
        "backup_upload_success": _flag(F.col("uploaded")),
        "backup_metrics_write_success": F.lit(1),
        "backup_cleanup_success": _flag(blank("cleanup_error")),
        "backup_logical_last_attempted": _flag(logical),
        "backup_logical_last_status": _flag(logical & (F.col("databases_failed") == 0)),
        "backup_logical_last_total_databases": when_due(logical, F.col("databases_total")),
        "backup_logical_last_succeeded_databases": when_due(logical, F.col("databases_succeeded")),
        "backup_logical_last_failed_databases": when_due(logical, F.col("databases_failed")),
        "backup_physical_last_attempted": _flag(physical),
        "backup_physical_last_status": _flag(physical & (part["status"] == "success")),
        "backup_physical_last_duration_seconds": when_due(physical, parse_duration(part["duration"])),
        "backup_adaptive_load_per_cpu": F.col("adaptive_load_per_cpu"),
        "backup_adaptive_logical_parallel": F.col("adaptive_logical_parallel"),
        "backup_adaptive_xtrabackup_parallel": chosen("xtrabackup_parallel", "adaptive_physical_parallel"),
        "backup_adaptive_xbcloud_parallel": chosen("xbcloud_parallel", "adaptive_xbcloud_parallel"),
        "backup_physical_retry_count": F.greatest(part["attempts"], F.lit(0)),
        "backup_physical_rate_limit_retry_count": F.greatest(part["rate_limit_retries"], F.lit(0)),
    }


def run_to_samples(runs: DataFrame, chunk: Column | None = None) -> DataFrame:
    """The 28 gauges of every finished run as rows (host, run_id, ts, metric, value).

    Beyond the fields of a run record, ``runs`` has ts, logical_due,
    physical_due, size_bytes, and ``uploaded`` (NULL where no upload was
    needed). A skipped run repeats the gauges of the run before it.
    """
    own = F.col("status") != "skipped"
    gauges = _own_gauges()
    snapshot = F.struct(*[F.coalesce(value.cast("double"), F.lit(0.0)).alias(name) for name, value in gauges.items()])
    scanned = running(runs, ["host"], ["ts", "run_id"], {
        **carried_values(runs), "_snapshot": Running("last", F.when(own, snapshot))},
        time_chunk("ts", MONTH) if chunk is None else chunk)
    validation = F.col("validation_gauge") if "validation_gauge" in scanned.columns else F.lit(None)
    rest = {
        "backup_last_success_timestamp": F.unix_timestamp("last_success"),
        "backup_last_cleanup_timestamp": F.unix_timestamp("last_cleanup"),
        "backup_metrics_last_update_timestamp": F.unix_timestamp("ts"),
        "backup_logical_validation_last_status": F.coalesce(validation.cast("int"), F.lit(-1)),
    }
    values = {name: F.coalesce(rest.get(name, F.col(f"_snapshot.{name}") if name in gauges else F.lit(0)).cast("double"),
                               F.lit(0.0)).alias(name) for name in NAMES}
    wide = scanned.select("host", "run_id", "ts", *values.values())
    return wide.unpivot(["host", "run_id", "ts"], NAMES, "metric", "value")


def metric_snapshot(samples: DataFrame, key="host", order=("ts",), names=NAMES) -> DataFrame:
    """Latest value of each gauge, one wide row per host."""
    return samples.groupBy(key).pivot("metric", names).agg(F.max_by("value", F.struct(*order)))


def database_row_gauges(results: DataFrame, keys=("run_id",)) -> DataFrame:
    """One labelled sample per database that has rows."""
    return results.where("row_counts > 0").select(
        *keys, F.lit(ROW_GAUGE[0]).alias("metric"), F.create_map(F.lit("database"), "name").alias("labels"),
        F.col("row_counts").cast("double").alias("value"))
