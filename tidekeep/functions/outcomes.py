"""Failure categories, retries, run outcome texts and value bands."""

from pyspark.sql import Column, functions as F

from tidekeep.functions.text import blank, col, contains_any, strip

# Phrases of a failure text and their category, first match counts.
FAILURE_PHRASES = [
    ("auth", ["access denied"]),
    ("permission", ["permission denied"]),
    ("disk", ["no space left on device", "disk full"]),
    ("view", ["references invalid table", "1356"]),
    ("connect", ["can't connect", "connection refused", "server has gone away",
                 "connection reset", "no route to host"]),
    ("timeout", ["deadline exceeded", "timed out", "error 3024", "max_execution_time"]),
    ("config", ["unknown variable", "unknown option"]),
    ("binary", ["executable file not found"]),
    ("definer", ["user specified as a definer", "1449"]),
    ("schema", ["doesn't exist", "1146"]),
    ("config", ["max_allowed_packet", "got a packet bigger", "1153"]),
]

# Categories another try cannot cure.
FINAL_CATEGORIES = ["auth", "permission", "disk", "view", "definer", "schema", "config", "binary"]

# Phrases of a throttled upload.
THROTTLING_PHRASES = ["please reduce your request rate", "slow down", "throttl", "rate exceeded"]


def classify_failure(detail, error, timed_out=None) -> Column:
    """Category of a failure; blank where there is no error."""
    error = col(error)
    text = F.lower(strip(F.concat_ws(" ", col(detail), error)))
    category = F.when(error.isNull(), F.lit(""))
    if timed_out is not None:
        category = category.when(col(timed_out), F.lit("timeout"))
    for name, phrases in FAILURE_PHRASES:
        category = category.when(contains_any(text, phrases), F.lit(name))
    return category.otherwise(F.lit("command"))


def is_retryable(category) -> Column:
    return ~col(category).isin(FINAL_CATEGORIES)


def is_rate_limited(message) -> Column:
    text = F.lower(F.coalesce(col(message), F.lit("")))
    return contains_any(text, THROTTLING_PHRASES)


def retry_delay(attempt, base_seconds=2.0, max_seconds=20.0) -> Column:
    """Seconds to wait after a failed attempt: doubled each time, capped."""
    doubled = F.lit(float(base_seconds)) * F.pow(F.lit(2.0), col(attempt) - 1)
    return F.least(doubled, F.lit(float(max_seconds)))


def final_outcome(status, total, failed, failure_reason, cleanup_error, upload_error) -> Column:
    """One line that says how a run ended; blank for a clean success."""
    status, total, failed = col(status), col(total), col(failed)
    counted = F.format_string("%d of %d database backups failed", failed.cast("bigint"), total.cast("bigint"))
    some_failed = (failed > 0) & (total > 0)
    return (
        F.when(~blank(failure_reason), col(failure_reason))
        .when(~blank(upload_error), F.concat(F.lit("logical upload failed: "), col(upload_error)))
        .when(~blank(cleanup_error) & (status == "success"),
              F.concat(F.lit("backup completed with cleanup issue: "), col(cleanup_error)))
        .when(~blank(cleanup_error), F.concat(F.lit("cleanup issue: "), col(cleanup_error)))
        .when(status.isin("partial", "failed") & some_failed, counted)
        .when(status == "partial", F.lit("backup completed partially"))
        .when((status == "failed") & (total == 0), F.lit("backup failed before any database finished"))
        .when(status == "failed", F.lit("backup failed"))
        .otherwise(F.lit(""))
    )


def execution_source(source) -> Column:
    return F.when(blank(source), F.lit("runner")).otherwise(strip(source))


def scheduler_context(os_user, source) -> Column:
    source = execution_source(source)
    return (
        F.when((source == "runner") & F.coalesce(strip(os_user) == "root", F.lit(False)),
               F.lit("root scheduled runner (blocked)"))
        .when(source == "runner", F.lit("user-level scheduled runner"))
        .when(source == "tui", F.lit("interactive TUI/manual invocation"))
        .when(source == "api", F.lit("API-triggered invocation"))
        .otherwise(F.concat(source, F.lit(" invocation")))
    )


def load_band(load_per_cpu) -> Column:
    load = col(load_per_cpu)
    return (
        F.when(load >= 1.5, "very-high-load reduction").when(load >= 1.0, "high-load reduction")
        .when(load >= 0.75, "moderate-load reduction").when(load <= 0.10, "very-low-load boost")
        .when(load <= 0.20, "low-load boost").when(load <= 0.35, "light-load boost")
        .otherwise("balanced")
    )


# A gauge is yellow from the first limit on and red above the second.
GIB = 1024 ** 3
THRESHOLDS = {
    "run_age": (8 * 3600, 12 * 3600),
    "success_age": (None, 12 * 3600),
    "duration": (15 * 60, 30 * 60),
    "size": (5 * GIB, 10 * GIB),
}

# Texts shown for gauge values.
STATUS_LABELS = {
    "backup_run_in_progress": {0: "Idle", 1: "Running"},
    "backup_last_status": {0: "Failed/Partial", 1: "Success"},
    "backup_logical_last_status": {0: "Failed", 1: "Success"},
    "backup_physical_last_status": {0: "Failed", 1: "Success"},
    "backup_upload_success": {0: "Failed", 1: "Success"},
    "backup_cleanup_success": {0: "Failed", 1: "Success"},
    "backup_metrics_write_success": {0: "Failed", 1: "Success"},
    "backup_logical_validation_last_status": {-1: "Not Validated", 0: "Failed", 1: "Success"},
}


def threshold_band(metric, value) -> Column:
    """green, yellow or red; NULL for a metric without limits."""
    metric, value = col(metric), col(value)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, (yellow, red) in THRESHOLDS.items():
        out = out.when((metric == name) & (value > red), "red")
        if yellow is not None:
            out = out.when((metric == name) & (value >= yellow), "yellow")
        out = out.when(metric == name, "green")
    return out


def status_label(metric, value) -> Column:
    metric, value = col(metric), col(value)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, labels in STATUS_LABELS.items():
        for number, label in labels.items():
            out = out.when((metric == name) & (value == number), label)
    return out
