"""Filters and projections over log lines, samples, files and settings."""

from pyspark.sql import DataFrame, Window as W, functions as F

from tidekeep.functions.text import blank, col, contains_any

# What makes a line of dump output worth keeping.
DUMP_WORDS = ["error", "warning", "failed", "couldn't find table", "could not"]

# What makes a line of the physical tools worth keeping.
PHYSICAL_WORDS = [
    "error", "warning", "failed", "fatal", "no space left", "errno 28", "completed ok",
    "upload completed", "transaction log of lsn", "backup created in directory", "mysql binlog position",
]

# Run events of high signal, as the lifecycle panel lists them, and failure-oriented words (case counts).
LIFECYCLE_PHRASES = [
    "mysql full backup started", "run log file:", "daily log file:", "logical backup:", "physical backup:", "backup folder:",
    "discovering databases", "processing ", "starting dump", "completed dump", "deleting old backup folder", "cleanup warning",
    "backup summary", "backup failure reason", "s3 upload", "metrics write failed",
]
LIFECYCLE_PATTERN = "found [0-9]+ databases"
FAILURE_WORDS = ["failed", "warning", "permission denied", "rate limit", "retry"]

# Settings whose value is not shown. The last one is an addition of ours.
SECRET_KEYS = ["DB_PASS", "BACKUP_S3_KEY_ID", "BACKUP_S3_KEY_SECRET", "BACKUP_XTRABACKUP_PASS",
               "BACKUP_API_BEARER_TOKEN", "BACKUP_ENCRYPTION_KEY"]


def keep_dump_warnings(lines: DataFrame, line="line") -> DataFrame:
    return lines.where(contains_any(F.lower(line), DUMP_WORDS))


def keep_physical_events(lines: DataFrame, line="line") -> DataFrame:
    return lines.where(contains_any(F.lower(line), PHYSICAL_WORDS))


def lifecycle_lines(lines: DataFrame, msg="msg", **labels) -> DataFrame:
    """Lines of high signal; with ``labels``, only of streams whose map ``labels`` has these values."""
    for name, value in labels.items():
        lines = lines.where(F.col("labels")[name] == value)
    return lines.where(contains_any(F.col(msg), LIFECYCLE_PHRASES) | F.col(msg).rlike(LIFECYCLE_PATTERN))


def failure_lines(lines: DataFrame, msg="msg") -> DataFrame:
    return lines.where(contains_any(F.col(msg), FAILURE_WORDS))


def search(df: DataFrame, needle: str, cols) -> DataFrame:
    """Rows whose columns, joined by blanks, contain the needle; case does not count."""
    needle = needle.strip().lower()
    if not needle:
        return df
    return df.where(F.lower(F.concat_ws(" ", *cols)).contains(needle))


def ownership_drift(inventory: DataFrame, expected_uid: int, max_depth=2, max_findings=5) -> DataFrame:
    """The first entries per root, in walking order, that another user owns."""
    drifted = inventory.where((F.length("rel_path") - F.length(F.replace("rel_path", F.lit("/"))) <= max_depth)
                              & (F.col("uid") != expected_uid))
    walk = W.partitionBy("host", "root").orderBy(F.split("rel_path", "/"), "uid")
    return drifted.withColumn("place", F.row_number().over(walk)).where(F.col("place") <= max_findings)


def select_series(samples: DataFrame, **labels) -> DataFrame:
    """Samples whose labels have the given values; an absent label is blank."""
    for name, value in labels.items():
        samples = samples.where(F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit("")) == value)
    return samples


def scraped_labels(labels):
    """Labels as the scraper stores them: ``job`` becomes ``exported_job``."""
    return F.transform_keys(col(labels), lambda k, _: F.when(k == "job", "exported_job").otherwise(k))


def mask_secrets(settings: DataFrame, keys=SECRET_KEYS) -> DataFrame:
    shown = F.when(blank("value"), F.lit("")).otherwise(F.lit("********"))
    return settings.withColumn("value", F.when(F.col("key").isin(keys), shown).otherwise(F.col("value")))


# The settings process variables and overrides may change.
MANAGED_KEYS = [
    "DB_USER", "DB_PASS", "DB_ENGINE", "DB_HOST", "DB_PORT", "BACKUP_DIR", "BACKUP_LOG_DIR", "BACKUP_METRICS_FILE",
    "BACKUP_SYSTEMD_SERVICE_NAME", "BACKUP_SYSTEMD_TIMER_NAME", "MYSQL_BIN", "MYSQLDUMP_BIN", "BACKUP_RETRY_COUNT",
    "BACKUP_RETRY_BASE_DELAY", "BACKUP_RETRY_MAX_DELAY", "BACKUP_LOGICAL_ENABLED", "BACKUP_EXACT_ROW_COUNTS",
    "BACKUP_SAMPLE_DATA_CHECKS", "BACKUP_SAMPLE_DATA_ROWS", "BACKUP_LOGICAL_SCHEDULE", "BACKUP_LOGICAL_DATABASES",
    "BACKUP_LOGICAL_TABLES", "BACKUP_LOGICAL_TIMEOUT_PER_DB", "BACKUP_LOGICAL_PARALLEL",
    "BACKUP_LOGICAL_GZIP_LEVEL", "BACKUP_LOGICAL_S3_UPLOAD_ENABLED", "BACKUP_PHYSICAL_ENABLED",
    "BACKUP_PHYSICAL_SCHEDULE", "BACKUP_PHYSICAL_TIMEOUT", "BACKUP_PHYSICAL_S3_UPLOAD_ENABLED",
    "BACKUP_ENCRYPTION_KEY", "BACKUP_DISCOVERY_TIMEOUT", "BACKUP_PREFLIGHT_TIMEOUT", "BACKUP_RETENTION_DAILY",
    "BACKUP_RETENTION_WEEKLY", "BACKUP_RETENTION_MONTHLY", "BACKUP_CLEANUP_FAIL_FATAL", "BACKUP_LOCK_FILE",
    "BACKUP_S3_UPLOAD_URL", "BACKUP_S3_UPLOAD_TIMEOUT", "BACKUP_S3_UPLOAD_MODE", "BACKUP_S3_PHP_BIN",
    "BACKUP_S3_UPLOAD_SCRIPT", "BACKUP_S3_BUCKET", "BACKUP_S3_REGION", "BACKUP_S3_LOGICAL_PREFIX",
    "BACKUP_S3_PHYSICAL_PREFIX", "BACKUP_S3_KEY_ID", "BACKUP_S3_KEY_SECRET", "BACKUP_XBCLOUD_BIN",
    "BACKUP_XBCLOUD_PARALLEL", "BACKUP_XBCLOUD_FIFO_STREAMS", "BACKUP_XTRABACKUP_BIN",
    "BACKUP_XTRABACKUP_PARALLEL", "BACKUP_XTRABACKUP_USER", "BACKUP_XTRABACKUP_PASS", "BACKUP_XTRABACKUP_SOCKET",
    "BACKUP_XTRABACKUP_RUN_AS_USER", "BACKUP_XTRABACKUP_WORK_DIR", "BACKUP_API_ENABLED", "BACKUP_API_LISTEN_ADDR",
    "BACKUP_API_BASE_PATH", "BACKUP_API_AUTH_ENABLED", "BACKUP_API_BEARER_TOKEN", "BACKUP_METRICS_JOB",
    "BACKUP_METRICS_SERVICE", "BACKUP_METRICS_ENV", "BACKUP_METRICS_REGION",
]


def layer_settings(base: DataFrame, overrides: DataFrame, env: DataFrame, now) -> DataFrame:
    """Effective value per host and key: process variable, else live override, else file.

    Process variables and overrides act on managed keys only. A blank winner
    counts as not set: ``value`` is then NULL. The three layers are put into
    one table so that one shuffle serves them all.
    """
    managed = F.col("key").isin(MANAGED_KEYS)
    layers = (
        base.select("host", "key", F.lit("file").alias("layer"), "value")
        .unionByName(overrides.where(managed & (F.col("expires_at") >= now))
                     .select("host", "key", F.lit("override").alias("layer"), "value"))
        .unionByName(env.where(managed).select("host", "key", F.lit("env").alias("layer"), "value")))
    rank = F.when(F.col("layer") == "env", 2).when(F.col("layer") == "override", 1).otherwise(0)
    present = layers.where(F.col("value").isNotNull())
    winner = present.groupBy("host", "key").agg(F.max(F.struct(rank.alias("rank"), "layer", "value")).alias("top"))
    return winner.select("host", "key", F.col("top.layer").alias("layer"),
                         F.when(~blank("top.value"), F.col("top.value")).alias("value"))


