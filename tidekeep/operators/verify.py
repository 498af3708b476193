"""Comparison of a copy with its record; every check names the first rule that fails."""

from pyspark.sql import DataFrame, functions as F

from tidekeep.functions.text import blank

# Profile fields in checking order and how a mismatch is worded.
PROFILE_CHECKS = [
    ("table_count", "base table count"), ("view_count", "view count"), ("trigger_count", "trigger count"),
    ("routine_count", "routine count"), ("event_count", "event count"),
]


def _judged(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, F.col("error").isNull().alias("valid"), F.coalesce("error", F.lit("")).alias("error"))


def compare_profiles(recorded: DataFrame, restored: DataFrame, keys=("db",)) -> DataFrame:
    """Object counts, then the fingerprint where one was recorded."""
    right = restored.select(*keys, *[F.col(c).alias(f"_r_{c}") for c, _ in PROFILE_CHECKS],
                            F.col("schema_fingerprint").alias("_r_fingerprint"))
    joined = recorded.join(right, list(keys), "left")
    recorded_print = F.col("schema_fingerprint")
    differs = (F.coalesce(recorded_print, F.lit("")) != "") & ~recorded_print.eqNullSafe(F.col("_r_fingerprint"))
    error = F.when(differs, F.format_string("schema fingerprint mismatch: manifest=%s, restored=%s",
                                            recorded_print, F.coalesce("_r_fingerprint", F.lit(""))))
    for name, wording in reversed(PROFILE_CHECKS):
        left, other = F.coalesce(name, F.lit(0)), F.coalesce(f"_r_{name}", F.lit(0))
        error = F.when(left != other, F.format_string(
            wording + " mismatch: manifest=%d, restored=%d", left, other)).otherwise(error)
    return _judged(joined.withColumn("error", error), keys)


def _paired(recorded: DataFrame, restored: DataFrame, value: str, keys) -> DataFrame:
    """Both sides of each table; ``_has`` and ``_r_has`` tell on which it is."""
    left = recorded.select(*keys, "table_name", F.col(value).alias("_left"), F.lit(True).alias("_has"),
                           *(["mode"] if "mode" in recorded.columns else []))
    right = restored.select(*keys, "table_name", F.col(value).alias("_right"), F.lit(True).alias("_r_has"))
    return left.join(right, [*keys, "table_name"], "full_outer")


def _first_issue(missing: str, mismatch) -> list:
    """Aggregates that give the issue of the first table, by name, that has one."""
    issue = (F.when(F.col("_has") & F.col("_r_has").isNull(), F.concat(F.lit(missing), F.col("table_name")))
             .when(F.col("_has") & (F.col("_left") != F.col("_right")), mismatch))
    return [F.count("_has").alias("_tables"), F.count("_r_has").alias("_r_tables"),
            F.min_by(issue, F.when(issue.isNotNull(), F.col("table_name"))).alias("_issue")]


def compare_table_counts(recorded: DataFrame, restored: DataFrame, keys=("db",)) -> DataFrame:
    """Row counts table by table, then the totals; databases not counted exactly pass."""
    mismatch = F.format_string("exact row count mismatch table=%s manifest=%d restored=%d",
                               F.col("table_name"), F.col("_left"), F.col("_right"))
    per_db = _paired(recorded, restored, "row_count", keys).groupBy(*keys).agg(
        *_first_issue("exact row count missing restored table: ", mismatch),
        F.max("mode").alias("_mode"), F.coalesce(F.sum("_left"), F.lit(0)).alias("_total"),
        F.coalesce(F.sum("_right"), F.lit(0)).alias("_r_total"))
    set_error = F.format_string("exact table row count set mismatch: manifest_tables=%d restored_tables=%d",
                                "_tables", "_r_tables")
    total_error = F.format_string("exact row count mismatch: manifest=%d, restored=%d", "_total", "_r_total")
    error = F.when(F.col("_mode") == "exact", F.when(F.col("_tables") != F.col("_r_tables"), set_error)
                   .when(F.col("_issue").isNotNull(), F.col("_issue"))
                   .when(F.col("_total") != F.col("_r_total"), total_error))
    return _judged(per_db.where("_tables > 0").withColumn("error", error), keys)


def compare_sample_hashes(recorded: DataFrame, restored: DataFrame, keys=("db",)) -> DataFrame:
    mismatch = F.format_string("sample row hash mismatch table=%s manifest=%s restored=%s",
                               F.col("table_name"), F.col("_left"), F.col("_right"))
    per_db = _paired(recorded, restored, "sample_hash", keys).groupBy(*keys).agg(
        *_first_issue("sample row hash missing restored table: ", mismatch))
    set_error = F.format_string("sample row hash table set mismatch: manifest_tables=%d restored_tables=%d",
                                "_tables", "_r_tables")
    error = F.when(F.col("_tables") != F.col("_r_tables"), set_error).otherwise(F.col("_issue"))
    return _judged(per_db.where("_tables > 0").withColumn("error", error), keys)


def first_failure(checks: list[DataFrame], keys=("db",)) -> DataFrame:
    """One verdict per database: the first check, in list order, that failed."""
    merged = checks[0].select(*keys, F.col("error").alias("_0"))
    for i, check in enumerate(checks[1:], 1):
        merged = merged.join(check.select(*keys, F.col("error").alias(f"_{i}")), list(keys), "full_outer")
    errors = [F.nullif(f"_{i}", F.lit("")) for i in range(len(checks))]
    return _judged(merged.withColumn("error", F.coalesce(*errors)), keys)


def verify_artifacts(results: DataFrame, artifacts: DataFrame, keys=("host", "run_id")) -> DataFrame:
    """Every result of a run against its file; a blank expected hash skips its rule.

    ``results`` has the keys, position, name, artifact_sha256 and sql_sha256;
    ``artifacts`` has the keys, db and the columns of ``artifact_digests``.
    """
    files = artifacts.select(*keys, F.col("db").alias("name"), F.lit(True).alias("_there"),
                             F.col("artifact_sha256").alias("_artifact"), F.col("payload_sha256").alias("_payload"),
                             "gzip_error", "header_error", "has_end_marker")
    joined = results.join(files, [*keys, "name"], "left")
    wants_artifact, wants_payload = ~blank("artifact_sha256"), ~blank("sql_sha256")

    def differs(kind, expected, actual):
        return F.format_string(kind + " sha256 mismatch: manifest=%s actual=%s", expected, actual)

    readable = F.col("gzip_error").isNull()
    error = (
        F.when(F.col("_there").isNull(), F.lit("file missing"))
        .when(wants_artifact & (F.col("artifact_sha256") != F.col("_artifact")),
              differs("artifact", "artifact_sha256", "_artifact"))
        .when(wants_payload & ~readable, F.concat(F.lit("sql payload hash read error: "), F.col("gzip_error")))
        .when(wants_payload & (F.col("sql_sha256") != F.col("_payload")),
              differs("sql", "sql_sha256", "_payload"))
        .when(F.col("header_error"), F.concat(F.lit("invalid gzip header: "), F.col("gzip_error")))
        .when(~readable, F.concat(F.lit("gzip checksum or read error: "), F.col("gzip_error")))
        .when(~F.col("has_end_marker"), F.lit("missing '-- Dump completed' signature at end of file"))
    )
    return joined.select(
        *keys, "position", F.col("name").alias("db"), error.isNull().alias("valid"),
        F.coalesce(error, F.lit("")).alias("error"))


def missing_run_folders(runs: DataFrame, folders: DataFrame, keys=("host", "run_id")) -> DataFrame:
    """Runs that cannot be validated at all, with the reason."""
    there = folders.select("run_folder").distinct().withColumn("_there", F.lit(True))
    joined = runs.join(there, "run_folder", "left")
    none = F.coalesce(F.size("results"), F.lit(0)) <= 0
    error = (
        F.when(F.coalesce("run_folder", F.lit("")) == "", F.lit("No local run folder recorded for this backup"))
        .when(F.col("_there").isNull(), F.lit("Local backup files have been removed (retention period exceeded)"))
        .when(none, F.lit("No logical dump results recorded for this backup run"))
    )
    return joined.select(*keys, error.alias("error")).where(F.col("error").isNotNull())


def validation_rollup(db_valid: DataFrame, keys=("host", "run_id")) -> DataFrame:
    """A run is valid when it has databases and all of them are."""
    return db_valid.groupBy(*keys).agg(
        (F.coalesce(F.every("valid"), F.lit(False)) & (F.count(F.lit(1)) > 0)).alias("valid"))


def validation_summary(db_valid: DataFrame, run_errors: DataFrame | None = None, keys=("host", "run_id")) -> DataFrame:
    """``validation failed for a: reason, b`` in result order; an error of the run itself wins.

    Only the failing databases of a run are gathered, into its one message.
    """
    name = F.when(~blank("error"), F.concat_ws(": ", "db", "error")).otherwise(F.col("db"))
    failing = F.when(~F.col("valid"), F.struct("position", name.alias("name")))
    listed = F.array_join(F.sort_array(F.collect_list(failing))["name"], ", ")
    summary = db_valid.groupBy(*keys).agg(listed.alias("_listed")).select(
        *keys, F.when(F.col("_listed") != "", F.concat(F.lit("validation failed for "), F.col("_listed")))
                .otherwise(F.lit("")).alias("summary"))
    if run_errors is None:
        return summary
    joined = summary.join(run_errors.select(*keys, F.col("error").alias("_run_error")), list(keys), "full_outer")
    return joined.select(*keys, F.when(~blank("_run_error"), F.col("_run_error"))
                         .otherwise(F.coalesce("summary", F.lit(""))).alias("summary"))
