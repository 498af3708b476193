"""Jobs composed of the operators: what a user of the fleet calls."""

from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidekeep import schemas
from tidekeep.functions.durations import format_duration, parse_run_id
from tidekeep.functions.outcomes import (
    classify_failure, is_rate_limited, is_retryable, status_label, threshold_band)
from tidekeep.functions.text import blank, human_bytes
from tidekeep.operators import alerts, catalog, filters, metrics, profile, retention, runs as run_ops, verify
from tidekeep.operators.digest_tree import broken_parts, root_digests
from tidekeep.operators.schedules import schedule_due
from tidekeep.session import materialize, union_all
from tidekeep.sinks import files as sinks
from tidekeep.sources import files as sources
from tidekeep.sources.artifacts import artifact_digests, committed_rows, file_sha256, list_folders, listed_artifacts, listed_parts
from tidekeep.sources.statistics import discover_keys, table_statistics
from tidekeep.sources.tables import TableSource, discover_tables, scan_tables

RUN_ID = "%Y-%m-%d_%H-%M-%S"


def snapshot_tables(spark: SparkSession, databases: dict[str, TableSource], target: str, history: str, host: str,
                    started: datetime, allow: list[str] | None = None, requested: dict[str, list[str]] | None = None,
                    view_deps: DataFrame | None = None, pk_columns: dict[str, dict[str, list[str]]] | None = None,
                    sample_rows: int = 50, codec: str = "zstd", exact_counts: bool = True) -> DataFrame:
    """Profiles and exports the databases of a host, records the run and returns its record.

    System databases and copies are left out (``allow`` names databases
    instead), ``requested`` restricts tables, and views that read missing
    tables (``view_deps``) are not profiled. Keys that ``pk_columns`` does not
    give are discovered. Row counts are stored estimates if ``exact_counts`` is
    off or counting fails; the record tells which. A database that fails is
    recorded with its category and does not stop the others. Only names, which are
    catalogue data, come to the driver; every count, digest and copy is a
    Spark job over whole tables.
    """
    run_id, began = started.strftime(RUN_ID), datetime.now()
    listed = spark.createDataFrame([(db,) for db in databases], "db string")
    allowed = None if allow is None else spark.createDataFrame([(db,) for db in allow], "db string")
    scope = catalog.select_databases(catalog.exclude_system_databases(listed), allowed)
    results = []
    for db in sorted(row["db"] for row in scope.collect()):
        wanted = (requested or {}).get(db)
        try:  # frames are lazy: the database is done when its record is written
            result = materialize(_snapshot_database(spark, databases[db], target, run_id, db, wanted, view_deps,
                                                    (pk_columns or {}).get(db, {}), sample_rows, codec, exact_counts), "result")
        except (PySparkException, Py4JJavaError, OSError) as failure:  # recorded, like any failed database
            failed = spark.createDataFrame([(db, "failed", 1, str(failure))],
                                           "name string, status string, attempts int, error string")
            result = materialize(_as(failed.withColumn("error_category", classify_failure(F.lit(""), "error")),
                                     schemas.RESULT), "result")
        results.append(result)
    empty = spark.createDataFrame([], schemas.RESULT)
    record = union_all([*results, empty])
    fields = record.columns
    run = record.agg(
        F.count(F.lit(1)).alias("databases_total"), F.count_if(F.col("status") == "success").alias("databases_succeeded"),
        F.count_if(F.col("status") != "success").alias("databases_failed"),
        F.collect_list(F.struct(*fields)).alias("results"))  # one entry per database of the host
    seconds = (datetime.now() - began).total_seconds()
    run = run_ops.run_status(run.withColumns({
        "run_id": F.lit(run_id), "failure_reason": F.lit(""), "timestamp": F.lit(started).cast("timestamp"),
        "backup_dir": F.lit(target), "run_folder": F.lit(f"{target}/{run_id}"),
        "duration": format_duration(F.lit(seconds)), "hostname": F.lit(host)}))
    run = materialize(_as(run, schemas.RUN), "run")
    sinks.write_manifests(run, f"{target}/manifests")
    sinks.append_run_history(run, history)
    return run


def _snapshot_database(spark, source, target, run_id, db, requested, view_deps, pk_columns, sample_rows, codec, exact_counts):
    """Result record of one database, its tables written."""
    found = discover_tables(spark, source).select(F.lit(db).alias("db"), "section", "name")
    if requested is not None:
        wanted = spark.createDataFrame([(db, name) for name in requested], "db string, name string")
        found = found.join(wanted, ["db", "name"], "left_semi")
    if view_deps is not None:
        tables_of = found.where("section = 'table'").select("db", F.col("name").alias("table_name"))
        found = catalog.drop_broken_views(found, catalog.broken_views(view_deps.where(F.col("db") == db), tables_of))
    names = [row["name"] for row in found.where("section = 'table'").select("name").collect()]
    success = {"name": F.lit(db), "status": F.lit("success"), "attempts": F.lit(1)}
    if not names:
        return _as(spark.createDataFrame([(db,)], "db string").withColumns({**success, "duration": F.lit("0s")}), schemas.RESULT)
    tables = scan_tables(spark, source, names)

    totals = _row_totals(spark, source, tables, db, exact_counts)
    hashes = profile.sample_row_hashes(spark, tables, {**discover_keys(spark, source, tables), **pk_columns}, sample_rows, db)
    written = sinks.export_tables(spark, tables, target, run_id, db, codec)
    parts = sinks.committed_parts(spark, target, run_id, db).withColumn("db", F.lit(db))
    artifact = root_digests(parts, ["db"]).withColumnRenamed("digest", "artifact_sha256")
    hash_map = hashes.groupBy("db").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("table_name", "sample_hash")))).alias("sample_row_hashes"))
    record = (
        catalog.object_counts(found).join(catalog.schema_fingerprint(found), "db", "left")
        .join(totals, "db", "left").join(hash_map, "db", "left").join(artifact, "db", "left")
        .join(written.groupBy(F.lit(db).alias("db")).agg(F.sum("bytes").alias("size_bytes")), "db", "left"))
    return _as(record.withColumns({
        **success, "output_path": F.lit(f"{target}/{run_id}/{db}"),
        "sample_row_count": F.lit(sample_rows)}), schemas.RESULT)


def _row_totals(spark, source, tables, db, exact_counts):
    """Row counts of a database with their mode: exact with the map of its tables, or the sum of stored estimates."""
    if exact_counts:
        try:
            counts = materialize(profile.table_row_counts(spark, tables, db), "counts")
            return profile.db_row_counts(counts).withColumn("row_count_mode", F.lit("exact"))
        except (PySparkException, Py4JJavaError):  # e.g. a count that the server stops
            pass
    stored = table_statistics(spark, source, list(tables)).withColumn("db", F.lit(db))
    return catalog.estimated_row_counts(stored).withColumn("row_count_mode", F.lit("estimate"))


def _as(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema; those the frame lacks are NULL."""
    wanted = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in wanted])


def validate_runs(history: DataFrame, order=("ts",)) -> tuple[DataFrame, DataFrame]:
    """Checks the files of every run against its record: dumps, and the part files of exports.

    Returns the verdict per database and the validation fields per run, the
    latter ready for ``upsert_run_history``.
    """
    keys = ["host", "run_id"]
    last = run_ops.keep_last(history, keys, list(order))
    listing = materialize(list_folders(last), "listing")
    folders = listing.where("rel_path IS NULL").select("run_folder")
    barred = verify.missing_run_folders(last, folders)
    open_ = last.join(barred, keys, "left_anti")
    results = run_ops.explode_results(open_).select(*keys, "position", "name", "artifact_sha256", "sql_sha256", "output_path")
    placed = open_.select(*keys, "run_folder")
    artifacts = listed_artifacts(listing).drop("run_id").join(placed, "run_folder")
    exported = results.where(F.endswith("output_path", F.concat(F.lit("/"), "name"))).select(*keys, "position", F.col("name").alias("db"), "artifact_sha256")
    dumped = results.join(exported.select(*keys, "position"), [*keys, "position"], "left_anti").drop("output_path")
    of_dumps = verify.verify_artifacts(dumped, artifact_digests(artifacts))
    checked = materialize(of_dumps.unionByName(_check_exports(exported, listing, placed)), "validation")
    verdicts = checked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "db", "valid", "error"))).alias("_all"))
    per_run = verify.validation_rollup(checked).join(verify.validation_summary(checked), keys).join(verdicts, keys) \
        .select(*keys, "valid", "summary", "_all").unionByName(
            barred.select(*keys, F.lit(False).alias("valid"), F.col("error").alias("summary")), allowMissingColumns=True)
    databases = F.transform(F.coalesce("_all", F.array().cast(per_run.schema["_all"].dataType)), lambda x: F.struct(
        x["db"].alias("database"), x["valid"].alias("valid"), x["error"].alias("error")))
    fields = per_run.select(
        *keys, F.current_timestamp().alias("validation_checked_at"), F.lit("logical validation").alias("validation_mode"),
        F.when(F.col("valid"), "success").otherwise("failed").alias("validation_status"),
        F.when(F.col("valid"), "").otherwise(F.col("summary")).alias("validation_error"),
        databases.alias("validation_databases"))
    return checked, fields


def _check_exports(exported: DataFrame, listing: DataFrame, placed: DataFrame) -> DataFrame:
    """Verdict of every exported database: all bytes are read again, and the digest tree of what is there is compared
    with the recorded digest and, part by part, with the commit record."""
    keys = ["host", "run_id", "db"]
    files = listed_parts(listing).join(placed, "run_folder").join(exported.select(*keys).distinct(), keys, "left_semi")
    found = materialize(file_sha256(files.where("section = 'data'")).select(*keys, "table_name", "part", "sha256"), "parts")
    recorded = materialize(committed_rows(files.where("section = 'commit'").select(*keys, "path")), "recorded-parts")
    faults = broken_parts(recorded, found, keys)
    first = faults.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("table_name", "part", "fault")).alias("_f"))
    roots = [root_digests(side, keys).withColumnRenamed("digest", name) for side, name in ((recorded, "_recorded"), (found, "_found"))]
    joined = exported.join(roots[0], keys, "left").join(roots[1], keys, "left").join(first, keys, "left")
    part = F.format_string("part %s: table=%s file=%s (%d in all)", "_f.fault", "_f.table_name", "_f.part", "_n")
    error = (F.when(F.col("_recorded").isNull() & F.col("_found").isNull(), F.lit("file missing"))
             .when(F.col("_recorded").isNull(), F.lit("commit record missing"))
             .when(F.col("_n") > 0, part)
             .when(~blank("artifact_sha256") & ~F.col("artifact_sha256").eqNullSafe(F.col("_found")), F.format_string(
                 "artifact sha256 mismatch: manifest=%s actual=%s", "artifact_sha256", "_found")))
    return joined.select("host", "run_id", "position", "db", error.isNull().alias("valid"), F.coalesce(error, F.lit("")).alias("error"))


def validation_report(validations: DataFrame, db_valid: DataFrame) -> DataFrame:
    """Report text of each validated run, line by line: (run_id, part, position, line)."""
    def told(label, value):
        return F.concat(F.lit(f"{label}: "), value)

    head = validations.select("run_id", F.inline(F.array_compact(F.array(*[
        F.when(~blank(value), F.struct(F.lit(part).alias("part"), F.lit(0).alias("position"), told(label, value).alias("line")))
        for part, (label, value) in enumerate([
            ("Validation Mode", F.col("validation_mode")), ("Run ID", F.col("run_id")),
            ("Result", F.col("validation_status")), ("Error", F.col("validation_error"))])]))))
    title = db_valid.select("run_id").distinct().select(
        "run_id", F.lit(4).alias("part"), F.lit(0).alias("position"), F.lit("Databases:").alias("line"))
    verdict = F.when(F.col("valid"), "ok").otherwise("failed")
    reason = F.when(~blank("error"), F.concat(F.lit(" ("), "error", F.lit(")"))).otherwise(F.lit(""))
    rows = db_valid.select("run_id", F.lit(5).alias("part"), "position",
                           F.concat(F.lit("- "), "db", F.lit(": "), verdict, reason).alias("line"))
    return head.unionByName(title).unionByName(rows).orderBy("run_id", "part", "position", "line")


def verify_copy(recorded: dict[str, DataFrame], restored: dict[str, DataFrame]) -> DataFrame:
    """One verdict per database: object counts and fingerprint, then row counts, then sample digests.

    Both sides hold the frames profile, counts and hashes; see ``table_profile``.
    """
    return verify.first_failure([
        verify.compare_profiles(recorded["profile"], restored["profile"]),
        verify.compare_table_counts(recorded["counts"], restored["counts"]),
        verify.compare_sample_hashes(recorded["hashes"], restored["hashes"])])


def table_profile(spark: SparkSession, databases: dict[str, dict[str, DataFrame]],
                  pk_columns: dict[str, list[str]], sample_rows: int) -> dict[str, DataFrame]:
    """Profile, exact counts and sample digests of several databases."""
    names = [(db, "table", name) for db, tables in databases.items() for name in tables]
    objects = spark.createDataFrame(names, "db string, section string, name string")
    counts = union_all([profile.table_row_counts(spark, tables, db) for db, tables in databases.items()])
    hashes = union_all([profile.sample_row_hashes(spark, tables, pk_columns, sample_rows, db)
                    for db, tables in databases.items()])
    shape = catalog.object_counts(objects).join(catalog.schema_fingerprint(objects), "db")
    return {"profile": shape, "counts": counts.withColumn("mode", F.lit("exact")), "hashes": hashes}


def apply_retention(runs: DataFrame, daily=7, weekly=4, monthly=12, current=None) -> DataFrame:
    """Runs named by their start time, with the tiers that keep them; other names are left alone."""
    dated = runs.withColumn("ts", parse_run_id("run_id")).where(F.col("ts").isNotNull())
    return retention.gfs_retention(dated, daily, weekly, monthly, current)


# Texts that switch a setting off; any other leaves it on.
SWITCHED_OFF = ["0", "f", "F", "false", "FALSE", "False"]

# Switch and schedule setting of each kind of backup.
SCHEDULES = {
    "logical": ("BACKUP_LOGICAL_ENABLED", "BACKUP_LOGICAL_SCHEDULE"),
    "physical": ("BACKUP_PHYSICAL_ENABLED", "BACKUP_PHYSICAL_SCHEDULE"),
}


def due_report(state: DataFrame, settings: DataFrame, now: Column, default_schedule="always",
               zone: str = "UTC") -> DataFrame:
    """Per host and kind of backup whether it is due, from effective settings and schedule state."""
    wanted = [key for pair in SCHEDULES.values() for key in pair]
    wide = settings.where(F.col("key").isin(wanted)).groupBy("host").agg(*[
        F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in wanted])
    kinds = wide.select("host", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(enabled).alias("enabled"),
                 F.coalesce(schedule, F.lit(default_schedule)).alias("schedule"))
        for kind, (enabled, schedule) in SCHEDULES.items()])))
    cases = kinds.join(state, ["host", "kind"], "left").withColumn("now", now)
    judged = schedule_due(cases, zone=zone)
    on = ~F.coalesce(F.trim("enabled").isin(SWITCHED_OFF), F.lit(False))
    return judged.select("host", "kind", "schedule", (on & F.col("due")).alias("due"), "target",
                         F.when(on, F.col("reason")).otherwise(F.lit("disabled")).alias("reason"), "error")


def fleet_health(runs: DataFrame, now: Column, inventory: DataFrame | None = None,
                 expected_uid: int = 1000) -> DataFrame:
    """Rows (host, check, status, message) over all hosts."""
    latest = run_ops.run_view(run_ops.latest_run(runs))
    ok = F.when(F.col("status") == "success", "ok").when(F.col("status") == "partial", "warn").otherwise("error")
    text = F.concat_ws(" ", F.col("run_id").cast("string"), "status", F.nullif("final_outcome", F.lit("")))
    checks = latest.select("host", F.lit("latest_run").alias("check"), ok.alias("status"), text.alias("message"))
    ages = run_ops.run_age(runs, now)
    bands = {"green": "ok", "yellow": "warn", "red": "error"}

    def aged(check, column):
        band = threshold_band(F.lit(check), F.col(column))
        status = F.lit("error")
        for name, level in bands.items():
            status = F.when(band == name, level).otherwise(status)
        return F.struct(F.lit(check).alias("check"), status.alias("status"),
                        F.coalesce(F.concat(F.col(column).cast("string"), F.lit("s")), F.lit("never")).alias("message"))

    checks = checks.unionByName(ages.select("host", F.inline(F.array(
        aged("run_age", "run_age"), aged("success_age", "success_age")))))
    return checks if inventory is None else checks.unionByName(drift_checks(inventory, expected_uid))


def drift_checks(inventory: DataFrame, expected_uid: int = 1000) -> DataFrame:
    """A warning for every root in which another user owns something, with the first five entries.

    Group and permissions are told where the inventory has ``gid`` and ``mode``.
    """
    owner, values = "%s(uid=%d", ["rel_path", "uid"]
    if {"gid", "mode"} <= set(inventory.columns):
        octal = F.when(F.col("mode") == 0, "0").otherwise(F.concat(F.lit("0"), F.conv(F.col("mode").cast("string"), 10, 8)))
        owner, values = owner + " gid=%d mode=%s", [*values, "gid", octal]
    drift = filters.ownership_drift(inventory, expected_uid)
    named = F.sort_array(F.collect_list(F.struct("place", F.format_string(owner + ")", *values).alias("text"))))
    drifted = drift.groupBy("host", "root").agg(F.array_join(named["text"], ", ").alias("found"))  # five per root
    return drifted.select(
        "host", F.concat(F.lit("ownership "), "root").alias("check"), F.lit("warn").alias("status"),
        F.concat(F.lit("ownership drift detected relative to uid="), F.lit(str(expected_uid)), F.lit(": "), "found")
        .alias("message"))


def folder_health(entries: DataFrame, expected_uid: int = 1000) -> DataFrame:
    """One verdict for every root of ``read_entries``: error if it is missing or no folder, warn if something in it
    can't be read or belongs to another user, else ok."""
    keys, rooted = ["host", "root"], F.col("rel_path").isNull()
    state = entries.groupBy(*keys).agg(
        F.max(F.when(rooted, F.col("error"))).alias("_gone"), F.bool_or(F.when(rooted, F.col("is_dir"))).alias("_folder"),
        F.min(F.when(~rooted & F.col("error").isNotNull(), F.struct("rel_path", "error"))).alias("_unread"))
    drift = drift_checks(entries.where(~rooted & F.col("uid").isNotNull()), expected_uid).select(
        "host", F.substr("check", F.lit(len("ownership ") + 1)).alias("root"), F.col("message").alias("_drift"))
    status = (F.when(F.col("_gone").isNotNull() | ~F.col("_folder"), "error")
              .when(F.col("_unread").isNotNull() | F.col("_drift").isNotNull(), "warn").otherwise("ok"))
    message = (F.when(F.col("_gone").isNotNull(), F.concat("root", F.lit(" missing or unreadable: "), "_gone"))
               .when(~F.col("_folder"), F.concat("root", F.lit(" is not a directory")))
               .when(F.col("_unread").isNotNull(), F.concat(F.lit("ownership drift scan failed: "), "_unread.error"))
               .otherwise(F.coalesce("_drift", F.concat(F.lit("no ownership drift in "), "root"))))
    return state.join(drift, keys, "left").select(
        "host", F.concat(F.lit("folder "), "root").alias("check"), status.alias("status"), message.alias("message"))


def observability_report(spark: SparkSession, path: str) -> DataFrame:
    """Gauges of every host's metric file with labels, write result and last update."""
    samples = sources.read_metric_text(spark, path)
    wide = metrics.metric_snapshot(samples.where(F.col("metric").isin(metrics.NAMES)), "host", ("ts", "value"))
    write = F.when(F.col("backup_metrics_write_success") == 1, "success").otherwise("failed-or-unknown")
    update = F.col("backup_metrics_last_update_timestamp")
    last = F.when(update > 0, F.timestamp_seconds(update))
    facts = wide.select("host", write.alias("last_write_result"), last.alias("last_update"), *metrics.NAMES)
    rows = facts.unpivot(["host", "last_write_result", "last_update"], metrics.NAMES, "metric", "value")
    return rows.withColumns({"value": F.coalesce("value", F.when(
        F.col("metric") == "backup_logical_validation_last_status", F.lit(-1.0)).otherwise(F.lit(0.0)))}).withColumn(
        "label", status_label("metric", "value"))


def inspect_run(inventory: DataFrame, run_id=None, keys=("run_id",)) -> DataFrame:
    """Dumps of a run (``keys`` name it: with hosts in the inventory, host and run) with their size text, and the size of its physical part."""
    rows = inventory if run_id is None else inventory.where(F.col("run_id") == run_id)
    dump = F.regexp_extract("rel_path", r"^([^/]+)\.sql\.gz$", 1)
    part = (F.when(dump != "", F.struct(F.lit("logical").alias("kind"), dump.alias("name")))
            .when(F.col("rel_path").startswith("physical/"),
                  F.struct(F.lit("physical").alias("kind"), F.lit("physical").alias("name"))))
    sized = rows.where(~F.col("is_dir")).withColumn("_part", part).where(F.col("_part").isNotNull())
    out = sized.groupBy(*keys, "_part.kind", "_part.name").agg(F.sum("size").alias("bytes"))
    return out.withColumn("size", human_bytes("bytes"))


def evaluate_alerts(samples: DataFrame, keys=("host",), tie="value", **labels) -> DataFrame:
    """Firings of all rules over the series with the given labels."""
    return alerts.alert_firing(filters.select_series(samples, **labels) if labels else samples, keys=keys, tie=tie)


def error_report(lines: DataFrame, msg="msg", keys=("host",)) -> DataFrame:
    """Failure-oriented lines by category, with how many may succeed on a retry."""
    failures = filters.failure_lines(lines, msg).withColumn("category", classify_failure(F.lit(""), msg))
    return failures.groupBy(*keys, "category").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(is_rate_limited(msg)).alias("rate_limited")).withColumn(
        "retryable", is_retryable("category"))
