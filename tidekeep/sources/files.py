"""File sources: run history, manifests, artifacts, dumps, schedule state, overrides, logs, gauges."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tidekeep import schemas
from tidekeep.functions.text import blank
from tidekeep.operators.logs import continued_lines

FILE = "_metadata.file_path"


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """What ``read`` gives, or an empty frame where the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def record_defaults(runs: DataFrame) -> DataFrame:
    """A number that is left out means 0; the zero time means none."""
    filled = {}
    for field in runs.schema.fields:
        if isinstance(field.dataType, (T.IntegerType, T.LongType, T.DoubleType)):
            filled[field.name] = F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType))
        if isinstance(field.dataType, T.TimestampType):
            filled[field.name] = F.when(F.year(field.name) > 1, F.col(field.name))
    result_type = runs.schema["results"].dataType.elementType
    filled["results"] = F.transform("results", lambda r: F.struct(*[
        (F.coalesce(r[f.name], F.lit(0).cast(f.dataType)) if isinstance(f.dataType, (T.IntegerType, T.LongType))
         else r[f.name]).alias(f.name) for f in result_type.fields]))
    return runs.withColumns(filled)


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """Run records of JSON-lines files.

    Unreadable lines are kept in ``_corrupt_record``. ``_file`` and ``_seq``
    order records of equal time within one file.
    """
    schema = f"{schemas.RUN}, _corrupt_record string"
    def read():
        return spark.read.schema(schema).json(path).withColumns({
            "_file": F.col(FILE), "_seq": F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())})
    runs = _or_empty(spark, read, f"{schema}, _file string, _seq struct<file_block_start: bigint, seq: bigint>")
    return record_defaults(runs).withColumns({"host": F.col("hostname"), "ts": F.col("timestamp")})


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per manifest file below ``<root>``, whatever its folders are named."""
    def read():
        return (spark.read.schema(schemas.RUN).option("multiLine", True).option("recursiveFileLookup", True)
                .option("pathGlobFilter", "*.json").json(root))
    runs = record_defaults(_or_empty(spark, read, schemas.RUN))
    return runs.withColumns({"host": F.col("hostname"), "ts": F.col("timestamp")})


def read_artifacts(spark: SparkSession, root: str, hosts: bool = False) -> DataFrame:
    """Files ``<root>/<run>/<db>.sql.gz``, or with ``hosts`` ``<root>/<host>/<run>/<db>.sql.gz``, with their size;
    contents are not read.

    Spark's file sources leave empty files out; ``list_folders`` finds them.
    """
    def read():
        return (spark.read.format("binaryFile").option("pathGlobFilter", "*.sql.gz").load(f"{root}/*/*" if hosts else f"{root}/*")
                .select("path", F.col("length").alias("bytes")))
    files = _or_empty(spark, read, "path string, bytes bigint")
    host = [F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("host")] if hosts else []
    return files.select(*host, F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"),
                        F.regexp_extract("path", r"([^/]+)\.sql\.gz$", 1).alias("db"), "path", "bytes")


def read_inventory(spark: SparkSession, root: str, hosts: bool = False) -> DataFrame:
    """All files below the run folders of ``root``: run, path in the run, size, time; with ``hosts``, run folders stand
    below folders of their hosts, and ``host`` comes first."""
    def read():
        return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
                .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))
    files = _or_empty(spark, read, "path string, size bigint, mtime timestamp")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    below = F.split(F.substr("path", F.instr("path", f"/{base}/") + len(base) + 2), "/", 3 if hosts else 2)
    names = ["host", "run_id", "rel_path"] if hosts else ["run_id", "rel_path"]
    return files.select(*[F.get(below, F.lit(i)).alias(n) for i, n in enumerate(names)],
                        "path", "size", "mtime", F.lit(False).alias("is_dir")).where(F.col("rel_path").isNotNull())


def read_dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text of compressed dumps, line by line."""
    return _or_empty(spark, lambda: spark.read.text(path).select(F.col(FILE).alias("path"), F.col("value").alias("line")),
                     "path string, line string")


def read_schedule_state(spark: SparkSession, path: str) -> DataFrame:
    """Rows (host, kind, last_success) of state files ``<host>/<file>``; an unreadable time is NULL."""
    def read():
        return spark.read.schema(schemas.SCHEDULE_STATE).option("multiLine", True).json(path).withColumn("_file", F.col(FILE))
    state = _or_empty(spark, read, f"{schemas.SCHEDULE_STATE}, _file string")
    shaped = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    rows = state.select(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1).alias("host"), F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_last_success").alias("at"))
        for kind in ("logical", "physical")])))
    return rows.select("host", "kind", F.when(F.col("at").rlike(shaped), F.col("at").try_cast("timestamp"))
                       .alias("last_success"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Rows (host, key, value, expires_at) of override files ``<host>/<file>``."""
    def read():
        return spark.read.schema(schemas.OVERRIDES).option("multiLine", True).json(path).withColumn("_file", F.col(FILE))
    rows = _or_empty(spark, read, f"{schemas.OVERRIDES}, _file string")
    return rows.select(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1).alias("host"),
                       F.explode("values").alias("key", "value"), "expires_at")


def number_lines(lines: DataFrame) -> DataFrame:
    """Line numbers within each file, from 1.

    Rows of one split of a file (columns _file, _block, _seq) have running
    numbers already; a few rows, with the first number and the lines of the
    splits in front, tell where each split begins. Lines are not shuffled as
    long as these few rows are small enough to be sent to all.
    """
    sizes = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_file", "_block", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"))
    numbered = lines.join(offsets, ["_file", "_block"])
    return numbered.withColumn("line_no", F.col("_seq") + F.col("_offset") + 1).drop("_block", "_seq", "_offset")


def text_lines(spark: SparkSession, path: str, name_filter: str | None = None) -> DataFrame:
    def read():
        reader = spark.read.option("lineSep", "\n")
        if name_filter:
            reader = reader.option("pathGlobFilter", name_filter).option("recursiveFileLookup", True)
        return reader.text(path).select(
            F.col(FILE).alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seq"), F.rtrim("value", F.lit("\r")).alias("value"))
    return _or_empty(spark, read, "_file string, _block bigint, _seq bigint, value string")


def split_log_line(lines: DataFrame, value="value") -> DataFrame:
    """Adds ``ts`` and ``msg``; a line of another shape keeps its text and has no time."""
    pattern = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{6}) (.*)$"
    stamp = F.regexp_extract(value, pattern, 1)
    ts = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS"))
    msg = F.when(ts.isNotNull(), F.regexp_extract(value, pattern, 2)).otherwise(F.col(value))
    return lines.withColumns({"ts": ts, "msg": msg})


def read_run_logs(spark: SparkSession, folder: str, continued: bool = False) -> DataFrame:
    """Lines of the per-run logs ``<host>/<run>.log``; the daily copies are left out.

    With ``continued``, a line without a time has that of the line it continues (see ``continued_lines``).
    """
    lines = number_lines(text_lines(spark, folder, "*_*.log"))
    named = split_log_line(lines).select(
        F.regexp_extract("_file", r"([^/]+)/[^/]+\.log$", 1).alias("host"),
        F.regexp_extract("_file", r"([^/]+)\.log$", 1).alias("run_id"), "line_no", "ts", "msg")
    return continued_lines(named) if continued else named


def read_log_lines(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Raw lines of a log file, or of the daily log of ``date`` in a folder."""
    lines = text_lines(spark, f"{path}/{date}.log" if date else path)
    return number_lines(lines).select("line_no", F.col("value").alias("line"))


def parse_metric_lines(lines: DataFrame, value="value") -> DataFrame:
    """Gauge lines ``name{labels} value`` as metric, labels, value; anything else is dropped."""
    fields = F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")
    text = F.trim(F.col(value))
    label = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
    names, values = (F.regexp_extract_all(text, F.lit(label), i) for i in (1, 2))
    plain = F.transform(values, lambda v: F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    return lines.where(~blank(value) & ~text.startswith("#") & (F.size(fields) >= 2)).withColumns({
        "metric": F.substring_index(F.get(fields, F.lit(0)), "{", 1),
        "labels": F.map_from_arrays(names, plain),
        "value": F.coalesce(F.element_at(fields, -1).try_cast("double"), F.lit(0.0))})


def read_metric_text(spark: SparkSession, path: str) -> DataFrame:
    """Samples of gauge files ``<host>/<file>``; their time is that of the file."""
    def read():
        return spark.read.option("recursiveFileLookup", True).text(path).select(
            "value", F.col(FILE).alias("_file"), F.col("_metadata.file_modification_time").alias("ts"))
    lines = _or_empty(spark, read, "value string, _file string, ts timestamp")
    host = F.regexp_extract("_file", r"(?:host=)?([^/=]+)/[^/]+$", 1)
    return parse_metric_lines(lines.withColumn("host", host)).select("host", "metric", "labels", "ts", "value")
