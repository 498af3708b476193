"""Run logs: tails, progress and error summaries."""

from pyspark.sql import DataFrame, Window as W, functions as F

from tidekeep.functions.progress import progress_events, progress_percent
from tidekeep.functions.text import contains_any, strip
from tidekeep.operators.running import Running, number_chunk, running, with_chunk

# What marks a full disk in tool output.
DISK_FULL_WORDS = ["no space left", "errno 28"]


def tail_lines(lines: DataFrame, n: int = 1000, keys=("run_id",), order="line_no") -> DataFrame:
    """The last lines of each file with the number of all its lines."""
    newest = W.partitionBy(*keys).orderBy(F.desc(order))
    last = lines.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n).drop("_back")
    totals = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_lines"))
    return last.join(totals, list(keys))


def continued_lines(lines: DataFrame, keys=("host", "run_id"), order="line_no", ts="ts", chunk_lines=1 << 16) -> DataFrame:
    """Lines in which one without a time has the time of the line before it in its file.

    ``continues`` is the number of the line that carries the time, NULL for lines that carry one themselves. Lines
    before the first time of a file stay without. A file is scanned in chunks, so its length is no matter.
    """
    known = F.col(ts).isNotNull()
    told = running(lines, list(keys), [order], {"_head": Running("last", F.when(known, F.struct(F.col(ts).alias("ts"), F.col(order).alias("at"))))},
                   number_chunk(order, chunk_lines))
    return told.withColumns({"continues": F.when(~known, F.col("_head.at")), ts: F.coalesce(ts, "_head.ts")}).drop("_head")


def stream_error_summary(lines: DataFrame, keys=("run_id", "tool"), order="line_no", line="line") -> DataFrame:
    """The line that explains a tool's failure: the last about a full disk, else the last at all."""
    text = strip(line)
    disk = contains_any(F.lower(text), DISK_FULL_WORDS)
    return lines.groupBy(*keys).agg(F.coalesce(
        F.max_by(text, F.when(disk, F.col(order))),
        F.max_by(text, F.when(text != "", F.col(order)))).alias("summary"))


def progress_timeline(lines: DataFrame, keys=("host", "run_id"), order="line_no", msg="msg", chunk_lines=1 << 16) -> DataFrame:
    """State of a run after each of its progress lines.

    A log is an ordered fold. Each part of its state is a running value:

    * the number of databases, the open one and the stage are last values;
    * finished databases count up but never beyond the number known then, so
      the count is n + min(0, least (number - n) so far);
    * the position is set by some lines and only raised by finished dumps in
      between, so it is a running maximum since the line that set it.
    """
    event = F.col("_event")
    kind, db = event["kind"], event["db"]
    events = progress_events(lines, msg).select(*keys, order, "_event")
    rows = with_chunk(events, [*keys], number_chunk(order, chunk_lines))
    sets_total = (kind == "found") | ((kind == "processing") & (event["total"] > 0))
    sets_position = ((kind == "processing") & (event["current"] > 0)) | (kind == "starting")
    stage = (F.when(kind == "found", F.lit("discovered databases"))
             .when(kind == "processing", F.concat(F.lit("processing "), db))
             .when(kind == "starting", F.concat(F.lit("dumping "), db))
             .when(kind == "completed", F.concat(F.lit("completed "), db))
             .when(kind == "upload", F.lit("uploading to S3")).otherwise(F.lit("cleanup")))
    state = running(rows, [*keys], [order], {
        "total": Running("last", F.when(sets_total, event["total"])),
        "_done": Running("sum", (kind == "completed").cast("bigint")),
        "current_db": Running("last", F.when(kind.isin("processing", "starting"), db)),
        "stage": Running("last", stage),
        "_span": Running("sum", sets_position.cast("bigint")),
    })
    total, done = F.coalesce("total", F.lit(0)), F.col("_done")
    room = F.when((kind == "completed") & (total > 0), total - done)
    state = running(state, [*keys], [order], {"_room": Running("min", room)})
    completed = done + F.least(F.lit(0), F.coalesce("_room", F.lit(0)))
    state = state.withColumns({"total": total, "completed": completed})

    next_one = F.col("completed") + 1
    position = (F.when((kind == "processing") & (event["current"] > 0), event["current"])
                .when(kind == "starting", F.when((F.col("total") > 0) & (next_one > F.col("total")), F.col("total"))
                      .otherwise(next_one))
                .when(kind == "completed", F.col("completed")))
    state = running(state, [*keys, "_span"], [order], {"_position": Running("max", position)})
    current = F.when(F.col("_span") == 0, F.greatest(F.lit(0), F.coalesce("_position", F.lit(0)))).otherwise(F.col("_position"))
    return state.select(
        *keys, order, "total", current.cast("bigint").alias("current"), "completed", "current_db", "stage",
        progress_percent("total", current, "completed").alias("percent"))
