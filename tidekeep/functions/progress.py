"""Progress events of run logs."""

from pyspark.sql import Column, DataFrame, functions as F

from tidekeep.functions.text import blank, col, strip

_FOUND, _PROCESSING = "found ", "] processing "
_STARTING = "starting dump for database="
_COMPLETED = "completed dump for database="


def _rest(msg: Column, marker: str) -> Column:
    """Text behind the first occurrence of the marker."""
    return F.substr(msg, F.instr(msg, marker) + len(marker))


def _raw_event(msg: Column) -> dict[str, Column]:
    """Kind of the event and what each kind would take from the line."""
    found = F.regexp_extract(_rest(msg, _FOUND), r"^\s*([+-]?\d+)\s+databases", 1)
    head = F.substring_index(msg, _PROCESSING, 1)
    place = F.when(head.contains("["), F.substring_index(head, "[", -1))
    numbers = r"^\]*([+-]?\d+)/([+-]?\d+)\]*$"
    proc_db, done_db = strip(_rest(msg, _PROCESSING)), strip(F.substring_index(_rest(msg, _COMPLETED), " ", 1))
    is_found = msg.contains(_FOUND) & msg.contains(" databases") & (found != "")
    is_proc = msg.contains(_PROCESSING) & F.coalesce(place.rlike(numbers), F.lit(False)) & (proc_db != "")
    kind = (
        F.when(is_found, "found").when(is_proc, "processing")
        .when(msg.contains(_STARTING), "starting")
        .when(msg.contains(_COMPLETED) & ~blank(done_db), "completed")
        .when(msg.contains("s3 upload:"), "upload")
        .when(msg.contains("cleanup:") | msg.contains("deleting old backup folder"), "cleanup")
    )

    def number(text):
        return text.try_cast("bigint")

    return {
        "kind": kind,
        "found": F.when(msg.contains(_FOUND), number(found)),
        "of": F.when(msg.contains(_PROCESSING), number(F.regexp_extract(place, numbers, 2))),
        "place": F.when(msg.contains(_PROCESSING), number(F.regexp_extract(place, numbers, 1))),
        "proc_db": F.when(msg.contains(_PROCESSING), proc_db),
        "start_db": F.when(msg.contains(_STARTING), strip(_rest(msg, _STARTING))),
        "done_db": F.when(msg.contains(_COMPLETED), done_db),
    }


def _event_fields(raw) -> dict[str, Column]:
    kind = raw("kind")
    return {
        "kind": kind,
        "total": F.when(kind == "found", raw("found")).when(kind == "processing", raw("of")),
        "current": F.when(kind == "processing", raw("place")),
        "db": F.when(kind == "processing", raw("proc_db")).when(kind == "starting", raw("start_db"))
               .when(kind == "completed", raw("done_db")),
    }


def parse_progress_event(msg) -> Column:
    """Struct (kind, total, current, db); kind is NULL for any other line."""
    raw = _raw_event(col(msg))
    return F.struct(*[c.alias(name) for name, c in _event_fields(raw.__getitem__).items()])


def progress_events(lines: DataFrame, msg="msg") -> DataFrame:
    """Adds ``_event`` (as ``parse_progress_event``) and keeps the lines that are events.

    The generator makes Spark parse each line once, where a filter on a parsed
    column would be evaluated a second time below the projection.
    """
    raw = F.struct(*[c.alias(name) for name, c in _raw_event(col(msg)).items()])
    parsed = lines.select("*", F.explode(F.array(raw)).alias("_raw")).where("_raw.kind IS NOT NULL")
    fields = _event_fields(lambda name: F.col(f"_raw.{name}"))
    return parsed.withColumn("_event", F.struct(*[c.alias(name) for name, c in fields.items()])).drop("_raw")


def progress_percent(total, current, completed) -> Column:
    """Share of databases done; an open database counts as 0.35 of one."""
    total, current, completed = (col(c).cast("double") for c in (total, current, completed))
    done = completed / total
    with_open = F.when(current > completed, F.greatest(done, (current - 1) / total + 0.35 / total)).otherwise(done)
    return (F.when(F.coalesce(total <= 0, F.lit(True)), F.lit(0.0))
            .when((with_open > 0.99) & (completed < total), F.lit(0.99))
            .otherwise(with_open))
