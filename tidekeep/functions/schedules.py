"""Schedule texts: parsing, and whether a schedule is due."""

from pyspark.sql import Column, functions as F

from tidekeep.functions.durations import duration_seconds
from tidekeep.functions.text import col, keep_last_per_key, strip

# Weekday names, Sunday = 0.
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def parse_list(text) -> Column:
    """Comma-separated items, trimmed, blanks dropped."""
    items = F.transform(F.split(col(text), ","), strip)
    return F.filter(items, lambda item: item != "")


def parse_table_scope(text) -> Column:
    """``db:t1,t2;db2:t3`` as map of arrays; the last entry of a database counts."""
    specs = F.transform(F.split(col(text), ";"), strip)
    specs = F.filter(specs, lambda spec: spec.contains(":"))
    entries = F.transform(specs, lambda spec: F.struct(
        strip(F.substring_index(spec, ":", 1)).alias("key"),
        parse_list(F.substr(spec, F.instr(spec, ":") + 1)).alias("value")))
    entries = F.filter(entries, lambda entry: entry["key"] != "")
    return F.map_from_entries(keep_last_per_key(entries))


def format_table_scope(scope) -> Column:
    """Text of a scope map, databases and tables in order."""
    entries = F.array_sort(F.map_entries(col(scope)))
    return F.concat_ws(";", F.transform(entries, lambda e: F.concat(
        e["key"], F.lit(":"), F.array_join(F.array_sort(e["value"]), ","))))


def _clock(text: Column) -> Column:
    """Minute of day of ``HH:MM`` and the reason where it is none."""
    text = strip(text)
    parts = F.split(text, ":")
    hour, minute = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))

    def number(part):
        return F.when(part.rlike(r"^[+-]?\d+$"), part.try_cast("int"))

    def outside(part, top):
        return F.coalesce((number(part) < 0) | (number(part) > top), F.lit(True))

    error = (F.when(F.size(parts) != 2, F.lit("expected HH:MM"))
             .when(outside(hour, 23), F.concat(F.lit('invalid hour "'), hour, F.lit('"')))
             .when(outside(minute, 59), F.concat(F.lit('invalid minute "'), minute, F.lit('"'))))
    value = F.when(error.isNull(), number(hour) * 60 + number(minute))
    return F.struct(value.alias("minute"), error.alias("error"))


def _after_at(text: Column, default: str) -> Column:
    return F.when(text.contains("@"), strip(F.substr(text, F.instr(text, "@") + 1))).otherwise(F.lit(default))


def parse_schedule(text) -> Column:
    """Struct (kind, minutes, weekday, interval_seconds, error)."""
    return F.struct(*[c.alias(name) for name, c in schedule_parts(text).items()])


def schedule_parts(text) -> dict[str, Column]:
    """The fields of a schedule text, each as a column of its own."""
    raw = F.coalesce(col(text), F.lit(""))
    s = F.lower(strip(raw))
    kind = (F.when(s.isin("", "always"), "always").when(s.isin("disabled", "off", "never"), "disabled")
            .when(s.startswith("interval@"), "interval").when(s.startswith("daily"), "daily")
            .when(s.startswith("weekly"), "weekly").otherwise("invalid"))

    interval = duration_seconds(F.substr(s, F.lit(len("interval@") + 1)))
    interval_error = F.when(F.coalesce(interval <= 0, F.lit(True)), "expected interval@<duration>")

    clocks = F.transform(F.split(_after_at(s, "00:00"), ","), _clock)
    bad_clock = F.get(F.filter(clocks, lambda c: c["error"].isNotNull()), F.lit(0))["error"]
    daily = F.array_sort(F.array_distinct(F.transform(clocks, lambda c: c["minute"])))

    spec = _after_at(s, "sun,00:00")
    day_name = strip(F.substring_index(spec, ",", 1))
    weekday = F.lit(None).cast("int")
    for number, name in enumerate(WEEKDAYS):
        weekday = F.when(day_name.isin(name, name[:3]), number).otherwise(weekday)
    clock = _clock(F.substr(spec, F.instr(spec, ",") + 1))
    weekly_error = (F.when(~spec.contains(","), F.lit("expected weekly@<weekday>,HH:MM"))
                    .when(weekday.isNull(), F.concat(F.lit('invalid weekday "'),
                                                     F.substring_index(spec, ",", 1), F.lit('"')))
                    .otherwise(clock["error"]))

    reason = (F.when(kind == "interval", interval_error).when(kind == "daily", bad_clock)
              .when(kind == "weekly", weekly_error)
              .when(kind == "invalid", "supported values are always, disabled, daily@HH:MM[,HH:MM...], "
                                       "weekly@day,HH:MM, interval@24h"))
    error = F.when(reason.isNotNull(), F.concat(F.lit('invalid schedule "'), raw, F.lit('": '), reason))
    minutes = F.when(kind == "daily", daily).when(kind == "weekly", F.array(clock["minute"]))
    valid = reason.isNull()
    return {
        "kind": kind,
        "minutes": F.when(valid, minutes),
        "weekday": F.when((kind == "weekly") & valid, weekday),
        "interval_seconds": F.when((kind == "interval") & valid, interval),
        "error": error,
    }
