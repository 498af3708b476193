"""Duration texts such as ``1h2m3.5s`` and run ids that hold a time."""

from pyspark.sql import Column, functions as F

from tidekeep.functions.text import col, strip

# Nanoseconds per unit.
UNIT_NANOS = {
    "ns": 1, "us": 10 ** 3, "µs": 10 ** 3, "μs": 10 ** 3, "ms": 10 ** 6,
    "s": 10 ** 9, "m": 60 * 10 ** 9, "h": 3600 * 10 ** 9,
}
_TERM = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"


def duration_seconds(text) -> Column:
    """Seconds as double; NULL where the text is no duration."""
    text = strip(text)
    numbers = F.regexp_extract_all(text, F.lit(_TERM), 1)
    units = F.regexp_extract_all(text, F.lit(_TERM), 2)
    nanos_of = F.create_map(*[x for unit, n in UNIT_NANOS.items()
                              for x in (F.lit(unit), F.lit(n).cast("decimal(14,0)"))])

    def term_nanos(number, unit):
        nanos = number.try_cast("decimal(28,9)") * nanos_of[unit]
        return F.floor(nanos).cast("double")

    terms = F.zip_with(numbers, units, term_nanos)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, n: acc + n)
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    seconds = sign * total / 1e9
    valid = text.rlike(rf"^[-+]?(0|({_TERM})+)$") & (total < 2.0 ** 63)
    return F.when(valid, F.when(total == 0, F.lit(0.0)).otherwise(seconds))


def parse_duration(text) -> Column:
    """Seconds as double; 0 where the text is blank or no duration."""
    return F.coalesce(duration_seconds(text), F.lit(0.0))


def format_duration(seconds) -> Column:
    """Duration text of a number of seconds, rounded to the millisecond."""
    seconds = col(seconds).cast("double")
    ms = F.round(F.abs(seconds) * 1000).cast("bigint")
    hours, minutes = F.floor(ms / 3600000), F.floor(ms / 60000) % 60
    rest = ms % 60000
    fraction = F.rtrim(F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("0"))
    secs = F.concat(F.concat_ws(".", F.floor(rest / 1000).cast("string"), F.nullif(fraction, F.lit(""))), F.lit("s"))
    text = (
        F.when(ms == 0, F.lit("0s"))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, secs)
        .when(ms < 3600000, F.concat(minutes.cast("string"), F.lit("m"), secs))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), secs))
    )
    return F.concat(F.when((seconds < 0) & (ms > 0), F.lit("-")).otherwise(F.lit("")), text)


def parse_run_id(run_id) -> Column:
    """Local time written in a run id, NULL where the id holds none."""
    run_id = col(run_id)
    shaped = F.when(run_id.rlike(r"^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}$"), run_id)
    return F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd_HH-mm-ss")).cast("timestamp_ntz")
