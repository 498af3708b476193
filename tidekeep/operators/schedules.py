"""Which schedules are due, for a whole table of hosts at once."""

from pyspark.sql import DataFrame, functions as F

from tidekeep.functions.schedules import schedule_parts


def _after(ts, minutes=None, seconds=None):
    zero, none = F.lit(0), F.lit(0).cast("decimal(18,6)")
    if seconds is not None:
        return ts + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
    return ts + F.make_dt_interval(zero, zero, minutes, none)


def schedule_due(cases: DataFrame, now="now", schedule="schedule", last_success="last_success",
                 zone="UTC") -> DataFrame:
    """Adds ``due``, ``target`` (the slot the decision rests on), ``reason`` and ``error``.

    Times without a zone are wall-clock times of ``zone``; times with one are
    moved there. Without a last success only today (daily) or this week
    (weekly) is looked at; with one, the first slot after it decides, so that a
    missed slot is caught up. The next day is a calendar day.
    """
    types = dict(cases.dtypes)

    def wall_clock(name):
        local = F.col(name).cast("timestamp_ntz")
        if types[name] == "timestamp":
            return F.convert_timezone(F.current_timezone(), F.lit(zone), local)
        return local

    # A fleet shares few schedule texts: each is parsed once and joined back.
    texts = cases.select(F.col(schedule).alias("_text")).distinct()
    plans = texts.select("_text", *[c.alias(f"_{name}") for name, c in schedule_parts("_text").items()])
    df = cases.withColumns({"_now": wall_clock(now), "_last": wall_clock(last_success)})
    df = df.join(plans, F.col(schedule).eqNullSafe(F.col("_text")), "left")
    t, last, kind, minutes, error = (F.col(c) for c in ("_now", "_last", "_kind", "_minutes", "_error"))
    first_run = last.isNull()

    def midnight(ts):
        return F.date_trunc("day", ts).cast("timestamp_ntz")

    def slots(day):
        return F.transform(minutes, lambda m: _after(day, minutes=m))

    def on_day(ts, days):
        return _after(F.date_add(ts.cast("date"), days).cast("timestamp_ntz"), minutes=F.get(minutes, F.lit(0)))

    week, day = F.expr("INTERVAL 7 DAY"), F.expr("INTERVAL 1 DAY")
    weekday = F.col("_weekday")
    df = df.withColumns({
        "_today": F.when(kind == "daily", slots(midnight(t))),
        "_later": F.when(kind == "daily", F.concat(slots(midnight(last)), slots(midnight(last) + day))),
        "_this_week": F.when(kind == "weekly", on_day(t, -F.pmod(F.dayofweek(t) - 1 - weekday, F.lit(7)))),
        "_week_after": F.when(kind == "weekly", on_day(last, F.pmod(weekday - F.dayofweek(last) + 1, F.lit(7)))),
    })
    today, this_week, week_after = F.col("_today"), F.col("_this_week"), F.col("_week_after")
    passed = F.array_max(F.filter(today, lambda slot: slot <= t))
    df = df.withColumn("target", F.when(error.isNotNull(), F.lit(None).cast("timestamp_ntz"))
        .when((kind == "daily") & first_run, F.coalesce(passed, F.get(today, F.lit(0))))
        .when(kind == "daily", F.array_min(F.filter("_later", lambda slot: slot > last)))
        .when((kind == "weekly") & first_run, this_week)
        .when(kind == "weekly", F.when(week_after <= last, week_after + week).otherwise(week_after))
        .when((kind == "interval") & ~first_run, _after(last, seconds=F.col("_interval_seconds"))))
    target = F.col("target")
    df = df.withColumn("due", F.when(error.isNotNull() | (kind == "disabled"), F.lit(False))
                       .when(target.isNull(), F.lit(True)).otherwise(target <= t))

    raw = F.coalesce(F.col(schedule), F.lit(""))
    at = F.date_format(target, "yyyy-MM-dd'T'HH:mm:ss")
    at = F.concat(at, F.lit("Z")) if zone == "UTC" else at
    wording = (
        F.when(target.isNull(), F.lit(" first run"))
        .when(F.col("due") & (kind == "interval"), F.concat(F.lit(" due since "), at))
        .when(F.col("due"), F.concat(F.lit(" due at "), at))
        .when(first_run, F.concat(F.lit(" waiting until "), at))
        .otherwise(F.concat(F.lit(" next due at "), at))
    )
    df = df.withColumn("reason", F.when(error.isNotNull(), F.lit(""))
                       .when(kind == "always", F.lit("schedule=always"))
                       .when(kind == "disabled", F.concat(F.lit("schedule="), raw))
                       .otherwise(F.concat(F.lit("schedule="), raw, wording)))
    return df.select(*cases.columns, "due", "target", "reason", F.col("_error").alias("error"))
