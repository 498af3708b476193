"""Alert rules over gauges: a rule fires once its condition has held long enough."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidekeep.operators.running import DAY, Running, running, time_chunk, with_chunk


@dataclass
class Rule:
    """``condition`` gets the gauges of a host and the seconds since a time gauge."""

    name: str
    severity: str
    hold_seconds: int
    metrics: list[str]
    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _zero(metric):
    return [metric], lambda gauge, age: gauge(metric) == 0


# Rule, severity, hold time in seconds, condition.
RULES = [
    Rule("backup_failed_overall", "critical", 300, *_zero("backup_last_status")),
    Rule("logical_backup_failed", "critical", 300, ["backup_logical_last_attempted", "backup_logical_last_status"],
         lambda g, age: (g("backup_logical_last_attempted") == 1) & (g("backup_logical_last_status") == 0)),
    Rule("physical_backup_failed", "critical", 300, ["backup_physical_last_attempted", "backup_physical_last_status"],
         lambda g, age: (g("backup_physical_last_attempted") == 1) & (g("backup_physical_last_status") == 0)),
    Rule("upload_failed", "critical", 300, *_zero("backup_upload_success")),
    Rule("metrics_write_failed", "warning", 300, *_zero("backup_metrics_write_success")),
    Rule("cleanup_failed", "warning", 900, *_zero("backup_cleanup_success")),
    Rule("logical_validation_failed", "warning", 900, *_zero("backup_logical_validation_last_status")),
    Rule("backup_stuck_running", "warning", 600, ["backup_run_in_progress", "backup_current_run_duration_seconds"],
         lambda g, age: (g("backup_run_in_progress") == 1) & (g("backup_current_run_duration_seconds") > 7200)),
    Rule("metrics_stale_during_run", "warning", 120, ["backup_run_in_progress", "backup_metrics_last_update_timestamp"],
         lambda g, age: (g("backup_run_in_progress") == 1) & (age("backup_metrics_last_update_timestamp") > 120)),
    Rule("no_recent_success", "critical", 900, ["backup_last_success_timestamp"],
         lambda g, age: age("backup_last_success_timestamp") > 43200),
]


def alert_rules() -> list[Rule]:
    return list(RULES)


def rule_metrics(rules) -> list[str]:
    return sorted({m for rule in rules for m in rule.metrics})


def rule_conditions(rules, prefix: str, now: Column) -> dict[str, Column]:
    """Truth of every rule over columns named prefix + gauge; a missing gauge makes it false."""
    def gauge(metric):
        return F.col(f"{prefix}{metric}")

    def age(metric):
        return now - gauge(metric)

    return {rule.name: F.coalesce(rule.condition(gauge, age), F.lit(False)) for rule in rules}


def seconds(ts) -> Column:
    """Unix seconds with fraction."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def evaluations(samples: DataFrame, keys, metrics, tie="value") -> DataFrame:
    """One row per key and sample time with the gauges sampled then."""
    def value_of(metric):
        mine = F.col("metric") == metric
        return F.max_by(F.when(mine, F.col("value").cast("double")), F.when(mine, F.col(tie)))

    wanted = samples.where(F.col("metric").isin(metrics))
    return wanted.groupBy(*keys, "ts").agg(*[value_of(m).alias(f"_at_{m}") for m in metrics])


def alert_firing(samples: DataFrame, rules=None, keys=("host",), tie="value",
                 chunk: Column | None = None) -> DataFrame:
    """When each rule fired: (keys, rule, severity, started_at, fired_at).

    Rules are evaluated at the sample times of a key with the latest value of
    every gauge; a gauge that is absent for a while does not break a spell.
    A rule fires at the first evaluation at which its condition has been true
    without a break for its hold time.
    """
    rules, keys = rules or RULES, list(keys)
    metrics = rule_metrics(rules)
    points = with_chunk(evaluations(samples, keys, metrics, tie), keys,
                        time_chunk("ts", DAY) if chunk is None else chunk)

    # Gauges at each evaluation and at the one before it.
    at = {m: F.col(f"_at_{m}") for m in metrics}
    state = running(points, keys, ["ts"], {
        **{f"_now_{m}": Running("last", c) for m, c in at.items()},
        **{f"_was_{m}": Running("last", c, before=True) for m, c in at.items()},
        "_was_ts": Running("max", F.col("ts"), before=True)})
    state = state.drop(*[f"_at_{m}" for m in metrics])

    # A spell starts where a condition is true that was not true before.
    now = rule_conditions(rules, "_now_", seconds("ts"))
    was = rule_conditions(rules, "_was_", seconds("_was_ts"))
    judged = state.select(*keys, "ts", "_chunk", *[F.struct(now[r.name].alias("on"), was[r.name].alias("was")).alias(r.name)
                                                   for r in rules])
    started = running(judged, keys, ["ts"], {
        f"_start_{r.name}": Running("last", F.when(F.col(r.name)["on"] & ~F.col(r.name)["was"], F.col("ts")))
        for r in rules})
    begun = {r.name: F.when(F.col(r.name)["on"] & (seconds("ts") - seconds(f"_start_{r.name}") >= r.hold_seconds),
                            F.col(f"_start_{r.name}")) for r in rules}
    holding = started.select(*keys, "ts", *[c.alias(name) for name, c in begun.items()])
    holding = holding.where(F.coalesce(*begun).isNotNull())
    held = holding.select(*keys, "ts", F.inline(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(r.name).alias("started_at"))
        for r in rules]))).where(F.col("started_at").isNotNull())
    return held.groupBy(*keys, "rule", "severity", "started_at").agg(F.min("ts").alias("fired_at"))


def vector_and(left: DataFrame, right: DataFrame, on=("labels", "ts")) -> DataFrame:
    """Left samples whose label set is on the right as well, at the same time."""
    def keyed(df):
        return df.withColumn("_labels", F.array_join(F.array_sort(F.transform(
            F.map_entries("labels"), lambda e: F.to_json(F.struct(e["key"], e["value"])))), ",")) if "labels" in on else df

    columns = ["_labels" if c == "labels" else c for c in on]
    return keyed(left).join(keyed(right).select(*columns).distinct(), columns, "left_semi").select(*left.columns)
