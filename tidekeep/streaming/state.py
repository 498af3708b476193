"""Stateful streams: progress of live runs, alerts, and gauges that stop.

Alerts and stale gauges depend on the order of samples. Samples wait in the
state of their key until the watermark has passed them, are then taken in
time order, and so give what the batch operators give, no matter in which
micro-batch they came. The state of a key holds the samples of the watermark
delay, no more. Rows outside the delay are late and counted by Spark.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidekeep.functions.progress import progress_events, progress_percent
from tidekeep.operators.alerts import RULES, rule_metrics

NONE = -1  # no time


def _micros(column: pd.Series) -> np.ndarray:
    return column.astype("datetime64[us]").astype("int64").to_numpy()


def _times(micros) -> pd.Series:
    return pd.Series(np.asarray(micros, "int64").astype("datetime64[us]"))


def _key_schema(df: DataFrame, keys) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


class _Waiting:
    """Samples of one key: those the watermark has passed, and those that still wait.

    A sample takes three numbers; frames of a backlog are let go one by one as they are taken over.
    """

    def __init__(self, kept, batches, watermark_ms: int):
        parts = [[np.array(k, t) for k, t in zip(kept, ("int64", "int64", "float64"))]]
        for batch in batches:
            parts.append([_micros(batch["ts"]), batch["series"].to_numpy("int64"), batch["value"].to_numpy("float64")])
        ts, series, value = (np.concatenate(column) for column in zip(*parts))
        del parts
        passed = ts <= watermark_ms * 1000
        self.kept = tuple(x[~passed].tolist() for x in (ts, series, value))
        order = np.lexsort((value[passed], series[passed], ts[passed]))
        self.ts, self.series, self.value = (x[passed][order] for x in (ts, series, value))

    def chunks(self, size: int = 1 << 16):
        """Samples that are ready, in the order of time and about ``size`` at once; equal times stay together."""
        at = 0
        while at < len(self.ts):
            end = min(at + size, len(self.ts))
            end = int(np.searchsorted(self.ts, self.ts[end - 1], side="right"))
            yield self.ts[at:end], self.series[at:end], self.value[at:end]
            at = end

    def wake_at(self) -> int | None:
        """First millisecond at which a waiting sample is due."""
        return -(-min(self.kept[0]) // 1000) if self.kept[0] else None


WAITING_SCHEMA = "w_ts array<bigint>, w_series array<bigint>, w_value array<double>"


def _spells(on: np.ndarray, ts: np.ndarray, hold: int, started: int, fired: bool):
    """Transitions of one rule over evaluations; returns them and what is left open."""
    events = []
    edges = np.flatnonzero(np.diff(np.concatenate([[started != NONE], on]).astype("int8")))
    pieces = np.concatenate([[0], edges, [len(on)]])
    for first, last in zip(pieces[:-1], pieces[1:]):
        if first == last:
            continue
        if not on[first]:
            if started != NONE:
                events.append(("resolved" if fired else "inactive", started, ts[first]))
            started, fired = NONE, False
            continue
        if started == NONE:
            started = ts[first]
            events.append(("pending", started, started))
        if not fired:
            due = first + np.searchsorted(ts[first:last], started + hold * 1_000_000)
            if due < last:
                fired = True
                events.append(("firing", started, ts[due]))
    return events, started, fired


def _held_values(ts, series, value, before):
    """Times and, for each gauge, its last value at each time; ``before`` holds the values up to the first."""
    times, place = np.unique(ts, return_inverse=True)
    points = np.full((len(before), len(times)), np.nan)
    points[series, place] = value  # of equal samples the last, which is the greatest
    points[:, 0] = np.where(np.isnan(points[:, 0]), before, points[:, 0])
    seen = np.maximum.accumulate(np.where(np.isnan(points), 0, np.arange(len(times))), axis=1)
    return times, np.take_along_axis(points, seen, axis=1)


def alert_stream(samples: DataFrame, rules=None, keys=("host",), late: str = "10 minutes") -> DataFrame:
    """Transitions (keys, rule, severity, state, started_at, at) of every rule and key.

    States are pending, firing, resolved (after firing) and inactive (before
    it). ``samples`` has the keys, metric, ts (timestamp) and value.
    """
    rules, keys = rules or RULES, list(keys)
    names = rule_metrics(rules)
    output = (f"{_key_schema(samples, keys)}, rule string, severity string, state string, "
              "started_at timestamp, at timestamp")
    state_schema = f"{WAITING_SCHEMA}, gauges array<double>, started array<bigint>, fired array<boolean>"

    def step(key, batches, state):
        if state.exists:
            *kept, gauges, started, fired = state.get
            gauges, started, fired = np.array(gauges), list(started), list(fired)
        else:
            kept, gauges = ([], [], []), np.full(len(names), np.nan)
            started, fired = [NONE] * len(rules), [False] * len(rules)
        waiting = _Waiting(kept, batches, state.getCurrentWatermarkMs())
        found = []
        for ts, series, value in waiting.chunks():
            ts, points = _held_values(ts, series, value, gauges)
            gauges = points[:, -1].copy()

            def gauge(name):
                return points[names.index(name)]

            for i, rule in enumerate(rules):
                on = np.asarray(rule.condition(gauge, lambda name: ts / 1e6 - gauge(name)))
                events, started[i], fired[i] = _spells(on, ts, rule.hold_seconds, started[i], fired[i])
                found += [(rule.name, rule.severity, *event) for event in events]
        state.update((*waiting.kept, gauges.tolist(), [int(s) for s in started], [bool(f) for f in fired]))
        wake = waiting.wake_at()
        if wake is not None:
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        if found:
            rule, severity, name, begin, at = zip(*found)
            yield pd.DataFrame({**{k: [v] * len(found) for k, v in zip(keys, key)}, "rule": rule, "severity": severity,
                                "state": name, "started_at": _times(begin), "at": _times(at)})

    series = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric")) - 1
    wanted = samples.where(F.col("metric").isin(names)).select(
        *keys, "ts", series.cast("bigint").alias("series"), F.col("value").cast("double").alias("value"))
    return wanted.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(
        step, output, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def stale_series(samples: DataFrame, limit_seconds: int = 120, keys=("host",), late: str = "10 minutes") -> DataFrame:
    """Hosts whose gauges stop while a run is on: (keys, last_update, stale_at).

    No row announces silence; the event-time timeout of the state does.
    """
    keys, limit = list(keys), limit_seconds * 1_000_000
    output = f"{_key_schema(samples, keys)}, last_update timestamp, stale_at timestamp"

    def step(key, batches, state):
        if state.exists:
            *kept, last, running, told = state.get
        else:
            kept, last, running, told = ([], [], []), NONE, False, False
        watermark = state.getCurrentWatermarkMs()
        waiting = _Waiting(kept, batches, watermark)
        found = []
        for ts, series, value in waiting.chunks():
            times, place = np.unique(ts, return_inverse=True)
            flag = np.full(len(times), np.nan)
            flag[place[series == 1]] = value[series == 1]
            set_at = np.maximum.accumulate(np.where(np.isnan(flag), -1, np.arange(len(times))))
            on = np.where(set_at < 0, running, flag[np.maximum(set_at, 0)] == 1)
            earlier, was_on = np.concatenate([[last], times[:-1]]), np.concatenate([[running], on[:-1]]).astype(bool)
            late_ones = was_on & (times - earlier > limit)
            late_ones[0] &= not told
            found += earlier[late_ones].tolist()
            last, running, told = int(times[-1]), bool(on[-1]), False
        # Silent up to the watermark, and nothing waits that would end the silence in time.
        ends = min(waiting.kept[0], default=None)
        if (running and not told and last != NONE and last + limit < watermark * 1000
                and (ends is None or ends - last > limit)):
            found.append(last)
            told = True
        state.update((*waiting.kept, last, running, told))
        wakes = [t for t in (waiting.wake_at(), (last + limit) // 1000 + 1 if running and not told and last != NONE
                             else None) if t is not None]
        if wakes:
            state.setTimeoutTimestamp(max(min(wakes), watermark + 1))
        if found:
            yield pd.DataFrame({**{k: [v] * len(found) for k, v in zip(keys, key)},
                                "last_update": _times(found), "stale_at": _times(np.array(found) + limit)})

    rows = samples.select(*keys, "ts", (F.col("metric") == "backup_run_in_progress").cast("bigint").alias("series"),
                          F.col("value").cast("double").alias("value"))
    return rows.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(
        step, output, f"{WAITING_SCHEMA}, last bigint, running boolean, told boolean", "append",
        GroupStateTimeout.EventTimeTimeout)


# Stage texts by kind of line, before the name of a database or alone; "cleanup" for all other kinds.
NAMED_STAGES = {"processing": "processing ", "starting": "dumping ", "completed": "completed "}
STAGES = {"found": "discovered databases", "upload": "uploading to S3"}


def _last_set(values: np.ndarray, is_set: np.ndarray, before):
    """The last value that was set up to each place; ``before`` where none was."""
    at = np.maximum.accumulate(np.where(is_set, np.arange(len(values)), -1))
    return np.where(at < 0, before, values[np.maximum(at, 0)])


def progress_values(kind, total, current, db, before):
    """State after each of a run's progress lines, in order, and the state to go on from.

    The same running values as in ``operators.logs.progress_timeline``, seeded with the state before the lines.
    """
    total0, current0, completed0, db0 = before
    ends, sets_total = kind == "completed", (kind == "found") | ((kind == "processing") & (total > 0))
    totals = _last_set(total, sets_total, total0)
    done = completed0 + np.cumsum(ends)
    room = np.where(ends & (totals > 0), totals - done, 0)
    completed = done + np.minimum(0, np.minimum.accumulate(room))
    begins = kind == "starting"
    position = np.where(begins, np.where(totals > 0, np.minimum(completed + 1, totals), completed + 1), current)
    sets_position = begins | ((kind == "processing") & (current > 0))
    # A position holds until it is set anew; finished dumps only raise it, so it is a running maximum in between.
    span = np.cumsum(sets_position)
    raised = pd.Series(np.where(sets_position, position, np.where(ends, completed, 0))).groupby(span).cummax().to_numpy()
    places = np.where(span == 0, np.maximum(raised, current0), raised)
    names = _last_set(db, (kind == "processing") | begins, db0)
    kinds = pd.Series(kind)
    named = kinds.isin(NAMED_STAGES).to_numpy()
    fixed = kinds.map(lambda k: NAMED_STAGES.get(k) or STAGES.get(k, "cleanup")).to_numpy(object)
    stages = fixed + np.where(named, db, "")
    out = pd.DataFrame({"total": totals.astype("int64"), "current": places.astype("int64"),
                        "completed": completed.astype("int64"), "current_db": names, "stage": stages})
    return out, (int(totals[-1]), int(places[-1]), int(completed[-1]), names[-1])


def live_progress(lines: DataFrame, keys=("host", "run_id"), order="ts", idle_minutes: int | None = None) -> DataFrame:
    """State of every live run after each of its progress lines, as ``progress_timeline`` gives it.

    Lines are parsed by Spark; the function sees the few that are progress
    events. A log grows at its end, so lines of later micro-batches follow
    those of earlier ones. The state of a run is four values; it is kept, so a run that speaks again after a
    pause goes on where it was. Give ``idle_minutes`` to drop the state of runs without news for so long (a run that
    speaks later begins at zero again). ``lines`` carries a watermark.
    """
    keys = list(keys)
    columns = list(dict.fromkeys([*keys, order, "ts"]))
    events = progress_events(lines).select(*columns, "_event.*")
    kinds = dict(events.dtypes)
    output = (f"{_key_schema(events, keys)}, `{order}` {kinds[order]}, total bigint, current bigint, completed bigint, "
              "current_db string, stage string")

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else (0, 0, 0, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        numbers = (rows[c].fillna(0).to_numpy("int64") for c in ("total", "current"))
        out, after = progress_values(rows["kind"].to_numpy(object), *numbers, rows["db"].to_numpy(object), before)
        state.update(after)
        if idle_minutes is not None:
            last = max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
            state.setTimeoutTimestamp(last + idle_minutes * 60_000)
        out.insert(0, order, rows[order].to_numpy())
        for place, (name, value) in enumerate(zip(keys, key)):
            out.insert(place, name, value)
        yield out

    folded = events.groupBy(*keys).applyInPandasWithState(
        step, output, "total bigint, current bigint, completed bigint, current_db string",
        "append", GroupStateTimeout.EventTimeTimeout)
    return folded.withColumn("percent", progress_percent("total", "current", "completed"))
