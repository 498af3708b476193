"""Which runs to keep under daily, weekly and monthly retention."""

from pyspark.sql import DataFrame, Window as W, functions as F

# Bucket number of a time in each tier; larger is later.
TIERS = {
    "daily": lambda ts: F.datediff(ts, F.lit("1970-01-01").cast("date")),
    "weekly": lambda ts: F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts),
    "monthly": lambda ts: F.year(ts) * 100 + F.month(ts),
}


def candidates(runs: DataFrame, current=None) -> DataFrame:
    """Runs that can expire: those with a time, without the current run of each host.

    ``current`` is a DataFrame (host, run_id) of the runs in progress.
    """
    dated = runs.where(F.col("ts").isNotNull())
    return dated if current is None else dated.join(current, ["host", "run_id"], "left_anti")


def _tier_winners(runs: DataFrame, daily, weekly, monthly) -> DataFrame:
    """Kept run of each (host, tier, bucket).

    The newest run of a bucket is found by a combining aggregate; only one
    row per bucket is left to rank.
    """
    keep = {"daily": daily, "weekly": weekly, "monthly": monthly}
    buckets = [F.struct(F.lit(tier).alias("tier"), F.lit(keep[tier]).alias("slots"),
                        bucket(F.col("ts")).cast("bigint").alias("bucket")) for tier, bucket in TIERS.items()]
    rows = runs.select("host", "ts", "run_id", F.inline(F.array(*buckets)))
    newest = rows.groupBy("host", "tier", "slots", "bucket").agg(F.max(F.struct("ts", "run_id")).alias("run"))
    latest = W.partitionBy("host", "tier").orderBy(F.desc("bucket"))
    return (newest.withColumn("place", F.row_number().over(latest)).where("place <= slots")
            .select("host", F.col("run.run_id").alias("run_id"), "tier"))


def kept_runs(runs: DataFrame, daily=7, weekly=4, monthly=12, current=None) -> DataFrame:
    """The kept runs (host, run_id), each once, with the tiers that keep them."""
    winners = _tier_winners(candidates(runs, current), daily, weekly, monthly)
    return winners.groupBy("host", "run_id").agg(*[
        F.max(F.col("tier") == tier).alias(f"keep_{tier}") for tier in TIERS])


def gfs_retention(runs: DataFrame, daily=7, weekly=4, monthly=12, current=None) -> DataFrame:
    """Every candidate with its tier flags and ``keep``."""
    tiers = [f"keep_{tier}" for tier in TIERS]
    rows = candidates(runs, current).join(
        kept_runs(runs, daily, weekly, monthly, current), ["host", "run_id"], "left").fillna(False, subset=tiers)
    return rows.withColumn("keep", F.col("keep_daily") | F.col("keep_weekly") | F.col("keep_monthly"))


def expired_runs(runs: DataFrame, kept: DataFrame, current=None) -> DataFrame:
    return candidates(runs, current).join(kept.select("host", "run_id"), ["host", "run_id"], "left_anti")
