"""Running values over long histories.

A window over one key puts the whole history of that key into one task. Here
the history of a key is cut into chunks (a stretch of time or of line
numbers); each chunk is scanned on its own, the chunk totals of a key, which
are few, are scanned next, and both are put together. A key that holds a large
share of all rows is so spread over as many tasks as it has chunks.
"""

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DAY = 86400
MONTH = 30 * DAY
CHUNK = "_chunk"


def time_chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds).cast("bigint")


def balanced_chunk(df: DataFrame, order: str, chunks: int = 256) -> Column:
    """Chunks of about equal size wherever the rows lie, for histories that crowd in a short time.

    Takes one pass over the column to find the cuts, which are a few numbers.
    """
    value = F.col(order)
    if dict(df.dtypes)[order].startswith("timestamp"):
        value = F.unix_micros(value.cast("timestamp"))
    shares = [i / chunks for i in range(1, chunks)]
    cuts = sorted(set(df.select(F.percentile_approx(value, shares, 100 * chunks)).first()[0] or []))

    def number(low, high):
        """Cuts at or below the value, by halving."""
        if low == high:
            return F.lit(low).cast("bigint")
        middle = (low + high) // 2
        return F.when(value < cuts[middle], number(low, middle)).otherwise(number(middle + 1, high))

    return number(0, len(cuts))


def number_chunk(number: str, size: int) -> Column:
    return F.floor(F.col(number) / size).cast("bigint")


@dataclass
class Running:
    """``kind`` is sum, min, max or last (the last value that is not NULL).

    ``before`` leaves the current row out: the value up to the row in front.
    """

    kind: str
    value: Column
    before: bool = False

    def over(self, column: Column, window) -> Column:
        if self.kind == "last":
            return F.last(column, ignorenulls=True).over(window)
        return getattr(F, self.kind)(column).over(window)

    def total(self, column: Column, order: Column) -> Column:
        if self.kind == "last":
            return F.max_by(column, F.when(column.isNotNull(), order))
        return getattr(F, self.kind)(column)

    def combine(self, before: Column, inside: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(inside, before)
        if self.kind == "sum":
            return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before + inside)
        return (F.least if self.kind == "min" else F.greatest)(before, inside)


def with_chunk(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Adds the chunk number and shuffles the rows once for all scans that follow."""
    return df.withColumn(CHUNK, chunk).repartition(*keys, CHUNK)


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running],
            chunk: Column | None = None) -> DataFrame:
    """Adds each value accumulated from the first row of its key to the current one.

    ``order`` must order the rows of a key without ties, and ``chunk`` must
    grow with it; without ``chunk`` the column left by ``with_chunk`` is used.
    """
    rows = df if chunk is None else df.withColumn(CHUNK, chunk)
    rows = rows.withColumns({f"_in_{name}": r.value for name, r in values.items()})
    # One plain column compares much faster than a struct.
    sequence = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    totals = rows.groupBy(*keys, CHUNK).agg(
        *[r.total(F.col(f"_in_{name}"), sequence).alias(f"_in_{name}") for name, r in values.items()])
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_key_{c}") for c in [*keys, CHUNK]],
        *[r.over(F.col(f"_in_{name}"), earlier).alias(f"_before_{name}") for name, r in values.items()])
    inside = W.partitionBy(*keys, CHUNK).orderBy(*order)
    scanned = rows.withColumns({
        f"_in_{name}": r.over(F.col(f"_in_{name}"), inside.rowsBetween(W.unboundedPreceding, -1 if r.before else 0))
        for name, r in values.items()})
    # Rows of a first chunk inherit nothing, and most keys have one chunk only: what is joined is small.
    inherits = reduce(or_, [F.col(f"_before_{name}").isNotNull() for name in values])
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in [*keys, CHUNK]]
    joined = scanned.join(carry.where(inherits), same, "left")
    return joined.select(*df.columns, *[
        r.combine(F.col(f"_before_{name}"), F.col(f"_in_{name}")).alias(name) for name, r in values.items()])
