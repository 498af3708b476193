"""Whitening of embeddings by the leading components of their covariance, which FEAST contour integration finds.

Vectors are made whole numbers first: an entry ``c`` becomes ``x = floor(scale * c) + shift``, so sums are exact. Tasks
add up what they hold (sums, then products of centred entries), and Spark adds the tasks' parts; only tables of the
size of the dimensions reach the driver, never vectors.

Components, largest eigenvalue first:

1. Inertia counts. A symmetric factorisation with pivots of one or two rows gives the number of eigenvalues over any
   shift (Sylvester). Bisection by these counts finds where the wanted eigenvalues end and cuts their range into
   intervals of at most ``INTERVAL`` eigenvalues (equal eigenvalues stay together).
2. FEAST. For each interval, a task of its own: solves with complex shifts on a half circle, added with Gauss-Legendre
   weights, project a random block onto the eigenvectors inside; Rayleigh-Ritz gives values and vectors; the block goes
   round until residuals are at rounding level.
3. Check. An interval must give as many vectors as the inertia counts say, else its block is doubled, up to all dimensions.
   A last Rayleigh-Ritz step over all intervals' vectors makes those next to borders orthogonal too.

Defined results: rows with a null vector, a null or non-finite entry, or another length than most rows have (ties:
the longer) are left out; entries beyond ``2**40 / scale`` count as that; a null id is kept; rows that repeat count
each. Eigenvalues below ``1e-12`` of the trace are zero and give no component, so one vector or equal vectors give no
rows, as an empty table does. ``deviation`` is null where it does not fit 64 bits. Other columns of the input are not read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.session import materialize

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
INTERVAL, POINTS, ROUNDS = 8, 8, 40
ZERO = 1e-12


# ---- vectors in tasks ----

def whole_numbers(column: pa.Array, dims: int, scale: int = SCALE, shift: int = SHIFT) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable vectors of ``dims`` entries, and their entries as whole numbers."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
    finite = np.isfinite(flat).all(axis=1)
    bound = float(1 << 40)
    return at[finite], np.clip(np.floor(scale * flat[finite]), -bound, bound).astype(np.int64) + shift


def _source(vectors: DataFrame, key: str, column: str) -> DataFrame:
    return vectors.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))


def _totals(source: DataFrame):
    """Dimensions, number of usable vectors and exact sums of their entries."""
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            column = batch.column("vector")
            for dims in pc.unique(pc.list_value_length(column).drop_null()).to_pylist():
                rows, x = whole_numbers(column, dims)
                if dims and len(rows):
                    entry = found.setdefault(dims, [0, np.zeros(dims, np.int64)])
                    entry[0] += len(rows)
                    entry[1] += x.sum(axis=0)
        for dims, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([n], pa.int64()),
                                              pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["dims", "n", "sums"])

    parts = materialize(source.select("vector").mapInArrow(run, "dims int, n long, sums array<long>"), "vector-sums")
    top = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        return 0, 0, np.zeros(0, np.int64)
    sums = parts.where(F.col("dims") == top.dims).select(F.posexplode("sums").alias("at", "x")) \
        .groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()  # a row for each dimension
    return top.dims, top.n, np.array([r.x for r in sums])


def _products(source: DataFrame, dims: int, n: int, sums: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Covariance of the centred vectors times ``matrix``; parts are added in the order of tasks."""
    width = matrix.shape[1]

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            _, x = whole_numbers(batch.column("vector"), dims)
            y = centred(x, n, sums) @ matrix
            total += y.T @ y
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task] * width, pa.int32()), pa.array(range(width), pa.int32()),
                                          pa.array(total.tolist(), pa.list_(pa.float64()))], names=["task", "i", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.array(table.sort_by("task")["part"].to_pylist()).sum(axis=0)
        return pa.table({"i": table["i"].slice(0, 1), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    rows = source.select("vector").mapInArrow(run, "task int, i int, part array<double>") \
        .groupBy("i").applyInArrow(add, "i int, total array<double>").collect()  # a row for each dimension
    found = np.array([r.total for r in sorted(rows, key=lambda r: r.i)]).reshape(width, width) / n
    return (found + found.T) / 2


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


# ---- components ----

def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than ``shift``."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        diagonal, off = np.abs(np.diag(a)), np.abs(a - np.diag(np.diag(a)))
        i = int(diagonal.argmax())
        j, k = np.unravel_index(off.argmax(), off.shape)
        if not max(diagonal[i], off[j, k]):
            break
        # One row if its diagonal entry is large enough, else two rows with one eigenvalue of each sign.
        first = [i] if diagonal[i] >= 0.6404 * off[j, k] else [int(j), int(k)]
        positive += int(a[i, i] > 0) if len(first) == 1 else 1
        rest = np.delete(np.arange(len(a)), first)
        side = a[np.ix_(rest, first)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(first, first)], side.T)
    return positive


def _middle(a: float, b: float) -> float:
    return (a * b) ** 0.5 if a > 0 and a < 0.01 * b else (a + b) / 2


def _below(matrix: np.ndarray, number: int, high: float, steps: int = 45) -> float:
    """A shift just under the eigenvalue of this number, counted from the largest; ``ZERO`` at least."""
    low = ZERO
    for _ in range(steps):
        middle = _middle(low, high)
        low, high = (middle, high) if inertia(matrix, middle) >= number else (low, middle)
        if high - low < 1e-9 * low:
            break
    return low


def intervals(matrix: np.ndarray, wanted: int, most: int = INTERVAL) -> list[tuple[float, float, int]]:
    """``(low, high, eigenvalues inside)`` that hold the ``wanted`` largest eigenvalues over zero, and perhaps more
    where eigenvalues are equal. The trace of ``matrix`` is 1."""
    high = float(np.abs(matrix).sum(axis=1).max()) * 1.01 + 1e-9
    known = inertia(matrix, ZERO)
    wanted = min(wanted, known)
    if not wanted:
        return []
    # The border lies between the last wanted eigenvalue and the next one, under both if they are equal.
    last, following = _below(matrix, wanted, high), _below(matrix, wanted + 1, high) if known > wanted else 0.0
    low = (last + following) / 2 if following < last * (1 - 1e-6) else following * (1 - 1e-6)
    todo, found = [(low, high, inertia(matrix, low), 0)], []
    while todo:
        a, b, over_a, over_b = todo.pop()
        if over_a - over_b <= most or b - a <= 1e-13 * high:
            if over_a > over_b:
                found.append((a, b, over_a - over_b))
            continue
        middle = _middle(a, b)
        over = inertia(matrix, middle)
        todo += [(a, middle, over_a, over), (middle, b, over, over_b)]
    return found


def feast(matrix: np.ndarray, low: float, high: float, count: int, points: int = POINTS, rounds: int = ROUNDS):
    """The ``count`` eigenvalues in an interval and their vectors (columns)."""
    d, centre, radius = len(matrix), (low + high) / 2, (high - low) / 2
    x, weights = np.polynomial.legendre.leggauss(points)
    around = np.exp(1j * np.pi / 2 * (x + 1))
    block = min(d, count + max(4, count // 2))
    while True:
        y = np.random.default_rng(block).standard_normal((d, block))
        best = np.inf
        for _ in range(rounds):
            q = sum((w / 2 * radius * e * np.linalg.solve((centre + radius * e) * np.eye(d) - matrix, y)).real
                    for e, w in zip(around, weights))
            q, _ = np.linalg.qr(q)
            values, turn = np.linalg.eigh(q.T @ matrix @ q)
            y = q @ turn
            residuals = np.linalg.norm(matrix @ y - y * values, axis=0)
            order = np.argsort(np.where((values > low) & (values <= high), 0, np.maximum(low - values, values - high)), kind="stable")
            worst = residuals[order[:count]].max()
            if worst < 1e-15 or worst > best / 2 and best < 2e-15:
                break
            best = min(best, worst)
        inside = (values > low) & (values <= high) & (residuals < 1e-9 * max(high, 1e-3))
        if int(inside.sum()) == count or block == d:
            chosen = inside if int(inside.sum()) == count else np.isin(np.arange(len(values)), order[:count])
            return values[chosen], y[:, chosen]
        block = min(d, 2 * block)


def components(spark, covariance: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their vectors as columns; intervals are solved by tasks."""
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    matrix = covariance / trace
    found = intervals(matrix, wanted)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, vectors = feast(matrix, row["low"], row["high"], row["inside"])
                yield pa.RecordBatch.from_arrays([pa.array([row["low"]] * vectors.shape[1]),
                                                  pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["low", "vector"])

    rows = spark.createDataFrame(found, "low double, high double, inside long").repartition(max(1, len(found)), "low") \
        .mapInArrow(run, "low double, vector array<double>").collect()  # the wanted vectors
    rows.sort(key=lambda r: (r.low, r.vector))
    q, _ = np.linalg.qr(np.array([r.vector for r in rows]).T)
    values, turn = np.linalg.eigh(q.T @ matrix @ q)
    vectors = q @ turn
    if len(values) != sum(count for _, _, count in found) or np.abs(matrix @ vectors - vectors * values).max() > 1e-10:
        raise ArithmeticError("components do not agree with the inertia counts")
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * trace, vectors[:, order]


# ---- whitening ----

def whiten(vectors: DataFrame, wanted: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``; ``whitened`` and ``explained`` have an entry for
    each component, largest eigenvalue first."""
    spark, source = vectors.sparkSession, _source(vectors, key, column)
    kind = source.schema["vec_id"].dataType.simpleString()
    dims, n, sums = _totals(source)
    values, loads = np.zeros(0), np.zeros((dims, 0))
    if n:
        covariance = _products(source, dims, n, sums, np.eye(dims))
        values, loads = components(spark, covariance, wanted)
    schema = f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if not len(values):
        return spark.createDataFrame([], schema)
    explained, scaled = (values / np.trace(covariance)).tolist(), loads / np.sqrt(values)
    error = float(np.abs(_products(source, dims, n, sums, scaled) - np.eye(len(values))).max())

    def run(batches):
        for batch in batches:
            at, x = whole_numbers(batch.column("vector"), dims)
            far = n * x - sums
            fits = (far.astype(np.float64) ** 2).sum(axis=1) < 9.2e18
            squares = np.where(fits[:, None], far, 0)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(at)), pa.array([n] * len(at), pa.int64()),
                pa.array((squares * squares).sum(axis=1), mask=~fits), pa.array((far / n @ scaled).tolist(), pa.list_(pa.float64())),
                pa.array([explained] * len(at), pa.list_(pa.float64())), pa.array([error] * len(at), pa.float64()),
            ], names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(run, schema)


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    return whitened.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened")) \
        .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
