"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length ``l`` belongs to the class ``k = capacity // l``: lengths in ``(capacity/(k+1), capacity/k]``,
of which any ``k`` fit one sequence. A sequence of class ``k`` gets exactly ``k`` pieces, so no piece waits for the
lengths of others: workers number their pieces of a class on their own, a small table of counts tells each worker
where its numbers begin, and ``number // k`` is the sequence.

Documents are cut so that classes leave little room: whole sequences first, then the rest is taken as it is if ``k``
pieces of its length leave at most ``tolerance`` tokens of a sequence free; else a piece of ``capacity // (k+1)``
tokens is cut off and the remainder goes on the same way. What does not fill a last sequence of its class is fewer
than ``k`` pieces for each class (some 20,000 pieces at most, whatever the input); these go together by best fit.

Nulls: a null text is empty (its only id is the end id); a null document id is kept as it is. Rows that repeat are
packed each for itself. Empty tables give no pieces. Other columns of the input are not read.
"""

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidekeep.llm.base import encoder, slices, texts
from tidekeep.session import materialize

CAPACITY, TOLERANCE = 4096, 64


def cut_lengths(n: int, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    pieces, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        slots = capacity // rest
        length = rest if capacity - slots * rest <= tolerance else capacity // (slots + 1)
        pieces.append(length)
        rest -= length
    return pieces


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, tolerance: int = TOLERANCE,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids (with ``end_id``), cut: ``doc_id, start, length, doc_tokens, ids``.

    ``ids`` holds little-endian unsigned 32-bit ids.
    """
    source = texts(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known: dict[int, list[int]] = {}
        for batch in slices(batches):
            ids, bounds = encoder(path).encode(batch.column("text").to_pylist(), end_id)
            sizes = np.diff(bounds)
            cuts = [known.setdefault(n, cut_lengths(n, capacity, tolerance)) for n in sizes.tolist()]
            counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
            lengths = np.fromiter((x for cut in cuts for x in cut), np.int64)
            row = np.repeat(np.arange(len(cuts)), counts)
            ends = np.cumsum(lengths)
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), pa.array(ends - lengths - bounds[row]), pa.array(lengths),
                pa.array(sizes[row]),
                pa.array([view[4 * (b - n):4 * b] for b, n in zip(ends.tolist(), lengths.tolist())], pa.binary()),
            ], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def _best_fit(capacity: int):
    """Places the few left pieces, long ones first, each where it leaves least room."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "piece"], ascending=[False, True], kind="stable")
        free: list[tuple[int, int]] = []  # (room, sequence), sorted
        target, made = [], 0
        for length in rows["length"].tolist():
            at = bisect.bisect_left(free, (length, -1))
            if at < len(free):
                room, bin_ = free.pop(at)
            else:
                room, bin_, made = capacity, made, made + 1
            bisect.insort(free, (room - length, bin_))
            target.append(bin_)
        return pd.DataFrame({"piece": rows["piece"], "bin": target})
    return run


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``slots`` (the class), ``sequence_id`` and ``offset`` to pieces; carries their other columns along.

    ``sequence_id`` is dense from 0; offsets in a sequence have no gaps. Every column but ``slots``, ``sequence_id``
    and ``offset`` may be present.
    """
    spark = cut.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = cut.withColumn("slots", (F.lit(capacity) / F.col("length")).cast("int")) \
        .withColumn("piece", F.monotonically_increasing_id())
    numbered = materialize(numbered, "pieces")  # the numbers must not change when a task runs again
    share = numbered.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(parts)).cast("int"))
    counts = share.groupBy("slots", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("slots").orderBy("part")
    counts = counts.select("slots", "part", (F.sum("n").over(before) - F.col("n")).alias("_base"),
                           F.sum("n").over(Window.partitionBy("slots")).alias("_total"))
    # One row for each class, some 130: lengths within the tolerance of capacity / k, and the shortest.
    classes = counts.select("slots", (F.col("_total") / F.col("slots")).cast("long").alias("_full")).distinct()
    order = Window.orderBy("slots")
    classes = classes.select("slots", "_full", (F.sum("_full").over(order) - F.col("_full")).alias("_first"),
                             F.sum("_full").over(Window.orderBy("slots").rowsBetween(
                                 Window.unboundedPreceding, Window.unboundedFollowing)).alias("_bins"))
    classes = materialize(classes, "classes")
    rank = F.row_number().over(Window.partitionBy("slots", "part").orderBy("piece")) - 1
    ranked = share.select("piece", "slots", "length", "part", rank.alias("_rank")) \
        .join(counts, ["slots", "part"]).join(F.broadcast(classes), "slots") \
        .withColumn("_bin", ((F.col("_base") + F.col("_rank")) / F.col("slots")).cast("long"))
    ranked = materialize(ranked.select("piece", "length", "_bin", "_full", "_first", "_bins"), "ranked")
    full = ranked.where("_bin < _full").select("piece", "length", (F.col("_first") + F.col("_bin")).alias("sequence_id"))
    left = ranked.where("_bin >= _full")
    fitted = left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_best_fit(capacity), "piece long, bin long")
    rest = left.select("piece", "length", "_bins").join(fitted, "piece") \
        .select("piece", "length", (F.col("_bins") + F.col("bin")).alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "piece")
    seats = full.unionByName(rest) \
        .select("piece", "sequence_id", (F.sum("length").over(inside) - F.col("length")).alias("offset"))
    return numbered.join(seats, "piece").drop("piece")
