"""Near copies by the resemblance of shingle sets: candidates by bands of minima, every link checked exactly.

Two texts are linked if their sets of shingles (five words, ASCII letters as lower case) have a Jaccard similarity of
``SHARE`` (in fifths) or more. Equal sets are one node. A set gives ``BANDS`` cells, each the hash of its minima under
``ROWS`` permutations; texts with similarity s share a cell with probability ``1 - (1 - s**ROWS)**BANDS``, which is
over 0.99999 at 0.8. Sets that share a cell with another are built again from their texts, only these, and compared:
in cells of at most ``SMALL`` sets all pairs whose sizes allow it, each pair once for all cells; a larger cell is cut
into parts of about ``PART`` shingles, and each pair of parts is searched by a task that gives out only the links of
a spanning forest. Links are never taken from a sample or from one member of a cell.

Nulls: a null text is empty, and texts without words are copies of each other; a null document id counts as greater
than any other. A text with fewer words than a shingle has one shingle of all its words. Rows that repeat are copies.
An empty table gives an empty result. Shingles and sets are compared by 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.base import slices, texts
from tidekeep.llm.bottomk import Hasher
from tidekeep.llm.components import components
from tidekeep.llm.simhash_grid import rows_of_firsts
from tidekeep.session import materialize

WIDTH, SHARE, ROWS, BANDS, SMALL, PART, SEED = 5, 4, 4, 24, 8, 1 << 20, 11


def shingle_sets(texts: list[str], hasher: Hasher) -> list[np.ndarray]:
    """Different shingle hashes of each text, ascending; none for a text without words."""
    return [np.unique(h) for h in hasher.shingles([t.encode().lower().decode() for t in texts])]


def cells(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    """A row of cells (signed 64 bit) for each set, none of which may be empty."""
    factors = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        cell = np.full(len(sets), band, np.uint64)
        for factor in factors[band]:
            cell = Hasher._mix(cell ^ np.minimum.reduceat(values * factor, starts))
        out[:, band] = cell
    return out.view(np.int64)


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, content, node, size, cells`` for every row; ``node`` is a hash of the set of ``size`` shingles."""
    source = texts(docs, key, text).withColumn("content", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        hasher = Hasher(WIDTH)
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), hasher)
            full = [s for s in sets if len(s)]
            found = iter(cells(full)) if full else iter(())
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("content"), pa.array(node), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([next(found) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "content", "node", "size", "cells"])

    return source.select("doc_id", "content", "text").mapInArrow(
        run, f"doc_id {kind}, content long, node long, size int, cells array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``node, shingles`` of the nodes ``wanted(node, first)``, from the text of their first row."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), plain.alias("text"), F.xxhash64(plain).alias("_hash"))
    found = rows.join(wanted, F.col("_key").eqNullSafe(F.col("first.doc_id")) & (F.col("_hash") == F.col("first.content")))

    def run(batches):
        hasher = Hasher(WIDTH)
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), hasher)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                             names=["node", "shingles"])

    return found.select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def alike(common, a, b):
    """Whether sets of sizes ``a`` and ``b`` with ``common`` members in both are near copies; also for columns."""
    return 5 * common >= SHARE * (a + b - common)


def forest(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the near copies among different nodes."""
    a, b = [], []
    sizes = np.array([len(s) for s in sets], np.int64)
    rest = np.arange(len(nodes))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            here = todo.pop()
            held = rest[(5 * sizes[rest] >= SHARE * sizes[here]) & (5 * sizes[here] >= SHARE * sizes[rest])]
            if not len(held):
                continue
            both = np.isin(np.concatenate([sets[i] for i in held]), sets[here])
            common = np.add.reduceat(both, np.cumsum(sizes[held]) - sizes[held], dtype=np.int64)
            found = held[alike(common, sizes[held], sizes[here])]
            a.append(nodes[found])
            b.append(np.full(len(found), nodes[here]))
            todo.extend(found.tolist())
            rest = np.setdiff1d(rest, found, assume_unique=True)
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def links(docs: DataFrame, points: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL,
          part: int = PART) -> DataFrame:
    """``(a, b)``: links that span the components of the nodes ``points(node, size, cells, first)``."""
    keyed = points.select("node", "size", F.explode("cells").alias("cell"))
    counts = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    shared = materialize(keyed.join(counts, "cell"), "shared")
    wanted = points.select("node", "first").join(shared.select("node").distinct(), "node", "left_semi")
    sets = materialize(_sets(docs, wanted, key, text), "sets")
    few = shared.where(F.col("n") <= small)
    left, right = (few.select("cell", F.col("node").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
    pairs = left.join(right, "cell").where("a < b").select("a", "b", "size_a", "size_b").distinct() \
        .where(alike(F.least("size_a", "size_b"), F.col("size_a"), F.col("size_b")))
    members = {x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"}
    both = pairs.join(members["a"], "a").join(members["b"], "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    exact = both.where(alike(common, F.col("size_a"), F.col("size_b"))).select("a", "b")
    many = shared.where(F.col("n") > small)
    if many.isEmpty():
        return exact
    many = many.withColumn("parts", F.ceil(F.col("total") / part).cast("int"))
    tiles = many.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("cell", "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def tile(rows):
        import pandas as pd

        x, y = forest(rows["node"].to_numpy(), list(rows["shingles"]))
        return pd.DataFrame({"a": x, "b": y})

    large = tiles.join(sets, "node").groupBy("cell", "i", "j").applyInPandas(tile, "a long, b long")
    return exact.union(large)


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL, part: int = PART) -> DataFrame:
    """The rows of ``docs`` that are the first of their group: smallest id, then smallest text hash, and one of rows
    that repeat."""
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "content")
    points = materialize(materialize(prints(docs, key, text), "prints").groupBy("node").agg(
        F.min(place).alias("first"), F.first("size").alias("size"), F.first("cells").alias("cells")), "points")
    roots = components(links(docs, points, key, text, small, part))
    rooted = points.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    return rows_of_firsts(docs, rooted.groupBy("root").agg(F.min("first").alias("first")), key, text)
