"""SimHash near-duplicates: fingerprints in a grid of bit counts.

A fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two bits. Its Manhattan distance in these
counts never exceeds the number of differing bits, so fingerprints within ``distance`` bits lie within ``distance``
in the counts. The segments are dealt into ``b`` blocks; two points that near agree in all counts of at least
``b - distance`` blocks. A grid cell is a choice of that many blocks with the counts in them: points that can match
share a cell. In a cell the points are compared, and the differing bits of near ones counted.

More blocks make cells smaller and choices more; the number is picked from the number of different fingerprints, and
the links found are the same for any. Rows with equal fingerprints count once. Of a cell only links of a spanning
forest are given out, not all pairs. A cell of more than ``CELL`` fingerprints is not held by one task: it is cut into
parts, and each pair of parts is compared by a task of its own.

Nulls: a null text is empty and has the fingerprint zero, like any text without words; a null document id counts as
greater than any other, and is the component's only if it has no other. Rows that repeat share a component. An empty
table gives an empty result. Other columns of the input are not read.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekeep.llm.base import row_of, slices, texts
from tidekeep.llm.components import components
from tidekeep.session import materialize

WIDTH, SEED, DISTANCE, CELL, SMALL = 4, 42, 4, 8192, 48
_EVEN = 0x5555555555555555


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """Bit ``i`` is one if it is set in over half the XXH64 values of the text's shingles; as signed 64 bit."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z become lower case, only the six white spaces split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, n = np.concatenate(([0], ends[:-1])), max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:] - 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[a:min(n, a + (1 << 16))].tolist(), last[a:a + (1 << 16)].tolist())], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, content, fp`` for every row; ``content`` is a hash of the text, ``fp`` a signed 64-bit fingerprint."""
    source = texts(docs, key, text).withColumn("content", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("content"),
                pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())], names=["doc_id", "content", "fp"])

    return source.select("doc_id", "content", "text").mapInArrow(run, f"doc_id {kind}, content long, fp long")


def embedding(fp: Column) -> Column:
    """The 32 bit counts (0 to 2) of the segments, two bits for each, side by side in a long."""
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """Fewest blocks for which a cell has some 32 unrelated fingerprints; two segments agree with probability 3/8."""
    for blocks in range(distance + 2, 17):
        if n * (3 / 8) ** (32 * (blocks - distance) / blocks) <= 32:
            break
    return blocks


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Signed masks over the embedding, one for each choice of ``blocks - distance`` blocks."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    found = [sum(choice) for choice in itertools.combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _counts(x: np.ndarray) -> np.ndarray:
    even = np.uint64(_EVEN)
    return (x & even) + ((x >> np.uint64(1)) & even)


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of the bit counts of two arrays of fingerprints."""
    a, b = _counts(x), _counts(y)
    total = np.zeros(len(a), np.uint8)
    for s in range(0, 64, 2):
        p, q = (a >> np.uint64(s)) & np.uint64(3), (b >> np.uint64(s)) & np.uint64(3)
        total += np.where(p > q, p - q, q - p).astype(np.uint8)
    return total


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Verifies pairs: bits that differ."""
    return np.bitwise_count(x ^ y) <= distance


def forest(points: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the points (unsigned 64 bit) that are within ``distance`` bits."""
    a, b = [], []
    rest = np.unique(points)
    while len(rest):
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            here = todo.pop()
            near = _near(rest, here, distance)
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(found)
                b.append(np.full(len(found), here))
                todo.extend(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _cells(distance: int, cell: int):
    """Links of sorted rows ``(k, cell, fp)``; rows of a cell that is too large are given back (``k`` not -1)."""
    def settle(k, c, fp):
        points = fp.view(np.uint64)
        edge = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        group = np.cumsum(edge) - 1
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(fp)))
        a, b = [], []
        for d in range(1, min(SMALL, int(size.max()))):  # small cells, all at once: neighbours at distance d
            at = np.flatnonzero((group[d:] == group[:-d]) & (size[group[d:]] <= SMALL))
            if not len(at):
                break
            x, y = points[at], points[at + d]
            at = at[np.bitwise_count(_counts(x) ^ _counts(y)) <= 2 * distance]  # cheap part of the bound
            at = at[_manhattan(points[at], points[at + d]) <= distance]
            at = at[_near(points[at], points[at + d], distance)]
            a.append(points[at + d])
            b.append(points[at])
        for g in np.flatnonzero(size > SMALL).tolist():
            x, y = forest(points[first[g]:first[g] + size[g]], distance)
            a.append(x)
            b.append(y)
        none = np.zeros(0, np.uint64)
        x, y = (np.concatenate(v or [none]).view(np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), -1, np.int32)), pa.array(np.zeros(len(x), np.int64)),
                                           pa.array(x), pa.array(y)], names=["k", "cell", "a", "b"])

    def back(k, c, fp):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(fp), pa.array(np.zeros(len(fp), np.int64))],
                                          names=["k", "cell", "a", "b"])

    def run(batches):
        held, large = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64)], None
        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("k", "cell", "fp")]
            if large is not None:  # the cell that was too large may go on
                more = int(np.argmax(np.append((new[0] != large[0]) | (new[1] != large[1]), True)))
                if more:
                    yield back(*(x[:more] for x in new))
                if more == len(new[0]):
                    continue
                new, large = [x[more:] for x in new], None
            held = [np.concatenate(p) for p in zip(held, new)]
            open_ = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1:].sum() + 1) \
                if ((held[0] != held[0][-1]) | (held[1] != held[1][-1])).any() else 0
            if open_ > 1 << 17:
                yield settle(*(x[:open_] for x in held))
                held, open_ = [x[open_:] for x in held], 0
            if len(held[0]) - open_ > cell:
                if open_:
                    yield settle(*(x[:open_] for x in held))
                large = held[0][-1], held[1][-1]
                yield back(*(x[open_:] for x in held))
                held = [x[:0] for x in held]
        if len(held[0]):
            yield settle(*held)
    return run


def links(points: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """``(a, b)``: links that span the components of the different fingerprints ``points(fp)``."""
    chosen = masks(blocks_for(points.count(), distance), distance)
    point = embedding(F.col("fp"))
    keyed = points.select("fp", point.alias("_e")) \
        .select("fp", F.posexplode(F.array(*[F.col("_e").bitwiseAND(F.lit(m)) for m in chosen])).alias("k", "cell"))
    found = keyed.select("k", "cell", "fp").repartition("k", "cell").sortWithinPartitions("k", "cell", "fp") \
        .mapInArrow(_cells(distance, cell), "k int, cell long, a long, b long")
    found = materialize(found, "cells")
    small, large = found.where("k = -1").select("a", "b"), found.where("k >= 0").select("k", "cell", F.col("a").alias("fp"))
    if large.isEmpty():
        return small
    parts = large.groupBy("k", "cell").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = large.join(parts, ["k", "cell"]).withColumn("mine", mine) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("k", "cell", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def tile(rows):
        x, y = forest(rows["fp"].to_numpy().view(np.uint64), distance)
        import pandas as pd

        return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return small.union(tiles.groupBy("k", "cell", "i", "j").applyInPandas(tile, "a long, b long"))


def groups(prints: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """``fp, root, first``: component of every different fingerprint and its first row ``(missing, doc_id, content)``."""
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "content")
    points = materialize(prints.groupBy("fp").agg(F.min(place).alias("first")), "points")
    roots = components(links(points.select("fp"), distance, cell))
    rooted = materialize(points.join(roots, points["fp"] == roots["node"], "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root") \
        .select("fp", "root", F.col("least").alias("first"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    return prints.join(groups(prints, distance).select("fp", F.col("first.doc_id").alias("component_id")), "fp") \
        .select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component: smallest id, then smallest text hash, and one of
    rows that repeat."""
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    return rows_of_firsts(docs, groups(prints, distance).select("first"), key, text)


def rows_of_firsts(docs: DataFrame, firsts: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` with the id and text hash of a ``first(doc_id, content)``, one of rows that repeat."""
    firsts = firsts.select("first.doc_id", "first.content").distinct() \
        .select(F.col("doc_id").alias("_first_id"), F.col("content").alias("_first_content"))
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(row_of(docs).alias("row"), F.col(key).alias("_key"), F.xxhash64(plain).alias("_hash"))
    kept = rows.join(firsts, F.col("_key").eqNullSafe(F.col("_first_id")) & (F.col("_hash") == F.col("_first_content")))
    once = F.row_number().over(Window.partitionBy("_first_id", "_first_content").orderBy(F.xxhash64("row")))
    return kept.withColumn("_nth", once).where("_nth = 1").select("row.*")
