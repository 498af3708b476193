"""Bottom-k sketches of word shingles.

A document's shingles (five words, joined by their hashes) are hashed to 63 bits; its sketch is the ``k`` smallest
different values in ascending order. Sketches of parts merge to the sketch of the whole (``merge``: the ``k`` smallest
of all). Of two sketches the ``k`` smallest values of their union are a random sample of the union of the shingles:
the share found in both estimates the resemblance, and with the distinct counts the containment. Where both sketches
hold all shingles, all results are exact.

Words are ``[^\\x20\\x09-\\x0D]+``. A text with fewer words than a shingle has one shingle of all its words; a text
without words has none and its sketch is empty; two empty sketches are alike (1), an empty and another are not (0).

Nulls: a null text is empty; a null document id comes last in descending order. Rows with equal ids are ordered by
their texts, so rows that repeat follow each other. An empty table gives an empty result; a single document is its
own next one. Other columns of the input are not read.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekeep.llm.base import slices, texts

K, WIDTH, SEED = 128, 5, 7


class Hasher:
    """Hashes all shingles of a list of texts at once, by arrays.

    A word's hash is a polynomial over a random value for each of its bytes, taken from prefix sums; a shingle's hash
    mixes those of its words, each with a multiplier for its place.
    """

    def __init__(self, width: int = WIDTH, seed: int = SEED):
        random = np.random.Generator(np.random.PCG64(seed))
        self.width = width
        self.value = random.integers(1, 1 << 63, 256, np.uint64)
        self.base = int(random.integers(1, 1 << 62)) | 1
        self.places = random.integers(0, 1 << 63, width, np.uint64) | np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _tables(self, n: int):
        if len(self.powers) < n:
            n = 1 << n.bit_length()
            factors = np.full((2, n), [[self.base], [pow(self.base, -1, 1 << 64)]], np.uint64)
            factors[:, 0] = 1
            self.powers, self.inverse = np.cumprod(factors, axis=1, dtype=np.uint64)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def shingles(self, texts: list[str]) -> list[np.ndarray]:
        """Hashes (unsigned, below 2**63) of each text's shingles, repeats included."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self._tables(len(data))
        space = self.space[data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            change = np.concatenate(([0], change))
        start, end = change[0::2], change[1::2]  # the last byte is a space, so all words end
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.powers[:len(data)], dtype=np.uint64)))
        word = self._mix((sums[end] - sums[start]) * self.inverse[start])
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
        count = np.bincount(owner, minlength=len(raw))
        first = np.cumsum(count) - count
        place = np.arange(len(word)) - first[owner]
        left = count[owner] - place  # words from here to the end of the text
        total = np.zeros(len(word), np.uint64)
        for j in range(self.width):
            n = len(word) - j
            if n > 0:
                total[:n] += np.where(left[:n] > j, word[j:] * self.places[j], np.uint64(0))
        keep = (left >= self.width) | (place == 0)
        hashes = self._mix(total[keep]) >> np.uint64(1)
        per = np.bincount(owner[keep], minlength=len(raw))
        return np.split(hashes, np.cumsum(per)[:-1]) if len(raw) else []


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest different values, ascending."""
    if len(hashes) > 16 * k:
        low = np.unique(np.partition(hashes, 4 * k)[:4 * k])
        if len(low) > k:
            return low[:k]
    return np.unique(hashes)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)
    if len(a) < k and len(b) < k:  # both hold all shingles
        return len(both) / len(union)
    edge = union[min(k, len(union)) - 1]
    return int(np.searchsorted(both, edge, side="right")) / min(k, len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / float(1 << 63))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of ``a`` that ``b`` has too."""
    if not len(a):
        return 1.0
    alike, n, m = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, alike * (n + m) / (1 + alike) / n)


def text_of(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def sketches(docs: DataFrame, k: int = K, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, sketch array<long>`` for every row."""
    source = texts(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher = Hasher(width)
        for batch in slices(batches):
            found = [smallest(h, k) for h in hasher.shingles(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))],
                                             names=["doc_id", "sketch"])

    return source.mapInArrow(run, f"doc_id {kind}, sketch array<long>")


def merge(parts: DataFrame, by, k: int = K) -> DataFrame:
    """Sketches of parts to the sketch of each group of ``by``; ranks are cut before the shuffle, so large groups are fine."""
    by = [by] if isinstance(by, str) else list(by)
    values = parts.select(*by, F.explode_outer("sketch").alias("_v")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_last()))
    least = values.withColumn("_r", rank).where(F.col("_r") <= k)
    return least.groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("sketch"))


def distinct_count(sketch: Column, k: int = K) -> Column:
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")) \
        .otherwise((k - 1) / (F.element_at(sketch, k) / F.lit(float(1 << 63))))


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame, k: int = K, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its edited text and its next one in descending order of ids (after the last: the first).

    Texts are shuffled once, into ranges of ids. The bounds come from quantiles of the ids, as many as there are
    shuffle partitions; the first document of each range is sent to the range before it as well.
    """
    source = texts(docs, key, text)
    spark, kind = source.sparkSession, source.schema["doc_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = source.select(F.col("doc_id").cast("double").alias("x"))
    bounds = ids.stat.approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n)
    bucketizer = Bucketizer(splits=[-np.inf, *sorted(set(bounds) or {0.0}), np.inf], inputCol="_x", outputCol="_range")
    ranged = bucketizer.transform(source.withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(-np.inf))))
    ranged = ranged.withColumn("_range", F.col("_range").cast("int")).drop("_x")
    heads = ranged.groupBy("_range").agg(F.max("doc_id").alias("_head")).orderBy(F.desc("_range")).collect()  # a row for each range
    if not heads:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double")
    before = {h["_range"]: heads[i - 1]["_range"] for i, h in enumerate(heads)}  # the first range's head closes the last
    table = F.broadcast(spark.createDataFrame([(h["_range"], h["_head"], before[h["_range"]]) for h in heads],
                                              f"_range int, _head {kind}, _before int"))
    here = F.struct(F.col("_range").alias("at"), F.lit(False).alias("extra"))
    also = F.struct(F.col("_before").alias("at"), F.lit(True).alias("extra"))
    seats = F.when(F.col("doc_id").eqNullSafe(F.col("_head")), F.array(here, also)).otherwise(F.array(here))
    dealt = ranged.join(table, "_range").select("doc_id", "text", F.inline(seats))
    dealt = dealt.repartition(n, "at").sortWithinPartitions("at", "extra", F.desc_nulls_last("doc_id"), "text")

    def run(batches):
        hasher, held = Hasher(width), []
        for batch in slices(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at", "extra"))))
            found = [smallest(h, k) for h in hasher.shingles([r[1] for r in rows])]
            line = [*held, *zip(rows, found)]
            pairs = [(a, b) for a, b in zip(line, line[1:]) if a[0][2] == b[0][2] and not a[0][3]]
            held = line[-1:]
            changed = [edited(a[0][1], b[0][1]) for a, b in pairs]
            own = [smallest(h, k) for h in hasher.shingles(changed)]
            yield pa.RecordBatch.from_arrays([
                pa.array([a[0][0] for a, _ in pairs], batch.column("doc_id").type),
                pa.array([len(a[0][1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([text_of(a[1]) for a, _ in pairs], pa.string()), pa.array([text_of(s) for s in own], pa.string()),
                pa.array([resemblance(a[1], s, k) for (a, _), s in zip(pairs, own)], pa.float64()),
                pa.array([resemblance(a[1], b[1], k) for a, b in pairs], pa.float64()),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
