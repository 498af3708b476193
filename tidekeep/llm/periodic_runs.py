"""Periodic runs of words, by longest common extensions (LCE) in suffix trees.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(min_length, min_power * q)``
words that no neighbouring word extends. For each document:

1. Words that stand fewer than ``min_power`` times in a stretch can be in no run there, as a run holds each of its words
   that often. They cut the document into stretches; these are cut again until nothing changes, and every cut becomes
   one symbol of its own. No run is lost, and most documents end here.
2. Ukkonen's algorithm builds the suffix trees of what is left and of its reversal. An Euler tour of each tree with
   tables of minima gives the LCE of two places (the depth of their leaves' lowest common ancestor) in constant time.
3. Lyndon roots: for an order of the symbols and for its reverse, the longest Lyndon word that begins at a place ends
   before the next smaller suffix. Every run holds such a root of its period, for one of both orders. Each candidate is
   extended by LCE to the right and, in the reversal, to the left; equal runs are counted once.

The work is ``O(n log n)`` in time and ``O(n)`` in memory for ``n`` words, however many runs there are, whatever their periods.

Nulls: a null text has no words, no runs and an empty collapsed text; a null document id is kept. Rows that repeat are
handled each for itself; an empty table gives an empty result. Other columns of the input are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.base import WORD, slices, spans, texts

MIN_LENGTH, MIN_POWER = 6, 4
BLOCK_BITS = 5
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


# ---- suffix trees ----

class SuffixTree:
    """Ukkonen's tree of a list of numbers from 0, and the order and depth of its nodes.

    A last symbol, smaller than all others, is added, so every suffix ends in a leaf.
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, -1]
        n = len(text)
        self.n = n
        # Node 0 is the root. An edge leads to a node and is text[start:end] of that node; leaves end with the text.
        start, end, link, below = [0], [0], [0], [{}]
        node, edge, length, pending = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            pending += 1
            inner = 0  # the node that still needs its suffix link
            while pending:
                if not length:
                    edge = i
                child = below[node].get(text[edge])
                if child is None:
                    below[node][text[edge]] = len(start)
                    start.append(i), end.append(n), link.append(0), below.append(None)
                    if inner:
                        link[inner] = node
                    inner = 0
                else:
                    span = min(end[child], i + 1) - start[child]
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if text[start[child] + length] == symbol:
                        if inner and node:
                            link[inner] = node
                        length += 1
                        break
                    split = len(start)
                    cut = start[child] + length
                    start += [start[child], i]
                    end += [cut, n]
                    link += [0, 0]
                    below += [{text[cut]: child, symbol: split + 1}, None]
                    below[node][text[edge]] = split
                    start[child] = cut
                    if inner:
                        link[inner] = split
                    inner = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self._tour(start, end, below)

    def _tour(self, start, end, below):
        """Depths along the Euler tour, where each leaf stands in it, and the suffixes in both orders of symbols."""
        n, tour, leaf_at, order, reverse = self.n, [], [0] * self.n, [], []
        # Depth first; a node is noted when it is entered and after each of its children.
        stack = [(iter(sorted(below[0])), below[0], 0)]
        tour.append(0)
        while stack:
            children, named, depth = stack[-1]
            symbol = next(children, None)
            if symbol is None:
                stack.pop()
                if stack:
                    tour.append(stack[-1][2])
                continue
            child = named[symbol]
            deeper = depth + end[child] - start[child]
            if below[child] is None:
                leaf_at[n - deeper] = len(tour)
                order.append(n - deeper)
                tour += (deeper, depth)
            else:
                tour.append(deeper)
                stack.append((iter(sorted(below[child])), below[child], deeper))
        # The other order: symbols turned round, but an end still before all.
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            if below[node] is None:
                reverse.append(n - depth)
                continue
            named = below[node]
            todo += [(c, depth + end[c] - start[c]) for s in sorted(named) if s >= 0 for c in (named[s],)]
            if -1 in named:
                todo.append((named[-1], depth + end[named[-1]] - start[named[-1]]))
        self.leaf_at = np.array(leaf_at)
        self.ranks = []
        for found in (order, reverse):
            rank = np.empty(n, np.int64)
            rank[found] = np.arange(n)
            self.ranks.append(rank)
        self._tables(np.array(tour, np.int32))

    def _tables(self, tour: np.ndarray):
        """Minima of 1, 2, 4 .. 32 neighbours everywhere; longer ones by doubling over blocks of 32."""
        def doubled(level, widths):
            out = [level]
            for width in widths:
                if len(out[-1]) <= width:
                    break
                out.append(np.minimum(out[-1][:-width], out[-1][width:]))
            return out

        self.near = doubled(tour, [1 << k for k in range(BLOCK_BITS)])
        block = 1 << BLOCK_BITS
        whole = tour[:len(tour) // block * block].reshape(-1, block)
        self.far = doubled(whole.min(axis=1), [1 << k for k in range(32)]) if len(whole) else []

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at ``a`` and at ``b`` (different places), for all pairs at once."""
        left, right = self.leaf_at[a], self.leaf_at[b]
        left, right = np.minimum(left, right), np.maximum(left, right)
        size, block = right - left + 1, 1 << BLOCK_BITS
        level = np.minimum(_log2(size), BLOCK_BITS)
        out = np.empty(len(left), np.int64)
        for k in range(len(self.near)):
            at = level == k
            out[at] = np.minimum(self.near[k][left[at]], self.near[k][right[at] - (1 << k) + 1])
        first, last = -(-left // block), (right + 1) // block  # whole blocks between the two ends
        long = np.flatnonzero((size > 2 * block) & (last > first))
        level = _log2(last[long] - first[long])
        for k in range(len(self.far)):
            at = long[level == k]
            out[at] = np.minimum(out[at], np.minimum(self.far[k][first[at]], self.far[k][last[at] - (1 << k)]))
        return out


def _log2(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1] - 1


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next one to its right that is smaller; the text's end for none."""
    ranks = rank.tolist()
    found = [0] * len(ranks)
    for i in range(len(ranks) - 1, -1, -1):
        j, own = i + 1, ranks[i]
        while j < len(ranks) and ranks[j] > own:
            j = found[j]
        found[i] = j
    return np.array(found)


def tree_runs(symbols: list[int], min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> np.ndarray:
    """All runs of a list of numbers as rows ``start, length, period``, by start, then period."""
    n = len(symbols)
    if not n:
        return np.zeros((0, 3), np.int64)
    forward = SuffixTree(symbols)
    begin, period = [], []
    for rank in forward.ranks:
        ends = next_smaller(rank)[:n]
        begin.append(np.arange(n))
        period.append(ends - begin[-1])
    begin, period = np.concatenate(begin), np.concatenate(period)
    again = np.flatnonzero(begin + period < n)
    begin, period = begin[again], period[again]
    ahead = forward.lce(begin, begin + period)
    del forward
    back = np.zeros(len(begin), np.int64)
    inner = np.flatnonzero(begin > 0)
    back[inner] = SuffixTree(symbols[::-1]).lce(n - begin[inner], n - begin[inner] - period[inner])
    start, length = begin - back, back + period + ahead
    kept = length >= np.maximum(np.maximum(min_length, 2 * period), min_power * period)
    found = np.stack((start, length, period), axis=1)[kept]
    return np.unique(found[np.lexsort((found[:, 2], found[:, 0]))], axis=0) if len(found) else found


# ---- documents ----

def stretches(codes: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER):
    """Bounds of the stretches that may hold runs: each word stands ``min_power`` times or more in its own stretch."""
    kept, n = np.ones(len(codes), bool), len(codes)
    while True:
        edge = np.diff(np.concatenate(([0], kept.view(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        wide = last - first >= min_length
        first, last = first[wide], last[wide]
        if not len(first):
            return first, last
        at = spans(first, last - first)
        words = np.repeat(np.arange(len(first)), last - first) * (int(codes.max()) + 1) + codes[at]
        _, place, counts = np.unique(words, return_inverse=True, return_counts=True)
        good = counts[place] >= min_power
        if good.all() and len(at) == int(kept.sum()):
            return first, last
        kept = np.zeros(n, bool)
        kept[at[good]] = True


def runs_of(words: list, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> np.ndarray:
    """Runs of a list of words as rows ``start, length, period``, by start, then period."""
    numbers: dict = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    first, last = stretches(codes, min_length, min_power)
    if not len(first):
        return np.zeros((0, 3), np.int64)
    # Stretches one after the other, a symbol of its own behind each.
    sizes = last - first + 1
    begins = np.cumsum(sizes) - sizes
    symbols = np.empty(int(sizes.sum()), np.int64)
    ends = begins + sizes - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside], symbols[ends] = codes[spans(first, last - first)], len(numbers) + np.arange(len(first))
    found = tree_runs(symbols.tolist(), min_length, min_power)
    found[:, 0] += (first - begins)[np.searchsorted(begins, found[:, 0], side="right") - 1]
    return found


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def find(docs: DataFrame, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed``: runs (``start, length, period`` in words) and the text without their repetitions,
    its words joined by one space."""
    if min_power < 2:
        raise ValueError("a run repeats its period at least twice")
    source = texts(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            found, left = [], []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                words = value.split()  # bytes know the six white spaces of ASCII only
                runs = runs_of(words, min_length, min_power)
                found.append(runs)
                left.append(b" ".join(collapsed(words, runs)))
            rows = np.concatenate(found)
            entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["start", "length", "period"])
            bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.ListArray.from_arrays(bounds, entries),
                pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return source.mapInArrow(run, f"doc_id {kind}, runs {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document by its digest gets a tail that repeats itself.

    With ``h = crc32(doc_id as text)``, ``g = h // 10`` and ``h % 10 = 0``, each of the ``n`` words ``i >= a`` becomes
    word ``a + (i - a) % p``, where ``a = g % n`` and ``p = 1 + (n - a) // (3 + g % 8)``.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    df = texts(docs).withColumn("g", F.floor(h / 10)) \
        .withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))) \
        .withColumn("n", F.size("words")) \
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))) \
        .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.expr("array_join(transform(words, (w, i) -> CASE WHEN i < a THEN w "
                   "ELSE element_at(words, CAST(a + (i - a) % p AS INT) + 1) END), ' ')")
    return df.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period), and digests of runs and of what is left."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    df = found.withColumn("top", longest)
    length, period = F.col("top.length"), -F.col("top.period")
    return df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"),
                     length.alias("length"), period.alias("period"),
                     F.expr("(1000 * top.length) div -top.period").alias("exponent_milli"),
                     F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
