"""Encoding of long unsplit texts by a tree of concatenations, and decoding.

A normalised text is halved until its parts are short. The parts are encoded each for itself; then neighbours are put
together: a window of text around the join is encoded, and widened until its ids agree on both sides with the ids of
the two parts. What lies between the two places of agreement is taken from the window, the rest from the parts.

Why agreement in one token is enough. Positions are counted in bytes without white space, which the tokens cover
exactly. A sequence of tokens of one word (a match of the splitting pattern) is its encoding if and only if every
two neighbours are the encoding of their own concatenation, so sequences that share a token may be exchanged there.
Matches are found from left to right: a window that begins inside a contraction (three characters at most) may split
other words there, and a text that ends early may miss the end of one; so a token counts only if it begins ``BEFORE``
bytes after the start of a window or part and ends ``AFTER`` bytes (two characters) before its end. If no token
agrees, the window grows to twice its reach, at last to both parts whole, which needs no agreement.

Texts of over ``SPREAD`` characters are dealt out: their parts go to all tasks, and a task of their own joins them.

The tokenizer must split by a pattern that drops white space, without a normaliser that depends on places (as
``word_bpe_49k.json``). Strings of special tokens in a text become these tokens, as the library does.

Nulls: a null text is empty and has no ids; a null document id is kept. Rows that repeat are encoded each for itself;
an empty table gives an empty result. Other columns of the input are not read.
"""

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.base import Numbers, slices, spans, texts
from tidekeep.session import materialize

LEAF, SPREAD, REACH = 2048, 1 << 16, 48
BEFORE, AFTER = 3, 8
SUFFIX = "</w>"

#: Any character that is not plain Latin, or that Python and the library treat differently: those texts are
#: normalised by the library.
_ODD = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")


class Coder:
    """A tokenizer file: normalising, encoding of leaves and windows, decoding.

    Leaves are looked up by their words between spaces; at most ``limit`` words (and 16 characters for each) are
    remembered, then all are forgotten.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.encode_special_tokens = True
        added = self.whole.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max([*vocabulary.values(), *self.special.values()]) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token.removesuffix(SUFFIX))
        self.limit = limit
        self._forget()

    def _forget(self):
        self.words, self.held, self.used = Numbers(), 0, 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def normal(self, text: str) -> str:
        """The normalised text; its only white space are spaces."""
        if not _ODD.search(text):
            return " ".join(text.lower().split())
        return self.whole.normalizer.normalize_str(text)

    def pieces(self, text: str) -> list:
        """Normalised texts and, between them, the ids of special tokens."""
        if "<" not in text or not self.special:
            return [self.normal(text)]
        return [self.special[p] if i % 2 else self.normal(p) for i, p in enumerate(self.marks.split(text))]

    def _learn(self):
        """Encodes new words many at a time; the bytes of words and tokens tell which ids belong to which word."""
        new, self.words.new = self.words.new, []
        first = len(self.words) - len(new)
        lines = [" ".join(new[a:a + 256]) for a in range(0, len(new), 256)]
        found = np.concatenate([np.array(ids, np.uint32) for ids in self._library(lines)])
        stops = np.searchsorted(np.cumsum(self.size[found]), np.cumsum([len(w.encode()) for w in new]), side="right")
        starts = np.concatenate(([0], stops[:-1]))
        if self.used + len(found) > len(self.ids):
            self.ids = np.resize(self.ids, max(self.used + len(found), 2 * len(self.ids)))
        if len(self.words) > len(self.start):
            self.start, self.length = (np.resize(x, max(len(self.words), 2 * len(x))) for x in (self.start, self.length))
        self.ids[self.used:self.used + len(found)] = found
        self.start[first:first + len(new)] = self.used + starts
        self.length[first:first + len(new)] = stops - starts
        self.used += len(found)
        self.held += sum(map(len, new))

    def leaves(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts, each encoded for itself."""
        if len(self.words) > self.limit or self.held > 16 * self.limit:
            self._forget()
        lists = [part.split(" ") for part in parts]
        codes = np.fromiter(map(self.words.__getitem__, (w for ws in lists for w in ws)), np.int64, sum(map(len, lists)))
        if self.words.new:
            self._learn()
        lengths = self.length[codes]
        ids = self.ids[spans(self.start[codes], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *map(len, lists)])].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _library(self, normal: list[str]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch_fast(normal, add_special_tokens=False)]

    def windows(self, parts: list[str]) -> list[list[int]]:
        return self._library(parts)

    # ---- the tree ----

    def join(self, pairs: list[tuple]) -> list[np.ndarray]:
        """Ids of ``text[low:high]`` for each ``(text, low, cut, high, ids of the left, ids of the right part)``."""
        done: list = [None] * len(pairs)
        todo, reach = list(range(len(pairs))), REACH
        while todo:
            edges = [(max(low, cut - reach), min(high, cut + reach)) for _, low, cut, high, _, _ in map(pairs.__getitem__, todo)]
            found = self.windows([pairs[k][0][a:b] for k, (a, b) in zip(todo, edges)])
            for k, (a, b), ids in zip(todo, edges, found):
                text, low, cut, high, left, right = pairs[k]
                done[k] = self._agree(ids, left, right, text[a:cut], text[cut:b], a == low, b == high)
            todo, reach = [k for k in todo if done[k] is None], 2 * reach
        return done

    def _agree(self, ids, left, right, before: str, after: str, from_low: bool, to_high: bool):
        """The parts' ids with the window's between them; None if the window is too small."""
        room, ahead = (len(x.replace(" ", "").encode()) for x in (before, after))
        at = (np.cumsum(self.size[ids]) - room).tolist() if len(ids) else []  # ends, counted from the cut
        starts = [-room, *at[:-1]]
        here = dict(zip(starts, zip(ids, range(len(ids)))))
        head = first = 0  # ids kept of the left part, and the window's first id after them
        if not from_low:
            end, i = 0, len(left)
            while i:
                token = int(left[i - 1])
                start = end - int(self.size[token])
                if start < BEFORE - room:
                    return None
                if end <= -AFTER and here.get(start, (-1,))[0] == token:
                    head, first = i, here[start][1] + 1
                    break
                end, i = start, i - 1
            else:
                return None
        tail, last = len(right), len(ids)
        if not to_high:
            start = 0
            for i, token in enumerate(right.tolist() if len(right) < 4096 else map(int, right)):
                end = start + int(self.size[token])
                if end > ahead - AFTER:
                    return None
                if start >= BEFORE and here.get(start, (-1,))[0] == token:
                    tail, last = i, here[start][1]
                    break
                start = end
            else:
                return None
        return np.concatenate((left[:head], np.array(ids[first:last], np.uint32), right[tail:]))

    def grow(self, trees: list[tuple[str, list[int], list[np.ndarray]]]) -> list[np.ndarray]:
        """Joins the parts of each text, two neighbours at a time: ``(text, bounds of its parts, their ids)``."""
        trees = [(text, list(bounds), list(parts)) for text, bounds, parts in trees]
        while busy := [t for t in trees if len(t[2]) > 1]:
            pairs = [(text, *bounds[i:i + 3], *parts[i:i + 2]) for text, bounds, parts in busy for i in range(0, len(parts) - 1, 2)]
            joined = iter(self.join(pairs))
            for _, bounds, parts in busy:
                odd = parts[-1:] if len(parts) % 2 else []
                parts[:] = [next(joined) for _ in range(len(parts) // 2)] + odd
                bounds[:] = bounds[::2] + ([] if len(bounds) % 2 else bounds[-1:])
        return [parts[0] for _, _, parts in trees]

    def encode(self, normal: list[str], leaf: int = LEAF) -> list[np.ndarray]:
        """Ids of normalised texts by their trees."""
        bounds = [halves(len(text), leaf) for text in normal]
        parts = iter(self.leaves([text[a:b] for text, bs in zip(normal, bounds) for a, b in zip(bs, bs[1:])]))
        return self.grow([(text, bs, [next(parts) for _ in bs[1:]]) for text, bs in zip(normal, bounds)])

    def encode_texts(self, raw: list[str], leaf: int = LEAF) -> list[np.ndarray]:
        split = [self.pieces(text) for text in raw]
        found = iter(self.encode([p for ps in split for p in ps if isinstance(p, str)], leaf))
        return [np.concatenate([next(found) if isinstance(p, str) else np.array([p], np.uint32) for p in ps]) for ps in split]


def halves(n: int, leaf: int) -> list[int]:
    """Bounds of the parts of a text of ``n`` characters, halved until none is longer than ``leaf``."""
    parts = 1
    while parts * leaf < n:
        parts *= 2
    return [n * k // parts for k in range(parts + 1)]


@lru_cache
def coder(path: str) -> Coder:
    """One for each file and Python worker."""
    return Coder(path)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    values = np.concatenate(ids) if ids else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF,
           spread: int = SPREAD) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, in their order."""
    source = texts(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    is_long = F.char_length("text") > spread

    def run(batches):
        for batch in slices(batches):
            yield _batch({"doc_id": batch.column("doc_id"),
                          "ids": _lists(coder(path).encode_texts(batch.column("text").to_pylist(), leaf))})

    short = source.where(~is_long).mapInArrow(run, f"doc_id {kind}, ids array<int>")
    # Numbers of rows must not change when a task runs again, so the long texts are written first.
    longs = materialize(source.where(is_long).withColumn("doc", F.monotonically_increasing_id()), "long-texts")
    return short.unionByName(_spread(longs, path, leaf, spread))


def _spread(longs: DataFrame, path: str, leaf: int, spread: int) -> DataFrame:
    """The long texts' parts, dealt out to all tasks, and joined by document."""
    def cut(batches):
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                for piece, p in enumerate(coder(path).pieces(text)):
                    if isinstance(p, str):
                        bounds = halves(len(p), max(leaf, spread // 4))
                        rows += [(doc, piece, i, None, p[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                    else:
                        rows.append((doc, piece, 0, p, ""))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield _batch({n: pa.array(c, k) for n, c, k in zip(("doc", "piece", "part", "special", "text"), zip(*rows), kinds)})

    def run(batches):
        for batch in slices(batches):
            ids = coder(path).encode(batch.column("text").to_pylist(), leaf)
            special = batch.column("special").to_pylist()
            yield _batch({n: batch.column(n) for n in ("doc", "piece", "part", "text")} | {
                "ids": _lists([i if s is None else np.array([s], np.uint32) for i, s in zip(ids, special)])})

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece", "ascending"), ("part", "ascending")])
        trees, piece = [], None
        for number, text, ids in zip(table["piece"].to_pylist(), table["text"].to_pylist(), table["ids"]):
            if number != piece:
                trees.append(([], []))
                piece = number
            trees[-1][0].append(text)
            trees[-1][1].append(ids.values.to_numpy().astype(np.uint32))
        found = coder(path).grow([("".join(ts), np.cumsum([0, *map(len, ts)]).tolist(), ids) for ts, ids in trees])
        return pa.table({"doc": table["doc"].slice(0, 1), "ids": _lists([np.concatenate(found)])})

    parts = int(longs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = longs.select("doc", "text").mapInArrow(cut, "doc long, piece int, part int, special int, text string") \
        .repartition(parts, "doc", "piece", "part") \
        .mapInArrow(run, "doc long, piece int, part int, text string, ids array<int>")
    joined = dealt.groupBy("doc").applyInArrow(whole, "doc long, ids array<int>")
    return longs.select("doc", "doc_id").join(joined, "doc").select("doc_id", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the library's text of the ids with special tokens, to ``doc_id, ids``."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices_of_lists(batch):
                decoded = coder(path).whole.decode_batch(part.column("ids").to_pylist(), skip_special_tokens=False)
                yield _batch({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "decoded": pa.array(decoded, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def slices_of_lists(batch, column: str = "ids", limit: int = 1 << 18):
    """Cuts a batch so that ``column`` has about ``limit`` entries in each."""
    groups = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False)) // limit
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def digests(decoded: DataFrame) -> DataFrame:
    """``n_tokens``, and digests of the decimal ids (joined by a space) and of the decoded text."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
