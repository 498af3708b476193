"""Helpers shared by the operators: input columns, bounded batches, ids of whole texts."""

import gc
import os
import re

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a task holds a few texts at a time however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; a null text is empty.

    Other columns are left behind here, so none can clash with the operator's own.
    """
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def row_of(docs: DataFrame, columns=None):
    """All columns (or those named) as one struct, in which their names can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (columns or docs.columns)])


def slices(batches, column: str = "text", limit: int = 1 << 20):
    """Cuts Arrow batches so that ``column`` has about ``limit`` bytes in each; one longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1``, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def crc_of_spans(data: np.ndarray, bounds: np.ndarray):
    """crc32 of each span of little-endian unsigned 32-bit ids."""
    import zlib

    view = memoryview(np.ascontiguousarray(data, "<u4")).cast("B")
    return [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


#: A space between two characters that are no white space. Both tokenizers end a match before it and none
#: looks across it, so texts may be encoded in parts that are cut there.
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Numbers(dict):
    """Numbers keys as they are first asked for; ``new`` holds those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number


#: Characters up to here keep their number of bytes in lower case and are composed already.
_LATIN = "\u0021-\u0084\u0086-\u009f\u00a1-\u012f\u0131-\u022f"
_WORD, _WORDS = re.compile(f"[{_LATIN}]+"), re.compile(f"[{_LATIN}][\t\n\r{_LATIN}]*[{_LATIN}]")


class ChunkEncoder:
    """Ids of whole texts by a file of the tokenizers library, asked once for every distinct chunk.

    Texts are cut at safe spaces into chunks. New chunks of Latin characters are put together again, many to a line, as
    the library is fast with long texts, and the bytes that tokens stand for tell which ids belong to which chunk;
    other chunks are encoded one by one. At most ``limit`` chunks (and 16 characters for each) are remembered; then all
    but those used most, half of them, are forgotten, so memory stays bounded.
    """

    def __init__(self, path: str, limit: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        for tokenizer in (self.tokenizer, self.plain):
            tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.limit, suffix = limit, getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token.removesuffix(suffix))  # a character of a byte-level token is a byte
        self.drops_space = int(self.size[self._ids([" a"])[0]].sum()) == 1
        # A normaliser that only lowers the case of Latin letters and white space is left out for lines of them.
        probes = ["\u00c9t\u00e9 ABC", "x\tY\n z", "\u00d1\u01c4\u01f1\u0220 \u00df"]
        wanted = [x.tolist() for x in self._ids(probes)]
        self.lowers = self.drops_space and [x.tolist() for x in self._ids([p.lower() for p in probes], self.plain)] == wanted
        self.calls = 0
        self._clear()

    def _clear(self):
        self.hits = np.zeros(1 << 16, np.int64)
        self.chunks, self.held, self.used = Numbers(), 0, 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.unsafe = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, bool)

    def _forget(self):
        """Keeps chunks that were used again, those used most, up to half of the limit."""
        names, hits = list(self.chunks), self.hits[:len(self.chunks)]
        kept = np.flatnonzero(hits > 1)
        kept = np.sort(kept[np.argsort(-hits[kept], kind="stable")[:self.limit // 2]])
        names = [names[i] for i in kept.tolist()]
        ids, lengths = self.ids[spans(self.start[kept], self.length[kept])], self.length[kept]
        unsafe, hits = self.unsafe[kept], hits[kept] // 2
        self._clear()
        if sum(map(len, names)) > 8 * self.limit:
            return
        self.chunks.update(zip(names, range(len(names))))
        self.held, self.used, n = sum(map(len, names)), len(ids), len(names)
        self.ids, self.start, self.length, self.unsafe, self.hits = (
            self._room(x, m) for x, m in ((self.ids, len(ids)), (self.start, n), (self.length, n), (self.unsafe, n), (self.hits, n)))
        self.ids[:len(ids)], self.start[:n], self.length[:n] = ids, np.cumsum(lengths) - lengths, lengths
        self.unsafe[:n], self.hits[:n] = unsafe, hits

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return np.resize(array, max(n, 2 * len(array))) if n > len(array) else array

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        found = []
        for a in range(0, len(texts), 4096):
            part = (tokenizer or self.tokenizer).encode_batch_fast(texts[a:a + 4096], add_special_tokens=False)
            found += [np.array(e.ids, np.uint32) for e in part]
        return found

    def _learn(self):
        """A leading space marks the chunk that begins a text; the others get the space that stood before them."""
        new, self.chunks.new = self.chunks.new, []
        first, n = len(self.chunks) - len(new), len(self.chunks)
        joined, sizes, alone, unsafe = [], [], [], np.zeros(len(new), bool)
        for i, chunk in enumerate(new):
            if chunk[:1] != " " and _WORD.fullmatch(chunk):
                joined.append(i)
                sizes.append(len(chunk.encode()) + (not self.drops_space))
            elif chunk[:1] != " " and _WORDS.fullmatch(chunk):
                joined.append(i)
                sizes.append(len("".join(chunk.split()).encode()) if self.drops_space else 1 + len(chunk.encode()))
            else:
                alone.append(i)
                unsafe[i] = chunk[1:] != "" and chunk[-1].isspace() if chunk[:1] == " " else not chunk or chunk[0].isspace() or chunk[-1].isspace()
        lines = [" " + " ".join([new[i] for i in joined[a:a + 256]]) for a in range(0, len(joined), 256)]
        found = self._ids([line.lower() for line in lines], self.plain) if self.lowers else self._ids(lines)
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        ends, wanted = np.concatenate(([0], np.cumsum(self.size[ids]))), np.cumsum(sizes)
        stops = np.searchsorted(ends, wanted)
        if len(joined) and (ends[-1] != wanted[-1] or (ends[stops] != wanted).any()):
            raise ValueError("the tokenizer's tokens do not cover the bytes of a text")
        rest = self._ids([new[i][1:] if new[i][:1] == " " else " " + new[i] for i in alone])
        self.start, self.length, self.unsafe, self.hits = (
            self._room(x, n) for x in (self.start, self.length, self.unsafe, self.hits))
        self.unsafe[first:n], self.hits[first:n] = unsafe, 0
        for at, bounds, values in ((joined, np.concatenate(([0], stops)), ids),
                                   (alone, np.cumsum([0, *map(len, rest)]), np.concatenate(rest) if rest else ids[:0])):
            at, bounds = np.array(at, np.int64) + first, bounds.astype(np.int64)
            self.ids = self._room(self.ids, self.used + len(values))
            self.ids[self.used:self.used + len(values)] = values
            self.start[at], self.length[at] = self.used + bounds[:-1], np.diff(bounds)
            self.used += len(values)
        self.held += sum(map(len, new))

    def _codes(self, lists):
        codes = np.fromiter(map(self.chunks.__getitem__, (c for chunks in lists for c in chunks)), np.int64, sum(map(len, lists)))
        if self.chunks.new:
            self._learn()
        used = np.bincount(codes)
        self.hits[:len(used)] += used
        return codes

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end_id`` after every text, and the bounds of the texts in them."""
        if len(self.chunks) > self.limit or self.held > 16 * self.limit:
            self._forget()
        self.calls += 1
        if self.calls % 16 == 0:  # what Spark's worker leaves between tasks; see ``encoder``
            gc.collect()
        lists = [text.split(" ") for text in texts]
        for chunks in lists:
            chunks[0] = " " + chunks[0]
        codes = self._codes(lists)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        bad = np.unique(np.repeat(np.arange(len(lists)), counts)[self.unsafe[codes]])
        if len(bad):
            for i in bad.tolist():
                lists[i] = SAFE_SPACE.split(texts[i])
                lists[i] = [" " + lists[i][0], *lists[i][1:]]
            codes = self._codes(lists)
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
        lengths = self.length[codes]
        ids = self.ids[spans(self.start[codes], lengths)]
        per_text = np.add.reduceat(lengths, np.cumsum(counts) - counts) if len(lists) else np.zeros(0, np.int64)
        bounds = np.concatenate(([0], np.cumsum(per_text + 1)))
        out = np.empty(int(bounds[-1]), np.uint32)
        ends = np.zeros(len(out), bool)
        ends[bounds[1:] - 1] = True
        out[ends], out[~ends] = end_id, ids
        return out, bounds


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, limit: int = 350_000) -> ChunkEncoder:
    """One encoder for each file, limit and Python worker; it serves all tasks of the worker."""
    if (path, limit) not in _ENCODERS:
        gc.disable()  # what an encoder makes has no cycles, and there is too much of it to look through again and again
        _ENCODERS[path, limit] = ChunkEncoder(path, limit)
    return _ENCODERS[path, limit]
