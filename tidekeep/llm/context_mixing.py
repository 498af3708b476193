"""Language-model scores by online logistic context mixing.

Texts are token sequences: words in lower case (A-Z), then one end. A token is a path of binary decisions: through a
Huffman tree over classes of training words (those seen equally often are one class; the end is its own), then by halves
to the word in its class. So every training word has a path of its own. Words that training texts don't have share the
class of words seen once; one more decision tells them apart, and the bits of their bytes (and a closing zero byte) give
the word. So every text has a probability, and bits per byte are its logarithm over its bytes.

Every decision has three predictors: the node's own counts, the counts of the node after the token before, and after
the two tokens before. The predictors' log odds are summed with weights; which set of weights is taken is gated by how
often the two contexts were seen. Weights start equal for all documents and follow the document by gradient steps after
every ``STEP`` tokens; a last stage moves the mixed probability towards what came true in the document at probabilities
like it.

All counts are taken over all training texts, for every word and every context; no table has a fixed size. The different
words of a block are sorted, cut at borders that are the same for all blocks, and counted and numbered range by range.
Only the borders come from a sample, of the first words of pieces. Each block of
texts sends its pairs of context and token to the chunk of the context's hash, with how often its training texts have
them. A chunk, of which there are more as the corpus grows, adds the blocks up and answers every block with how often
the other blocks have its pairs, node by node along the tokens' paths. How often they have a context is known from the
shorter one, so answers are only the parts that go along, coded by the chance that the shorter context gives. The block
adds its own counts and is scored. Contexts of words seen more than ``HOT`` times are dealt out by the first ``SPLIT``
decisions of the token, so none is one task's. These loops are in ``mixing.java``; what is here, and brute force in the
tests, says what they do. The driver holds the classes: with n training tokens there are fewer than the square root of
2n. Spelling is counted and answered here, pairs with all counts along the path, with bytes for tokens.

Nulls: a null text is empty (the end is its only token); a null document id counts as the empty text when documents
are divided. Rows that repeat are scored, and learned from, each for itself. An empty table gives an empty result;
without training texts every word is new. Other columns of the input are not read. Contexts of two words that are both
seen more than ``HOT`` times are told apart, behind the first decisions, by a 64-bit hash.
"""

import bisect
import heapq
import os
import pickle
import pkgutil
import struct
import tempfile
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column, _to_java_column, _to_seq

from tidekeep.llm.base import Numbers, slices, spans, texts
from tidekeep.session import materialize

BLOCK_TOKENS, SCORED_TOKENS, STEP = 1 << 21, 1 << 17, 32
CHUNK_TOKENS, HOT, SPLIT = 1 << 21, 1 << 19, 8
PIECE_WORDS, CHUNK_WORDS = 1 << 12, 1 << 18
PRIOR, RATE, REFINE = 4.0, 0.02, 24.0
END = b" "  # stands for the end of a text; no word has a space
FOLDS = 10


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


# ---- blocks: texts as numbers of the block's own words ------------------------------------------------------------

def _blocks(block_tokens: int):
    def run(batches):
        number, serial = Numbers(), 0
        parts, ids, ends, held, sizes = [], [], [0], [], []

        def block():
            tokens = np.concatenate(parts)
            bounds = np.array(ends)
            train = np.repeat(~np.array(held), np.diff(bounds))
            n, learned = (np.bincount(x, minlength=len(number)) for x in (tokens, tokens[train]))
            name = (TaskContext.get().partitionId() << 32) + serial
            words = pa.array(list(number), pa.binary())
            order = pc.sort_indices(words).to_numpy()
            words, n, learned = words.take(pa.array(order)), n[order], learned[order]
            renumbered = np.empty(len(order), np.uint32)
            renumbered[order[_numbered(n)]] = np.arange(len(order))
            yield _head(name, ids, held, renumbered[tokens], bounds, np.array(sizes, np.int64), n)
            for a in range(0, len(words), PIECE_WORDS):
                part = words.slice(a, PIECE_WORDS)
                yield _piece([name, a, len(part), part[0].as_py(), *packed_words(part), packed(learned[a:a + PIECE_WORDS].astype("<u4")), None])

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                words = raw.lower().split()
                words.append(END)
                parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                ids.append(doc)
                held.append(held_out(doc))
                sizes.append(len(raw))
                ends.append(ends[-1] + len(words))
                if ends[-1] >= block_tokens:
                    yield from block()
                    number, serial = Numbers(), serial + 1
                    parts, ids, ends, held, sizes = [], [], [0], [], []
        if ids:
            yield from block()
    return run


def _numbered(n: np.ndarray) -> np.ndarray:
    """Places of a block's words, which are sorted, by their numbers in its texts: by falling counts, equal ones in order."""
    return np.argsort(-n.astype(np.int64), kind="stable")


_PIECE = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("m", pa.int32()), ("first", pa.binary()), ("sizes", pa.binary()),
                    ("words", pa.binary()), ("n", pa.binary()), ("row", pa.binary())])


def _piece(row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], field.type) for x, field in zip(row, _PIECE)], schema=_PIECE)


def _sized(data: bytes) -> bytes:
    return struct.pack("<i", len(data)) + data


def _head(name, ids, held, tokens, bounds, sizes, n):
    """The row with the texts of a block and the counts of its sorted words in them, and with what only the result needs."""
    head = pickle.dumps({"ids": ids, "held": held, "tokens": np.diff(bounds).astype("<i8").tobytes(), "bytes": sizes.astype("<i8").tobytes()})
    row = struct.pack("<biii", 0, len(n), len(ids), len(tokens)) + _sized(packed_ranks(tokens)) + _sized(
        packed(np.diff(bounds).astype("<u4"))) + _sized(packed(n.astype("<u4"))) + bytes(held) + head + struct.pack("<q", name)
    return _piece([name, -1, len(n), None, None, None, None, row])


_ZSTD, _ZSTD_SMALL = pa.Codec("zstd", compression_level=3), pa.Codec("zstd", compression_level=6)


def packed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """Sizes of words, and their bytes, compressed."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = words.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))
    return packed(np.diff(ends).astype("<u4")), _ZSTD_SMALL.compress(data, asbytes=True)


def unpacked_words(sizes: bytes, data: bytes, m: int) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(unpacked(sizes, "<u4", m)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends), pa.decompress(data, decompressed_size=int(ends[-1]), codec="zstd")])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: frequent values take little room on disk, high bytes that are all 0 none."""
    numbers = numbers.view(f"u{numbers.itemsize}")
    width = (int(numbers.max()).bit_length() + 7) // 8 if len(numbers) else 0
    planes = np.empty((width, len(numbers)), np.uint8)
    for k in range(width):
        planes[k] = numbers >> numbers.dtype.type(8 * k)
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    """``n`` numbers of a kind that ``packed`` wrote."""
    numbers = np.zeros(n, f"u{np.dtype(kind).itemsize}")
    planes = np.frombuffer(pa.decompress(memoryview(data)[1:], decompressed_size=data[0] * n, codec="zstd"), np.uint8).reshape(data[0], n)
    for k in range(data[0]):
        numbers |= planes[k].astype(numbers.dtype) << numbers.dtype.type(8 * k)
    return numbers.view(kind)


def packed_ranks(numbers: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: a byte has those, or says in which range a large one is."""
    most = int(numbers.max()) if len(numbers) else 0
    shift = max(0, most.bit_length() - 6)
    begin = 255 - (most >> shift)
    large = numbers >= begin
    return bytes([shift, begin]) + _planes(np.where(large, begin + (numbers >> np.uint32(shift)), numbers).astype(np.uint8)) + packed(
        numbers[large] & np.uint32((1 << shift) - 1))


def unpacked_ranks(data: bytes, n: int) -> np.ndarray:
    """``n`` numbers that ``packed_ranks`` wrote."""
    (shift, begin), size = data[:2], int.from_bytes(data[2:6], "little")
    numbers = np.frombuffer(pa.decompress(memoryview(data)[6:6 + size], decompressed_size=n, codec="zstd"), np.uint8).astype(np.int64)
    large = np.flatnonzero(numbers >= begin)
    numbers[large] = ((numbers[large] - begin) << np.int64(shift)) | unpacked(memoryview(data)[6 + size:], "<u4", len(large))
    return numbers


def _planes(planes: np.ndarray) -> bytes:
    data = _ZSTD.compress(planes, asbytes=True)
    return len(data).to_bytes(4, "little") + data


def encode_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each block of texts a row with the texts (``pos`` -1), and rows with its different words, sorted, in pieces."""
    return texts(docs, key, text).mapInArrow(
        _blocks(block_tokens), "block long, pos int, m int, first binary, sizes binary, words binary, n binary, row binary")


# ---- words --------------------------------------------------------------------------------------------------------

def _borders(pieces: DataFrame, chunks: int, most: int = 20_000) -> list[bytes]:
    """Words that part all words into ranges of about equal numbers; first words of some pieces are enough to tell."""
    n = pieces.count()
    some = pieces.where(F.pmod(F.xxhash64("block", "pos"), F.lit(max(1, n // most))) == 0)
    firsts = sorted(bytes(r["first"]) for r in some.select("first").collect())
    return sorted({firsts[i * len(firsts) // chunks] for i in range(1, chunks)}) if firsts else []


def _ranged(borders):
    """Pieces cut at the borders, each part with the number of its range."""
    names = ["chunk", "block", "pos", "m", "sizes", "words", "n"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        limits = borders.value
        for r in _rows(batches):
            words = unpacked_words(r["sizes"], r["words"], r["m"])
            n = unpacked(r["n"], "<u4", r["m"])
            low, high = (bisect.bisect_right(limits, words[i].as_py()) for i in (0, r["m"] - 1))
            cuts = [0, *(bisect.bisect_left(range(r["m"]), limit, key=lambda i: words[i].as_py()) for limit in limits[low:high]), r["m"]]
            rows = []
            for chunk, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), low):
                if b > a:
                    rows.append((chunk, r["block"], r["pos"] + a, b - a, *packed_words(words.slice(a, b - a)), packed(n[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)
    return run


_COUNTED = "chunk int, class long, seen long, words_of long, m int, sizes binary, words binary, kind binary, blocks binary, places binary"


def _counted(table: pa.Table) -> pa.Table:
    """All words of a range, sorted: a row with them, their classes (-1: the end) and their places in the blocks' lists, and
    a row for each class."""
    rows = table.sort_by([("block", "ascending"), ("pos", "ascending")]).to_pylist()
    coded = pa.concat_arrays([unpacked_words(r["sizes"], r["words"], r["m"]) for r in rows]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    place = place[coded.indices.to_numpy()]
    kind = np.bincount(place, np.concatenate([unpacked(r["n"], "<u4", r["m"]) for r in rows]), minlength=len(words)).astype(np.int64)
    end = pc.index(words, pa.scalar(END, pa.binary())).as_py()
    ends = int(kind[end]) if end >= 0 else 0
    if end >= 0:
        kind[end] = -1
    blocks, sizes = np.unique(np.repeat([r["block"] for r in rows], [r["m"] for r in rows]), return_counts=True)
    classes, many = np.unique(kind, return_counts=True)
    chunk, none = rows[0]["chunk"], [None] * len(classes)
    columns = [[chunk] * (1 + len(classes)), [None, *classes.tolist()], [None, *(ends if k == -1 else k for k in classes.tolist())], [None, *many.tolist()],
               [len(words), *none], *([x, *none] for x in (
                   *packed_words(words), packed(kind.astype("<i8")), pickle.dumps((blocks.tolist(), sizes.tolist())),
                   packed(np.diff(place, prepend=0).astype("<i4"))))]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)],
                                names=["chunk", "class", "seen", "words_of", "m", "sizes", "words", "kind", "blocks", "places"])


def _words_of(r: dict, new: bool) -> list[bytes]:
    """Of a row of ``_counted`` the words that training texts have, without the end, or those they don't have."""
    kind = unpacked(r["kind"], "<i8", r["m"])
    return unpacked_words(r["sizes"], r["words"], r["m"]).filter(pa.array(kind == 0 if new else kind > 0)).to_pylist()


def _identified(new_id: int):
    """Ids of the words of blocks, from where the classes begin in a range; new words also have their spelling's score."""
    def run(found, told):
        rows = []
        for r in found.to_pylist():
            kind = unpacked(r["kind"], "<i8", r["m"])
            blocks, sizes = pickle.loads(r["blocks"])
            place = np.cumsum(unpacked(r["places"], "<i4", sum(sizes)), dtype=np.int64)
            classes = told.filter(pc.is_valid(told["class"])).sort_by("class")
            tails = np.concatenate([np.zeros(0), *(np.frombuffer(x, "<f8") for x in told.filter(pc.is_valid(told["tails"])).sort_by("serial")["tails"].to_pylist())])
            order = np.argsort(kind, kind="stable")
            ordered = kind[order]
            offset = np.concatenate([classes["offset"].to_numpy(), [0]])[np.searchsorted(classes["class"].to_numpy(), ordered)]
            ids, tail = np.empty(len(kind), np.int64), np.zeros(len(kind))
            ids[order] = offset + np.arange(len(kind)) - np.searchsorted(ordered, ordered)
            ids[kind == 0] = new_id
            tail[kind == 0] = tails
            edges = np.cumsum([0, *sizes]).tolist()
            for block, a, b in zip(blocks, edges[:-1], edges[1:]):
                mine = place[a:b]
                tails = tail[mine][kind[mine] == 0].astype("<f8")
                rows.append((block, struct.pack("<biii", 1, r["chunk"], b - a, len(tails)) + _sized(packed(ids[mine].astype("<u4"))) + _sized(packed(tails))))
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * 2, (pa.int64(), pa.binary()))], names=["block", "row"])
    return run


# ---- decisions ----------------------------------------------------------------------------------------------------

class Tree:
    """Huffman tree over counts: for each symbol the nodes on its path and the bits taken there."""

    def __init__(self, counts):
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children, k = {}, len(counts)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            children[k] = (x, y)
            heapq.heappush(heap, (a + b, k))
            k += 1
        paths, todo = {}, [(heap[0][1], [], [])]
        while todo:
            at, nodes, bits = todo.pop()
            if at < len(counts):
                paths[at] = nodes, bits
            else:
                for bit, child in enumerate(children[at]):
                    todo.append((child, [*nodes, at - len(counts)], [*bits, bit]))
        self.leaves = np.array(list(paths), np.int64)  # what is below a node stands together
        self.length = np.array([len(paths[i][0]) for i in range(len(counts))], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([x for i in range(len(counts)) for x in paths[i][0]], np.int64)
        self.bit = np.array([x for i in range(len(counts)) for x in paths[i][1]], np.int64)
        weight = np.repeat(np.asarray(counts, np.float64), self.length)
        n = np.bincount(self.node, weight, minlength=max(1, len(counts) - 1))
        one = np.bincount(self.node, weight * self.bit, minlength=len(n))
        self.chance = np.clip((one + 0.5) / (n + 1), 1e-7, 1 - 1e-7)  # of a one


class Code:
    """Paths of ids: the tree to a class, then halves of the class. Ids run through the classes in the order of the leaves.

    The last class is that of words seen once; ``self.new`` stands there for every word that was not seen.
    """

    def __init__(self, tree: Tree, sizes, seen, novel: bool = True):
        self.tree, self.sizes, self.seen = tree, np.array(sizes, np.int64), np.array(seen, np.int64)
        self.leaves = tree.leaves
        self.begins = np.cumsum(self.sizes[self.leaves]) - self.sizes[self.leaves]  # by leaf
        self.first = np.empty_like(self.sizes)  # by class
        self.first[self.leaves] = self.begins
        often = np.argsort(-self.seen, kind="stable")
        self.by_rank, self.ranks = often, np.cumsum(self.sizes[often]) - self.sizes[often]  # ids by falling counts take fewer bytes
        self.rank_of = np.empty_like(self.sizes)
        self.rank_of[often] = self.ranks
        self.once = len(self.sizes) - 1 if novel else -1
        # Chances of a one: at the tree's nodes, of a new word, and by the size of what is halved.
        halved, more = [], np.unique(self.sizes[self.sizes > 1])
        while len(more):
            halved.append(more)
            more = np.unique(np.concatenate((more // 2, (more + 1) // 2)))
            more = more[more > 1]
        self.halved = np.unique(np.concatenate(halved)) if halved else np.zeros(0, np.int64)
        self.kind = np.int32 if 0 < self.seen.max() < 1 << 31 else np.int64  # of a context's counts
        self.chance = np.concatenate((tree.chance, [0.5], self.halved // 2 / self.halved))
        self.new = int(self.sizes.sum())
        self.start = self.new + 1  # stands before a text
        top = np.zeros(len(self.sizes), np.int64)
        for depth in range(SPLIT):
            more = tree.length > depth
            top[more] = 2 * top[more] + tree.bit[tree.start[more] + depth]
        self.top = self.first.copy()  # of classes below a node SPLIT deep: the least id there
        deep = np.flatnonzero(tree.length >= SPLIT)
        least = np.full(1 << SPLIT, self.new)
        np.minimum.at(least, top[deep], self.first[deep])
        self.top[deep] = least[top[deep]]

    def classes(self, ids: np.ndarray) -> np.ndarray:
        found = self.leaves[np.searchsorted(self.begins, ids, "right") - 1]
        return np.where(ids >= self.new, self.once, found)

    def unrank(self, ranks: np.ndarray) -> np.ndarray:
        k = self.by_rank[np.searchsorted(self.ranks, ranks, "right") - 1]
        return np.where(ranks >= self.new, ranks, ranks - self.rank_of[k] + self.first[k])

    def paths(self, ids: np.ndarray):
        """Length and start of the path of each id; twice the place of the chance of a one, and the bit, for its decisions;
        and the depth of the decision that tells new words, -1 where there is none."""
        k, tree = self.classes(ids), self.tree
        special, new = k == self.once, ids == self.new
        head = tree.length[k]
        at, size = np.where(new, 0, ids - self.first[k]), np.where(new, 1, self.sizes[k])
        todo, levels, length = np.flatnonzero(size > 1), [], head + special
        at, size = at[todo], size[todo]
        while len(todo):
            half = (size + 1) // 2
            right = at >= half
            levels.append((todo, length[todo], 2 * (np.searchsorted(self.halved, size) + len(tree.chance) + 1) + right))
            length[todo] += 1
            at, size = np.where(right, at - half, at), np.where(right, size - half, half)
            go = size > 1
            todo, at, size = todo[go], at[go], size[go]
        start = np.cumsum(length) - length
        way = np.zeros(int(length.sum()), np.int32)
        way[spans(start, head)] = self._heads()[spans(tree.start[k], head)]
        way[(start + head)[special]] = 2 * len(tree.chance) + new[special]
        for some, depth, taken in levels:
            way[start[some] + depth] = taken
        return length, start, way, np.where(special, head, -1)

    def _heads(self) -> np.ndarray:
        return (2 * self.tree.node + self.tree.bit).astype(np.int32)


def _slots(node: np.ndarray, context: np.ndarray, bits: int, which: int) -> np.ndarray:
    """Hash of (node, context) in ``bits`` bits; those of ``which`` stand one after the other."""
    key = (node + 1) * np.int64(0x2545F4914F6CDD1D) + context * np.int64(0x27D4EB2F165667C5) + np.int64(which)
    key = (key ^ (key >> np.int64(29))) * np.int64(0x1B873593CC9E2D51)
    return ((key >> np.int64(64 - 2 - bits)) & np.int64((1 << bits) - 1)) + np.int64(which << bits)


def _spelled(words: list[bytes]):
    """The bytes of words, each word closed by a zero byte: word, byte, and the two and the three bytes before."""
    raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 1 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = [np.where(at >= k, np.roll(raw, k), 0) for k in (1, 2, 3)]
    two = before[0] | (before[1] << 8)
    return owner, raw, two, two | (before[2] << 16)


# ---- counting -----------------------------------------------------------------------------------------------------

class Pairs:
    """Different pairs of context and id, sorted; ``of`` has the place of each pair given. Contexts are columns of numbers
    below ``size``, as are ids, by their order in a block; ``key`` gives a context's number everywhere, from its rows."""

    def __init__(self, tag: int, context: list, word: np.ndarray, size: int, key, bits: int):
        width = np.int64(max(1, size - 1).bit_length())
        code, room = context[0].astype(np.int64), width
        for column in (*context[1:], word):
            if room + width > 62:
                code = _unique(code)[1]
                room = np.int64(max(1, len(code)).bit_length())
            code, room = (code << width) | column, room + width
        pairs, self.of, row = _unique(code)
        self._deal(tag, key(row), pairs & ((np.int64(1) << width) - 1), _slots(np.array([tag]), key(row), bits, 0), bits)

    def _deal(self, tag, key, word, chunk, bits):
        self.tag, self.key, self.word, self.of = tag, key, word.astype(np.int32), self.of.astype(np.int32)
        self.order = np.argsort(chunk.astype(np.uint16) if bits <= 16 else chunk, kind="stable").astype(np.int32)
        self.size = np.bincount(chunk, minlength=1 << bits)

    def rows(self, block: int, learn: np.ndarray, ids: np.ndarray):
        """Rows for the chunks: the pairs, and how often they are among those to learn from."""
        n = np.bincount(self.of[learn], minlength=len(self.key))
        ends, ranks = np.cumsum(self.size), ids[self.word]
        for chunk in np.flatnonzero(self.size).tolist():
            some = self.order[ends[chunk] - self.size[chunk]:ends[chunk]]
            yield (chunk, self.tag, block, len(some), packed(np.diff(self.key[some], prepend=0).astype("<i8")),
                   packed_ranks(ranks[some].astype(np.uint32)), packed(n[some].astype("<u4")))

    def place(self, parts, paths, kind=np.int64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the chunks' answers, in their order, for each pair: first and last place of its counts, and all counts."""
        if not parts:
            return *np.zeros((2, len(self.key)), np.int64), np.zeros(0, kind)
        shared, a, used = _shared(self.key, self.word, paths, self.order), 0, 0
        at, ends, counts = np.empty(len(self.key), np.int64), np.empty(len(self.key), np.int32), []
        for m, last, data in parts:
            some, last = self.order[a:a + m], unpacked(last, "u1", m).astype(np.int32)
            at[some], ends[some] = np.cumsum(last + 1) - last - 1 + used, last
            counts.append(_counts(last, shared[a:a + m], data, kind))
            a, used = a + m, used + len(counts[-1])
        return at, ends, np.concatenate(counts)


def _counts(last: np.ndarray, shared: np.ndarray, data: bytes, kind) -> np.ndarray:
    """All counts of the pairs of a chunk's answer, up to the last of each."""
    given, used = unpacked(data, "<u8", int(np.maximum(0, last - shared).sum())).astype(kind), 0
    first = np.cumsum(last + 1) - last - 1
    counts, now = np.zeros(int(last.sum()) + len(last), kind), np.zeros(len(last), kind)
    some, depth = np.arange(len(last)), 0
    until = np.maximum(last, shared)
    until[:-1] = np.maximum(until[:-1], shared[1:])
    while len(some):
        new = some[(shared[some] < depth) & (depth <= last[some])]
        parent = now[new]
        order = np.argsort(_digits(parent), kind="stable")
        parent[order] = np.abs(parent[order] - given[used:used + len(new)])  # what went the other way, after the first
        now[new] = parent
        used += len(new)
        alike = shared[some] >= depth  # as the pair before
        if alike.any():
            source = np.maximum.accumulate(np.where(alike, 0, np.arange(len(some))))
            now[some] = now[some[source]]
        want = some[last[some] >= depth]
        counts[first[want] + depth] = now[want]
        depth += 1
        some = some[until[some] >= depth]
    return counts


def _digits(n: np.ndarray) -> np.ndarray:
    """Binary digits of counts; numbers of what went the other way are sent by them, as like ones then stand together."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int16)


def _shared(key, word, paths, order) -> np.ndarray:
    """Depth of the last node that each pair, in an order, shares with the pair before; -1 if its key is another."""
    _, start, way, _ = paths
    at, key = start[word[order]], key[order]
    shared = np.full(len(order), -1, np.int32)
    some = np.flatnonzero(key[1:] == key[:-1]) + 1
    depth = 0
    while len(some):
        shared[some] = depth
        some = some[way[at[some] + depth] == way[at[some - 1] + depth]]
        depth += 1
    return shared


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different numbers, the place of each number among them, and where each of them stands."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    of = np.empty(len(x), np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], of, order[new]


_ASKED = "chunk int, tag int, block long, m int, key binary, id binary, n binary"
_ANSWERED = "block long, tag int, chunk int, m int, last binary, counts binary"


def _asked(rows):
    names = ["chunk", "tag", "block", "m", "key", "id", "n"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    rows = list(rows)
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[a:a + 64]), kinds)], names=names)


def _read(code: Code, r: dict) -> dict:
    """A row with its pairs."""
    read = {c: r[c] for c in ("tag", "block", "chunk", "m")}
    key = np.cumsum(unpacked(r["key"], "<i8", r["m"]))
    read["id"], read["n"] = code.unrank(unpacked_ranks(r["id"], r["m"])), unpacked(r["n"], "<u4", r["m"]).astype(np.int64)
    read["key"] = key
    return read


def _numbered_ids(code: Code, asked: list):
    """Gives the pairs the numbers of their ids among those of a chunk, and returns the ids' paths."""
    ids = np.unique(np.concatenate([r["id"] for r in asked]))
    for r in asked:
        r["word"] = np.searchsorted(ids, r["id"])
    return code.paths(ids)


def _answer(paths, asked: list):
    """Answers to the pairs of a chunk: for each how often its context was seen at the nodes of its path, up to where the
    context has only this pair below the node, as the numbers after that are all the same."""
    key, word, n = (np.concatenate([r[c] for r in asked]) for c in ("key", "word", "n"))
    pairs, of, _ = _unique((_unique(key)[1] << np.int64(32)) | word)
    n = np.bincount(of, n, minlength=len(pairs)).astype(np.int64)
    begins = np.ones(len(pairs), bool)
    begins[1:] = np.diff(pairs >> np.int64(32)) != 0
    word = pairs & np.int64((1 << 32) - 1)
    length, start, ways, _ = paths
    at, some, levels, last = start[word], np.arange(len(pairs)), [], np.zeros(len(pairs), np.int64)
    end = at + length[word]
    while True:
        # Pairs of a node stand together; whole nodes are left out, or those who are alone in what they count.
        begin = np.flatnonzero(begins)
        total = np.repeat(np.add.reduceat(n[some], begin), np.diff(np.append(begin, len(some)))) if len(some) else n[:0]
        levels.append((some, total))
        node = np.cumsum(begins)
        go = np.repeat(np.maximum.reduceat((n[some] != total).astype(np.int8), begin), np.diff(np.append(begin, len(some)))) > 0 if len(some) else begins
        last[some] = len(levels) - 1
        some, at, end, node = some[go], at[go], end[go], node[go]
        if not len(some):
            break
        way = ways[at]
        assert (at < end).all()
        begins = np.ones(len(some), bool)
        begins[1:] = (node[1:] != node[:-1]) | (way[1:] != way[:-1])
        at = at + 1
    first = np.cumsum(last + 1) - last - 1
    counts = np.zeros(int((last + 1).sum()), np.int64)
    for depth, (some, total) in enumerate(levels):
        counts[first[some] + depth] = total
    # Of each pair only what is before its number is reached.
    owner = np.repeat(np.arange(len(pairs)), last + 1)
    last -= np.bincount(owner, counts == n[owner], minlength=len(pairs)).astype(np.int64) - 1
    other = np.abs(np.diff(counts, prepend=0))  # what went the other way takes less room
    other[first] = counts[first]
    a, context = 0, pairs >> np.int64(32)
    for r in asked:
        mine = of[a:a + r["m"]]
        a += r["m"]
        if r["block"] >= 0:
            # Nodes that a pair shares with the pair before are given once.
            ends, shared = last[mine], _shared(context, word, paths, mine)
            own = np.maximum(0, ends - shared)
            at, depth = spans(first[mine] + shared + 1, own), spans(shared + 1, own)
            order = np.argsort(np.where(depth, _digits(counts[at - 1]) + 64 * depth, 0).astype(np.int16), kind="stable")
            yield r["block"], r["tag"], r["chunk"], r["m"], packed(ends.astype(np.uint8)), packed(other[at[order]].astype("<u8"))


def _rows(batches):
    """Rows one at a time, as a row may be large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _answers(model):
    """Answers the rows of chunks, sorted by chunk and tag; a task holds one chunk of a tag at a time."""
    names = ["block", "tag", "chunk", "m", "last", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        code, asked = model.value["code"], []

        def done():
            read = [_read(code, r) for r in asked]
            paths = _numbered_ids(code, read)
            rows = list(_answer(paths, read))
            for a in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[a:a + 64]), kinds)], names=names)

        for row in _rows(batches):
            if asked and (asked[0]["chunk"], asked[0]["tag"]) != (row["chunk"], row["tag"]):
                yield from done()
                asked = []
            asked.append(row)
        if asked:
            yield from done()
    return run


def _answered(asked: DataFrame, model, parts: int, chunks: int) -> DataFrame:
    return asked.repartition(max(parts, chunks), "chunk").sortWithinPartitions("chunk", "tag").mapInArrow(_answers(model), _ANSWERED)


def _by_tag(answered: pa.Table) -> dict[int, list]:
    answers: dict[int, list] = {}
    for r in answered.sort_by([("tag", "ascending"), ("chunk", "ascending")]).to_pylist():
        answers.setdefault(r["tag"], []).append((r["m"], r["last"], r["counts"]))
    return answers


# ---- spelling -----------------------------------------------------------------------------------------------------

#: A byte is eight halves of one class.
SPELLING, BYTES = Code(Tree([1]), [256], [0], novel=False), np.arange(256)


def _spell_pairs(words: list[bytes], bits: int):
    owner, byte, two, three = _spelled(words)
    return owner, byte, [Pairs(tag, [before], byte, 1 << 24, before.__getitem__, bits) for tag, before in ((0, two), (1, three))]


def _count_spelling(bits: int, limit: int = 1 << 16):
    """What training words, each once, have of bytes after bytes; they ask for no answer."""
    def run(batches):
        words = []

        def done():
            for pairs in _spell_pairs(words, bits)[2]:
                yield from _asked(pairs.rows(-1, np.ones(len(pairs.of), bool), BYTES))

        for r in _rows(batches):
            for word in _words_of(r, new=False):
                words.append(word)
                if len(words) >= limit:
                    yield from done()
                    words = []
        if words:
            yield from done()
    return run


def _new_words(batches, limit: int = 1 << 14):
    """New words of a range, a row for some of them; its number is the range's with theirs."""
    for r in _rows(batches):
        words = _words_of(r, new=True)
        for serial, a in enumerate(range(0, len(words), limit)):
            yield pa.RecordBatch.from_arrays([pa.array([(r["chunk"] << 32) + serial], pa.int64()), pa.array([pickle.dumps(words[a:a + limit])], pa.binary())],
                                             names=["block", "row"])


def _ask_spelling(bits: int):
    def run(batches):
        for r in _rows(batches):
            for pairs in _spell_pairs(pickle.loads(r["row"]), bits)[2]:
                yield from _asked(pairs.rows(r["block"], np.zeros(len(pairs.of), bool), BYTES))
    return run


def _spelling_scores(bits: int):
    """Log (base 10) of the probability of words given by their bytes; the mixture does not adapt to single words."""
    def run(block, answered):
        words, answers = pickle.loads(block.column("row")[0].as_py()), _by_tag(answered)
        owner, byte, pairs = _spell_pairs(words, bits)
        depth = np.tile(np.arange(8), len(byte))
        bit = ((byte[:, None] >> np.arange(7, -1, -1)) & 1).ravel()
        counts = []
        for p in pairs:
            first, last, values = p.place(answers.get(p.tag, []), SPELLING.paths(BYTES))
            first, last = (np.repeat(x[p.of], 8) for x in (first, last))
            reached, taken = (values[first + np.minimum(d, last)] for d in (depth, depth + 1))
            counts.append(_zeros_ones(reached, taken, bit))
        x, gate = _stretched(np.full(len(bit), 0.5), counts)
        mixed = np.clip(np.einsum("kn,nk->n", x, _START[gate]), -16, 16)
        p = 1 / (1 + np.exp(-mixed))
        score = np.bincount(np.repeat(owner, 8), np.log10(np.where(bit == 1, p, 1 - p)), minlength=len(words))
        return pa.Table.from_arrays([block.column("block"), pa.array([score.astype("<f8").tobytes()], pa.binary())], names=["block", "tails"])
    return run


# ---- mixing -------------------------------------------------------------------------------------------------------

_START = np.array([[[1 - a - b, a, b] for b in (0.0, 0.1, 0.3, 0.4)] for a in (0.0, 0.3, 0.5, 0.6)]).reshape(16, 3)


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _path(tree: Tree, symbol: np.ndarray):
    """Decisions of symbols of a tree: number of the symbol, node, bit."""
    length = tree.length[symbol]
    at = spans(tree.start[symbol], length)
    return np.repeat(np.arange(len(symbol)), length), tree.node[at], tree.bit[at]


def _zeros_ones(reached: np.ndarray, taken: np.ndarray, bit: np.ndarray):
    """How often a context had zeros and ones at decisions, from how often it was there and went the same way."""
    other = reached - taken
    return np.where(bit, other, taken), np.where(bit, taken, other)


def _stretched(chance: np.ndarray, counts) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the three predictors ``(3, n)`` and the gate: how often the two contexts were seen."""
    stretched, gate = [_odds(chance)], np.zeros(len(chance), np.int64)
    p = chance
    for zero, one in counts:
        n = zero + one
        p = np.clip((one + PRIOR * p) / (n + PRIOR), 1e-7, 1 - 1e-7)  # leans on the shorter context
        stretched.append(_odds(p))
        gate = 4 * gate + (n > 0) + (n > 3) + (n > 30)
    return np.array(stretched), gate


def _inputs(chance: np.ndarray, tables: np.ndarray, slots) -> tuple[np.ndarray, np.ndarray]:
    """``_stretched`` with counts from places of tables ``(2, places)``."""
    return _stretched(chance, [(tables[0][slot], tables[1][slot]) for slot in slots])


class Mixer:
    """Weights and the last stage of each of ``n`` documents."""

    def __init__(self, n: int):
        self.weights = np.tile(_START, (n, 1)).T.copy()  # (predictors, documents x gates)
        self.ones, self.all = np.zeros(n * 24), np.zeros(n * 24)

    def cost(self, owner: np.ndarray, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Log (base 10) of the probability of every decision, all by the state before them; then learns from them."""
        sign = 2.0 * bit - 1
        return np.log10(self.step(owner * 16 + gate, owner * 48 + 24 * bit, sign, x * sign))

    def step(self, row: np.ndarray, bin_: np.ndarray, sign: np.ndarray, x) -> np.ndarray:
        """Probabilities of decisions. Log odds ``x`` are those of the way taken, ``sign`` is -1 where that is a zero. ``row``
        is the weights' place and ``bin_`` that of the first bin of the document and bit."""
        mixed = self.weights[0].take(row)
        mixed *= x[0]
        for k in (1, 2):
            more = self.weights[k].take(row)
            more *= x[k]
            mixed += more
        np.minimum(np.maximum(mixed, -16, out=mixed), 16, out=mixed)
        near = mixed * sign  # log odds of a one
        near += 12
        np.minimum(np.maximum(near, 0, out=near), 23, out=near)
        near = near.astype(np.int32) + bin_
        p = np.exp(np.negative(mixed, out=mixed), out=mixed)
        p += 1
        np.divide(1, p, out=p)
        # How often a bin's decisions were zeros, and ones, leans on the mixture.
        hits = np.stack((self.all - self.ones, self.ones)).reshape(2, -1, 24).swapaxes(0, 1).ravel()
        whole = np.repeat(1 / (self.all.reshape(-1, 24) + REFINE), 2, axis=0).ravel()
        last = (REFINE * whole).take(near)
        last *= p
        last += (hits * whole).take(near)
        np.minimum(np.maximum(last, 1e-7, out=last), 1 - 1e-7, out=last)
        last += p
        last *= 0.5
        error, rows = np.subtract(1, p, out=p), self.weights.shape[1]
        size = RATE / np.sqrt(np.maximum(1, np.bincount(row, minlength=rows)))
        for k in range(3):
            self.weights[k] += np.bincount(row, error * x[k], minlength=rows) * size
        new = np.bincount(near, minlength=len(hits)).reshape(-1, 2, 24)
        self.all += new.sum(1).ravel()
        self.ones += new[:, 1].ravel()
        return last


# ---- texts --------------------------------------------------------------------------------------------------------

def _compiled(spark) -> object:
    """Loader of the classes of ``mixing.java``, compiled once for each application; Spark hands them to every executor."""
    context = spark.sparkContext
    if not getattr(context, "_tidekeep_mixing", None):
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data(__package__, "mixing.java").decode())
        archive = os.path.join(tempfile.mkdtemp(prefix="tidekeep-"), "mixing.jar")
        with zipfile.ZipFile(archive, "w") as out:
            for name, code in dict(compiler.getBytecodes()).items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        context._jsc.addJar(archive)
        context._tidekeep_mixing = compiler.getClassLoader()
    return context._tidekeep_mixing


def _kernel(spark, name: str, model, returns: str):
    """A function of ``mixing.java`` on a column of lists of rows."""
    context = spark.sparkContext
    given = context._gateway.new_array(context._jvm.Object, 1)
    given[0] = model
    made = _compiled(spark).loadClass(f"tidekeep.Mixing${name}").getConstructors()[0].newInstance(given)
    function = context._jvm.org.apache.spark.sql.functions.udf(made, context._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return lambda column: Column(function.apply(_to_seq(context, [column], _to_java_column)))


def _model(code: Code, total: int, kinds: int, hot: int, bits: int) -> bytes:
    """What ``mixing.java`` knows of all texts."""
    assert code.start < 1 << 31
    data = struct.pack("<qqqiiii", total, kinds, hot, bits, code.once, len(code.sizes), len(code.tree.chance)) + code.seen.astype("<i8").tobytes()
    for x in (code.sizes, code.leaves, code.by_rank, code.top, code.tree.length, 2 * code.tree.node + code.tree.bit, code.halved):
        data += struct.pack("<i", len(x)) + x.astype("<i4").tobytes()
    return data + struct.pack("<i", len(code.chance)) + code.chance.astype("<f8").tobytes()


def _scored(kind: pa.DataType):
    """Rows of texts from those of blocks."""
    def run(batches):
        for r in _rows(batches):
            head = pickle.loads(memoryview(r["found"])[24 * r["texts"]:])
            found = np.frombuffer(r["found"], "<i8,<f8,<f8", r["texts"])
            score = found["f2"]
            bits_spent = -score / np.log10(2) / np.maximum(1, np.frombuffer(head["bytes"], "<i8"))
            yield pa.RecordBatch.from_arrays([
                pa.array(head["ids"], kind), pa.array(head["held"], pa.bool_()), pa.array(np.frombuffer(head["tokens"], "<i8")),
                *(pa.array(np.ascontiguousarray(x)) for x in (found["f0"], found["f1"], score, bits_spent))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])
    return run


def _chunk_bits(tokens: int) -> int:
    return max(3, (tokens // CHUNK_TOKENS).bit_length())


def scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``; learns from what is not
    held out. An empty text counts as one byte."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(encode_blocks(docs, block_tokens, key, text), "blocks")
    kind = docs.schema[key].dataType
    pieces = blocks.where("pos >= 0")
    chunks = max(parts, pieces.count() * PIECE_WORDS // CHUNK_WORDS)
    many = max(parts, blocks.where("pos < 0").count())
    borders = spark.sparkContext.broadcast(_borders(pieces, chunks))
    ranged = pieces.select("block", "pos", "m", "sizes", "words", "n").mapInArrow(
        _ranged(borders), "chunk int, block long, pos int, m int, sizes binary, words binary, n binary")
    counted = materialize(ranged.groupBy("chunk").applyInArrow(_counted, _COUNTED), "words")
    counts, shares = counted.where("class IS NULL"), counted.where("class <> 0").select("chunk", "class", "seen", "words_of")
    # Fewer than the square root of twice the training tokens.
    classes = {r["class"]: (r["words"], r["c"]) for r in shares.groupBy("class").agg(F.sum("words_of").alias("words"), F.max("seen").alias("c")).collect()}
    end, once = classes.pop(-1, (1, 0))[1], classes.pop(1, (0, 1))[0]
    total = end + once + sum(n * c for n, c in classes.values())
    kinds = (end > 0) + once + sum(n for n, _ in classes.values())
    names = [-1, *sorted(classes, reverse=True), 1]
    code = Code(Tree([end + 1, *(k * classes[k][0] for k in names[1:-1]), 2 * once + 1]),
                [1, *(classes[k][0] for k in names[1:-1]), max(1, once)], [end, *names[1:]])
    model = spark.sparkContext.broadcast({"code": code, "N": total, "V": kinds})

    # New words by their bytes; the share of a chunk is as with tokens.
    spell_bits = _chunk_bits(16 * kinds)
    listed = counts.select("chunk", "m", "sizes", "words", "kind")
    new = materialize(listed.mapInArrow(_new_words, "block long, row binary"), "new")
    asked = listed.mapInArrow(_count_spelling(spell_bits), _ASKED).unionByName(
        new.mapInArrow(_ask_spelling(spell_bits), _ASKED))
    spelling = spark.sparkContext.broadcast({"code": SPELLING})
    spelled = new.groupBy("block").cogroup(_answered(asked, spelling, parts, 1 << spell_bits).groupBy("block")).applyInArrow(
        _spelling_scores(spell_bits), "block long, tails binary")

    # A word's id: where its class begins, the words of the class in the ranges before, and its place. So words of a class
    # are numbered in their order, whatever the ranges.
    begins = spark.createDataFrame([(k, int(x)) for k, x in zip(names, code.first.tolist())], "class long, begin long")
    earlier = Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.withColumn("offset", F.coalesce(F.sum("words_of").over(earlier), F.lit(0))).join(begins, "class").select(
        F.col("chunk").alias("range"), "class", (F.col("begin") + F.col("offset")).alias("offset"))
    told = offsets.unionByName(spelled.select(
        F.shiftright("block", 32).cast("int").alias("range"), F.col("block").alias("serial"), "tails"), allowMissingColumns=True)
    named = counts.select("chunk", "m", "kind", "blocks", "places").groupBy("chunk").cogroup(told.groupBy("range")).applyInArrow(
        _identified(code.new), "block long, row binary")
    whole = blocks.where("pos < 0").select("block", "row").unionByName(named).repartition(many, "block")
    whole = whole.groupBy("block").agg(F.collect_list("row").alias("rows"))

    bits = _chunk_bits(2 * total)
    known = spark.sparkContext._jsc.broadcast(_model(code, total, kinds, hot, bits))
    ask, answer, score = (_kernel(spark, name, known, returns) for name, returns in (
        ("Ask", "array<struct<chunk int, row binary>>"), ("Answer", "array<struct<block bigint, row binary>>"), ("Score", "struct<texts int, found binary>")))
    asked = whole.select(F.explode(ask("rows")).alias("asked")).select("asked.*")
    chunked = asked.repartition(max(parts, 1 << bits), "chunk").groupBy("chunk").agg(F.collect_list("row").alias("rows"))
    answers = chunked.select(F.explode(answer("rows")).alias("answer")).select("answer.*")
    answered = answers.repartition(many, "block").groupBy("block").agg(F.collect_list("row").alias("answers"))
    # Every block has answers; with an inner join its texts would be dealt out twice, for the filter of nulls.
    scored = whole.join(answered, "block", "left").select(score(F.concat("rows", "answers")).alias("scored")).select("scored.*").mapInArrow(
        _scored(to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score", "bits_per_byte")
