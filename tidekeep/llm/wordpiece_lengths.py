"""Counts of word pieces by greedy longest match, in linear time and without building pieces.

The vocabulary is a trie with two roots: pieces that begin a word and pieces that go on. Each node has a failure link:
where the match is when all pieces that must come out of what was read have come out; and the number of those pieces.
A word is read byte by byte; where no branch fits, the count of the node is added and its link is followed. Each byte
is read once and each link shortens what is pending, so a word takes time linear in its length.

A word that cannot be split whole counts as one piece (unknown).

Nulls: a null text is empty and has neither words nor pieces; a null document id is kept. Rows that repeat are counted
each for itself; an empty table gives an empty result. Other columns of the input are not read.
"""

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from tidekeep.llm.base import slices, texts

KNOWN_WORDS = 800_000


class Automaton:
    def __init__(self, initial, continuing):
        self.go: list[dict[int, int]] = [{}, {}]  # 0: root of a word, 1: root of what follows a piece
        self.final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                if piece:
                    self._add(root, piece)
        self.link: list[int] = [-1] * len(self.go)
        self.pops = [0] * len(self.go)
        self._close()

    def _add(self, root: int, piece: bytes):
        node = root
        for byte in piece:
            if byte not in self.go[node]:
                self.go[node][byte] = len(self.go)
                self.go.append({})
                self.final.append(False)
            node = self.go[node][byte]
        self.final[node] = True

    def _close(self):
        """Failure links and counts, level by level."""
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for byte, child in self.go[node].items():
                queue.append(child)
                if self.final[child]:
                    self.link[child], self.pops[child] = 1, 1
                    continue
                at, count = self.link[node], self.pops[node]
                while at >= 0 and byte not in self.go[at]:
                    count += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[child], self.pops[child] = self.go[at][byte], count

    def length(self, word: bytes) -> int:
        """Number of pieces of a word; 1 if it can't be split whole, 0 if it is empty."""
        go, link, pops, node, count = self.go, self.link, self.pops, 0, 0
        for byte in word:
            while byte not in go[node]:
                if link[node] < 0:
                    return 1
                count += pops[node]
                node = link[node]
            node = go[node][byte]
        while node > 1:
            if link[node] < 0:
                return 1
            count += pops[node]
            node = link[node]
        return count


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a rank file: tokens with a leading space begin a word (the space is kept), the others go on."""
    with open(path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines]
    return [t for t in tokens if t[:1] == b" "], [t for t in tokens if t[:1] != b" "]


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(*vocabulary(path))
    return _AUTOMATA[path]


def lengths(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens``: words and their pieces in every text.

    A word is matched with one space before it, as the vocabulary has it. Counts of words seen before are kept, at
    most ``KNOWN_WORDS`` of them.
    """
    source = texts(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine, known = automaton(path), {}
        for batch in slices(batches):
            words = [t.encode().split() for t in batch.column("text").to_pylist()]
            if len(known) > KNOWN_WORDS:
                known.clear()
            for word in {w for line in words for w in line} - known.keys():
                known[word] = machine.length(b" " + word)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(line) for line in words], pa.int64()),
                pa.array([sum(map(known.__getitem__, line)) for line in words], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
