"""Byte-level BPE by the tiktoken library with a local file of ranks.

Long texts are cut at safe spaces (between two characters that are no white space), where every match of the pattern
ends, so the ids are those of the whole text. Decoding joins the raw bytes of the ids, so no character is lost even
where an id holds part of one.

Nulls: a null text is empty and has no ids; a null document id is kept. Rows that repeat are encoded each for itself;
an empty table gives an empty result. Other columns of the input are not read.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.base import SAFE_SPACE, slices, texts

LONG = 50_000


def load(path: str, pattern: str):
    """The encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_LOADED: dict = {}


def encoding(path: str, pattern: str):
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = load(path, pattern)
    return _LOADED[path, pattern]


def parts(text: str, size: int = LONG) -> list[str]:
    """Cuts a text at safe spaces, after ``size`` characters or later; a text without such a space stays whole."""
    out, at = [], 0
    while len(text) - at > size and (space := SAFE_SPACE.search(text, at + size)):
        out.append(text[at:space.start()])
        at = space.start()
    return [*out, text[at:]]


def encode_text(coder, text: str) -> list[int]:
    return [i for part in parts(text) for i in coder.encode_ordinary(part)]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` with little-endian unsigned 32-bit ids."""
    source = texts(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = encoding(path, pattern)
        for batch in slices(batches):
            ids = [np.array(encode_text(coder, t), "<u4") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of the ids, to the rows of ``encode``."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = encoding(path, pattern)
        for batch in slices(batches, "ids"):
            raw = [coder.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")),
                                              pa.array(raw, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
