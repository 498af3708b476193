"""SHA-256 over the ordered lines of a group, for groups of any size.

A digest is sequential, so the last step of a group runs in one task. All
that can be shared out is: a range partitioning sorts the lines of every
group over all tasks and joins them to blocks of about one MiB; the last step
streams the blocks through the digest and never holds the group.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

BLOCK_CHARS = 1 << 20


def ordered_sha256(lines: DataFrame, keys: list[str], order: list[str], line: str, out: str) -> DataFrame:
    """One row per key: digest of its lines, joined by line feeds, in the given order.

    Keys are compared as text; NULL is a key of its own.
    """
    def batch(fields):
        names, arrays = zip(*fields)
        return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in arrays], names=list(names))

    def named(key):
        return [(k, (value, pa.string())) for k, value in zip(keys, key)]

    def pack(batches):
        part, seq, key, texts, size = TaskContext.get().partitionId(), 0, None, [], 0

        def block():
            return batch(named(key) + [("_part", (part, pa.int32())), ("_seq", (seq, pa.int64())),
                                       ("_text", ("\n".join(texts), pa.string()))])

        for rows in batches:
            row_keys = zip(*[rows.column(i).to_pylist() for i in range(len(keys))])
            for row_key, text in zip(row_keys, rows.column(len(keys)).to_pylist()):
                if texts and (row_key != key or size > BLOCK_CHARS):
                    yield block()
                    seq, texts, size = seq + 1, [], 0
                key, size = row_key, size + len(text)
                texts.append(text)
        if texts:
            yield block()

    def digest(batches):
        key, sha = None, None

        def result():
            return batch(named(key) + [(out, (sha.hexdigest(), pa.string()))])

        for rows in batches:
            row_keys = zip(*[rows.column(i).to_pylist() for i in range(len(keys))])
            for row_key, text in zip(row_keys, rows.column(len(keys)).to_pylist()):
                if sha is not None and row_key == key:
                    sha.update(b"\n")
                else:
                    if sha is not None:
                        yield result()
                    key, sha = row_key, hashlib.sha256()
                sha.update(text.encode())
        if sha is not None:
            yield result()

    text_keys = [F.col(k).cast("string").alias(k) for k in keys]
    key_schema = ", ".join(f"`{k}` string" for k in keys)
    spread = lines.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    blocks = spread.select(*text_keys, F.col(line)).mapInArrow(
        pack, f"{key_schema}, _part int, _seq bigint, _text string")
    in_order = blocks.repartition(*keys).sortWithinPartitions(*keys, "_part", "_seq")
    return in_order.select(*keys, "_text").mapInArrow(digest, f"{key_schema}, `{out}` string")
