"""Token ids in shard files, compressed by a grammar in the manner of Re-Pair.

Documents are sorted by id, encoded and gathered into shards of about a million ids. In each shard frequent pairs of
neighbouring symbols are replaced by new symbols (rules), round after round; all pairs that occur often enough are
replaced in one round, each counted exactly. Pairs never reach over the end of a document, so a document is a span of
symbols and can be decoded by itself: rules carry the length of their expansion, documents their symbols and ids.

A shard is one row of a Parquet file:
``shard`` (position in the order of ids: task, then number in the task), ``doc_ids``, ``symbols`` (compressed
documents, three bytes for each symbol: all low halves as unsigned 16 bit, then all high bytes), ``ends`` (symbols up
to the end of each document), ``lengths`` (ids of each document), ``left``/``right`` (rules), ``expansion`` (ids that a
rule stands for), ``vocabulary`` (smallest rule symbol), ``n_tokens``.

Nulls: a null text is empty (only its end id is stored); null document ids come first. Rows with equal ids are ordered
by their texts. An empty table gives no shard. Other columns of the input are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidekeep.llm.base import crc_of_spans, encoder, slices, spans, texts
from tidekeep.session import work_path

SHARD_IDS, ROUNDS, MIN_COUNT, SLOT_BITS = 1 << 20, 6, 12, 18
#: Chunks that a worker's encoder remembers; an executor of the check tool takes 2314 MB with it, 1618 MB at the default.
REMEMBERED = 800_000


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, rounds: int = ROUNDS, min_count: int = MIN_COUNT):
    """``(symbols, ends, left, right)``: ``ends`` marks the last symbol of each document.

    Pairs are counted in hashed slots; a slot speaks for one of its pairs, whose count is then exact. Two frequent
    pairs in one slot are served in different rounds.
    """
    seq, ends = ids.astype(np.int64), ends.copy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    symbol, slots = vocabulary, 1 << SLOT_BITS
    for turn in range(rounds):
        key = seq[:-1] << 32
        key |= seq[1:]
        # A multiplier for each round, as pairs that meet under one would meet again after any shift of it.
        factor = (0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED02) % (1 << 64)
        slot = key * np.uint64(factor).astype(np.int64)
        slot >>= 40
        slot &= slots - 1
        slot[np.flatnonzero(ends[:-1])] = slots  # a slot of their own for pairs that reach over an end
        often = np.bincount(slot, minlength=slots + 1) >= min_count
        often[slots] = False
        at = np.flatnonzero(often[slot])
        if not len(at):
            break
        key, slot = key[at], slot[at]
        chosen = np.zeros(slots, np.int64)
        chosen[slot[::-1]] = key[::-1]  # the first pair seen speaks for the slot
        same = np.flatnonzero(chosen[slot] == key)
        at, slot = at[same], slot[same]
        frequent = np.bincount(slot, minlength=slots) >= min_count
        found = np.flatnonzero(frequent[slot])
        at, slot = at[found], slot[found]
        if not len(at):  # rare pairs speak for all slots; in the next round others do
            continue
        # Of pairs that overlap in a run, every second one is replaced.
        place = np.arange(len(at))
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        take = np.flatnonzero(((place - np.repeat(starts, np.diff(starts, append=len(at)))) & 1) == 0)
        at, slot = at[take], slot[take]
        used = np.flatnonzero(np.bincount(slot, minlength=slots) >= 2)
        name = np.full(slots, -1)
        name[used] = symbol + np.arange(len(used))
        names = name[slot]
        named = np.flatnonzero(names >= 0)
        at, names = at[named], names[named]
        left.append(chosen[used] >> 32)
        right.append(chosen[used] & 0xFFFFFFFF)
        symbol += len(used)
        seq[at] = names
        ends[at] = ends[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        seq, ends = seq[keep], ends[keep]
    return seq, ends, np.concatenate(left), np.concatenate(right)


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    """Replaces rule symbols by their pairs until only ids are left; a rule only uses earlier symbols."""
    while True:
        rule = symbols >= vocabulary
        if not rule.any():
            return symbols
        at = np.cumsum(rule + 1) - (rule + 1)
        out = np.empty(len(symbols) + int(rule.sum()), np.int64)
        out[at] = np.where(rule, left[np.where(rule, symbols - vocabulary, 0)] if len(left) else 0, symbols)
        out[at[rule] + 1] = right[symbols[rule] - vocabulary]
        symbols = out


def expansions(left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids every rule stands for."""
    if not len(left):
        return np.zeros(0, np.int64)
    done = np.zeros(len(left), np.int64)
    while (done == 0).any():
        a = np.where(left < vocabulary, 1, done[np.maximum(left - vocabulary, 0)])
        b = np.where(right < vocabulary, 1, done[np.maximum(right - vocabulary, 0)])
        done = np.where((a > 0) & (b > 0), a + b, 0)
    return done


def _planes(symbols: np.ndarray) -> bytes:
    assert not len(symbols) or symbols.max() < 1 << 24
    return (symbols & 0xFFFF).astype("<u2").tobytes() + (symbols >> 16).astype(np.uint8).tobytes()


def _symbols(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // 3
    return raw[:2 * n].view("<u2").astype(np.int64) | (raw[2 * n:].astype(np.int64) << 16)


def _shard_type(kind: T.DataType) -> T.StructType:
    fields = [("task", T.IntegerType()), ("number", T.LongType()), ("doc_ids", T.ArrayType(kind)), ("symbols", T.BinaryType()),
              ("ends", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.LongType())), ("rule_left", T.BinaryType()),
              ("rule_right", T.BinaryType()), ("expansion", T.BinaryType()), ("vocabulary", T.LongType()), ("n_tokens", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def write_shards(docs: DataFrame, out: str, path: str, end_id: int, vocabulary: int, shard_ids: int = SHARD_IDS,
                 key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents, ``end_id`` after each, in ascending order of ids below folder ``out``."""
    source = texts(docs, key, text)
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = _shard_type(source.schema["doc_id"].dataType)

    def shard(number, ids, sizes, doc_ids, arrow):
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        symbols, ends, left, right = compress(ids, last, vocabulary)
        values = [TaskContext.get().partitionId(), number, doc_ids, _planes(symbols), (np.flatnonzero(ends) + 1).tolist(),
                  sizes.tolist(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(),
                  expansions(left, right, vocabulary).astype("<u4").tobytes(), vocabulary, len(ids)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, number, held = to_arrow_schema(schema), 0, []
        for batch in slices(batches):
            ids, bounds = encoder(path, REMEMBERED).encode(batch.column("text").to_pylist(), end_id)
            held.append((ids, np.diff(bounds), batch.column("doc_id").to_pylist()))
            if sum(len(x) for x, _, _ in held) >= shard_ids:
                a, b, c = zip(*held)
                yield shard(number, np.concatenate(a), np.concatenate(b), [i for x in c for i in x], arrow)
                number, held = number + 1, []
        if held:
            a, b, c = zip(*held)
            yield shard(number, np.concatenate(a), np.concatenate(b), [i for x in c for i in x], arrow)

    source.mapInArrow(run, schema).write.parquet(out)


def decode_document(shard, index: int) -> np.ndarray:
    """Ids of one document of a shard row, without touching the others."""
    ends = [0, *shard["ends"]]
    symbols = _symbols(shard["symbols"])[ends[index]:ends[index + 1]]
    left, right = (np.frombuffer(shard[c], "<u4").astype(np.int64) for c in ("rule_left", "rule_right"))
    return expand(symbols, left, right, shard["vocabulary"])


def locate(shard, index: int, position: int) -> int:
    """Id at ``position`` of a document: descends the rules by the lengths of their expansions."""
    ends = [0, *shard["ends"]]
    symbols = _symbols(shard["symbols"])[ends[index]:ends[index + 1]]
    left, right, size = (np.frombuffer(shard[c], "<u4").astype(np.int64) for c in ("rule_left", "rule_right", "expansion"))
    first = shard["vocabulary"]
    widths = np.where(symbols < first, 1, size[np.maximum(symbols - first, 0)] if len(size) else 1)
    at = int(np.searchsorted(np.cumsum(widths), position, side="right"))
    position -= int(widths[:at].sum())
    symbol = int(symbols[at])
    while symbol >= first:
        a, b = int(left[symbol - first]), int(right[symbol - first])
        width = 1 if a < first else int(size[a - first])
        symbol, position = (a, position) if position < width else (b, position - width)
    return symbol


def _decode(row) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a shard and the bounds of its documents: each rule is expanded once, then copied where it stands."""
    first, symbols = row["vocabulary"], _symbols(row["symbols"])
    left, right, size = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("rule_left", "rule_right", "expansion"))
    rules = expand(np.arange(first, first + len(left)), left, right, first)
    at = np.cumsum(size) - size
    rule = symbols >= first
    table = np.concatenate((rules, symbols[~rule]))  # plain symbols stand behind the rules
    start, width = np.empty(len(symbols), np.int64), np.ones(len(symbols), np.int64)
    start[~rule] = len(rules) + np.arange(int((~rule).sum()))
    start[rule], width[rule] = at[symbols[rule] - first], size[symbols[rule] - first]
    return table[spans(start, width)].astype(np.uint32), np.concatenate(([0], np.cumsum(row["lengths"])))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Decodes all shards: ``doc_id, start, n_tokens, ids_crc32`` in the order of the files."""
    rows = spark.read.parquet(folder)
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    # Where a shard begins: totals of the tasks before it, then of the shards before it in its task.
    sizes = rows.select("task", "number", "n_tokens")
    tasks = sizes.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("number")) - F.col("n_tokens")
    begins = sizes.select("task", "number", inside.alias("inside")).join(tasks, "task") \
        .select("task", "number", (F.col("base") + F.col("inside")).alias("begin"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, bounds = _decode(row)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["task"]] * len(row["doc_ids"]), pa.int32()),
                    pa.array([row["number"]] * len(row["doc_ids"]), pa.int64()),
                    pa.array(row["doc_ids"], batch.column("doc_ids").type.value_type), pa.array(bounds[:-1]),
                    pa.array(np.diff(bounds)), pa.array(crc_of_spans(ids, bounds), pa.int64()),
                ], names=["task", "number", "doc_id", "at", "n_tokens", "ids_crc32"])

    decoded = rows.mapInArrow(run, f"task int, number long, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return decoded.join(begins, ["task", "number"]) \
        .select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def shard_folder(spark: SparkSession) -> str:
    return work_path(spark, "token-shards")
