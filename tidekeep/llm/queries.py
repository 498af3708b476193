"""Queries of the operators in this folder, with the parameters they run with, and their DuckDB texts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekeep.llm import (bottomk, context_mixing, divergence, dom_boosting, feast_whitening, harmonic_packing, oracle,
                          periodic_runs, repair_ids, simhash_grid, tiktoken_codec, tree_concat, winnowing,
                          wordpiece_lengths)
from tidekeep.llm.base import prepare
from tidekeep.session import configure, materialize


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ready(spark: SparkSession) -> SparkSession:
    return prepare(configure(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    cut = harmonic_packing.pieces(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return harmonic_packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op2_repair_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = repair_ids.shard_folder(spark)
    repair_ids.write_shards(docs, folder, tokenizer_file("byte_bpe_50k.json"), end_id=0, vocabulary=50_257)
    return repair_ids.read_shards(spark, folder)


def op3_tiktoken_codec(spark, sf_dir):
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = tiktoken_codec.encode(table(spark, sf_dir, "documents"), path, pattern)
    return tiktoken_codec.digests(tiktoken_codec.decode(encoded, path, pattern))


def op4_divergence(spark, sf_dir):
    measured = materialize(divergence.measure(table(spark, sf_dir, "documents"), ["doc_id"]), "measures")
    judged = divergence.judge(measured, divergence.references(measured))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("row.doc_id", *[f"quality.{c}" for c in counts], "kept")


def op5_winnowing(spark, sf_dir):
    found = winnowing.drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "text", "n_lines", "n_deleted")


def op6_bottomk(spark, sf_dir):
    return bottomk.with_next(table(spark, sf_dir, "documents"))


def op7_dom_boosting(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return dom_boosting.extract(pages, dom_boosting.fit(pages))


def op8_simhash_grid(spark, sf_dir):
    found = simhash_grid.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_wordpiece_lengths(spark, sf_dir):
    return wordpiece_lengths.lengths(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op10_context_mixing(spark, sf_dir):
    return context_mixing.scores(table(spark, sf_dir, "documents"))


def op11_tree_concat(spark, sf_dir):
    path = tokenizer_file("word_bpe_49k.json")
    encoded = tree_concat.encode(table(spark, sf_dir, "documents"), path)
    return tree_concat.digests(tree_concat.decode(encoded, path))


def op12_periodic_runs(spark, sf_dir):
    docs = periodic_runs.planted(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.find(docs))


def op13_feast_whitening(spark, sf_dir):
    return feast_whitening.by_component(feast_whitening.whiten(table(spark, sf_dir, "embeddings")))


def quality_stage(docs: DataFrame) -> DataFrame:
    """Documents the quality rules keep, with all their columns."""
    measured = materialize(divergence.measure(docs), "measured")
    return divergence.judge(measured, divergence.references(measured)).where("kept").select("row.*")


def line_stage(docs: DataFrame) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; ``n_chars`` follows the text."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return winnowing.drop_repeated_runs(docs).select(*[
        (new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_stage(docs: DataFrame) -> DataFrame:
    """The first document of each group of near copies by op8's rule: four-word shingles, four bits."""
    return simhash_grid.first_of_each(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
