"""Quality rules by the divergence of a document's histograms from its language's.

Two histograms are taken of every text: of character classes (lower case, upper case, symbols, all other characters
of words) and of common words (the function words below, all other words as one). The reference of a language sums
the histograms of all its documents that pass the base rules. The distance is the Jensen-Shannon divergence in bits.

A document is rejected if a base rule fails (fewer than ``MIN_WORDS`` words, or more than half of its words in
repeated windows of three), if the class divergence is over ``CLASS_LIMIT``, or if the word divergence, less what a
sample of its length has by chance, ``(bins - 1) / (8 ln 2 n)``, is over ``WORD_LIMIT + WORD_SLACK / n``; ``bins`` are
the words that make up ``MIN_SHARE`` of the language or more. Guards: the divergences of a language are used only from
``MIN_REFERENCE`` words on; short documents fail the base rule.

Everything is column expressions over a row; only the references, one row for each language, are aggregated. They are
broadcast if there are at most ``FEW`` of them, else joined by language and a salt, so no task gets all texts of one.

Nulls: a null text has no words and fails; a null language is a language of its own; other columns are left alone.
Rows that repeat are judged each for itself. An empty table gives an empty result.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.base import WORD, row_of
from tidekeep.session import materialize

MIN_WORDS, REPEAT_PERCENT, MIN_REFERENCE = 50, 50, 1000
CLASS_LIMIT, WORD_LIMIT, WORD_SLACK, MIN_SHARE = 0.08, 0.05, 1.2, 0.001
FEW, SALTS = 10_000, 64
SYMBOLS = "[#*$%&|<>]"
EDGE = ".,;:!?"

# Common function words of English, German, French and Spanish.
COMMON = sorted(set((
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la le et les des en un du une que pour est par qui dans avec sur pas au "
    "de la que el en y los se del las un por con no su una para es al lo").split()))


def _staged(df: DataFrame, **columns) -> DataFrame:
    for name, column in columns.items():
        df = df.withColumn(name, F.expr(column) if isinstance(column, str) else column)
    return df


def measure(docs: DataFrame, carry=None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``row`` (the columns of ``docs``, or those of ``carry``), ``lang`` and ``quality``: counts, histograms and the
    base verdict of every text."""
    lit = F.lit
    docs = docs.select(row_of(docs, carry).alias("row"), F.col(lang).alias("lang"),
                       F.coalesce(F.col(text), lit("")).alias("_q_text"))
    df = _staged(
        docs,
        _q_words=F.regexp_extract_all("_q_text", lit(WORD), lit(0)),
        _q_lines=F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(WORD)),
        _q_n=F.size("_q_words").cast("long"),
        _q_join=F.array_join("_q_words", ""),
        # Windows of three words by their hashes, then those with an equal neighbour in sorted order.
        _q_hash="slice(transform(_q_words, (w, i) -> xxhash64(w, get(_q_words, i + 1), get(_q_words, i + 2))), 1, "
                "greatest(0, CAST(_q_n AS INT) - 2))",
        _q_sorted="CASE WHEN size(array_distinct(_q_hash)) < size(_q_hash) "
                  "THEN sort_array(transform(_q_hash, (x, i) -> struct(x AS x, i AS i))) END",
        _q_again="filter(transform(_q_sorted, (s, j) -> "
                 "IF(s.x = get(_q_sorted, j - 1).x OR s.x = get(_q_sorted, j + 1).x, s.i, NULL)), p -> p IS NOT NULL)",
        _q_repeat=F.coalesce(F.expr("size(array_distinct(flatten(transform(_q_again, p -> array(p, p + 1, p + 2)))))"),
                             lit(0)).cast("long"),
        _q_low=F.char_length(F.regexp_replace("_q_join", r"\p{Ll}+", "")),
        _q_up=F.char_length(F.regexp_replace("_q_join", r"\p{Lu}+", "")),
        _q_sym=F.char_length(F.regexp_replace("_q_text", SYMBOLS + "+", "")),
        _q_len=F.char_length("_q_join").cast("long"),
    )
    # Common words once more between spaces, so that a word is counted by what its removal saves.
    found = F.filter(F.transform("_q_words", lambda w: F.lower(F.btrim(w, lit(EDGE)))), lambda w: w.isin(COMMON))
    df = _staged(df, _q_common=F.concat(lit(" "), F.array_join(found, "  "), lit(" ")), _q_hits=F.size(found).cast("long"))
    saved = [((F.octet_length("_q_common") - F.octet_length(F.replace("_q_common", lit(f" {w} "))))
              / lit(len(w.encode()) + 2)).cast("long") for w in COMMON]
    low, up = F.col("_q_len") - F.col("_q_low"), F.col("_q_len") - F.col("_q_up")
    symbols = (F.char_length("_q_text") - F.col("_q_sym")).cast("long")
    n, repeat = F.col("_q_n"), F.col("_q_repeat")
    return df.select("row", "lang", F.struct(
        n.alias("n_words"), F.col("_q_len").alias("word_chars"), symbols.alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n)).alias("base_failed"),
        F.array(low, up, symbols, F.col("_q_len") - low - up - symbols).alias("classes"),
        F.array(*saved, n - F.col("_q_hits")).alias("words"),
    ).alias("quality"))


def references(measured: DataFrame) -> DataFrame:
    """``_lang, _n, _bins, _classes, _words``: shares of all documents of a language that pass the base rules, written
    out, as each of its few rows is used by all tasks."""
    good = measured.where(~F.col("quality.base_failed")).select(
        F.col("lang").alias("_lang"), F.posexplode(F.concat("quality.classes", "quality.words")).alias("at", "n"))
    sums = good.groupBy("_lang", "at").agg(F.sum("n").alias("n"))
    lists = sums.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).getField("n").alias("n"))
    parts = lists.select("_lang", F.slice("n", 1, 4).alias("c"), F.slice("n", 5, len(COMMON) + 1).alias("w"))
    parts = parts.select("_lang", "c", "w", *[F.aggregate(x, F.lit(0).cast("long"), lambda a, x: a + x).alias(f"n{x}") for x in "cw"])
    shares = parts.select("_lang", F.col("nw").alias("_n"), F.transform("c", lambda x: x / F.col("nc")).alias("_classes"),
                          F.transform("w", lambda x: x / F.col("nw")).alias("_words"))
    return materialize(shares.withColumn("_bins", F.size(F.filter("_words", lambda x: x >= MIN_SHARE))), "references")


def _log2_share(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def divergence(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon divergence of a histogram, whose counts add up to ``total``, from a reference, in bits; 0 for an
    empty histogram."""
    terms = F.zip_with(counts, shares, lambda c, q: (
        _log2_share(c / total, (c / total + q) / 2) + _log2_share(q, (c / total + q) / 2)) / 2)
    return F.when(total > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def _beside(measured: DataFrame, refs: DataFrame, few: int) -> DataFrame:
    """Each document with its language's reference; nulls are a language."""
    if refs.count() <= few:
        return measured.join(F.broadcast(refs), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    salted = refs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("quality"), F.lit(SALTS)).cast("int")
    return measured.join(salted, F.col("lang").eqNullSafe(F.col("_lang")) & (salt == F.col("_salt")), "left").drop("_salt")


def judge(measured: DataFrame, refs: DataFrame, few: int = FEW) -> DataFrame:
    """Adds ``class_divergence``, ``word_divergence`` (null if not judged) and ``kept``."""
    judged = (~F.col("quality.base_failed")) & (F.col("_n") >= MIN_REFERENCE)
    n = F.col("quality.n_words")
    chance = (F.col("_bins") - 1) / (8 * math.log(2)) / n
    df = _beside(measured, refs, few)
    by_class = divergence(F.col("quality.classes"), F.col("quality.word_chars"), F.col("_classes"))
    df = df.withColumn("class_divergence", F.when(judged, by_class))
    df = df.withColumn("word_divergence", F.when(judged, divergence(F.col("quality.words"), n, F.col("_words"))))
    far = (F.col("class_divergence") > CLASS_LIMIT) | (F.col("word_divergence") - chance > WORD_LIMIT + WORD_SLACK / n)
    kept = ~F.col("quality.base_failed") & ~F.coalesce(far, F.lit(False))
    return df.withColumn("kept", kept).drop("_lang", "_n", "_bins", "_classes", "_words")
