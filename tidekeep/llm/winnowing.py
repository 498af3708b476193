"""Line dedup by winnowing over line hashes.

The units are lines with a word. A window starts at a line and takes lines until it has ``t`` words or more, so a
run of ``t`` words that two places share holds the same windows in both. Of each window the smallest line hash is its
fingerprint: wherever a run of ``t`` words recurs, so does the fingerprint of its first window, which is the guarantee
of winnowing. Fingerprints that stand at one place only are dropped first; the windows of the others are joined by
fingerprint and content to the first place that has them. A match is then extended to the right, line by line, as
long as the ``t`` words that end with the line have an earlier place too (to the left the windows that begin earlier
extend it). What remains is: a line is deleted if it lies in a run of lines of ``t`` words or more that stands at
an earlier place, in the order of document ids, then lines. A run may repeat itself: of a line that fills a page the
first lines with ``t`` words stay. Lines without a word are not deleted and do not part a run.

No group is gathered: a window is known by its content's hash, whose first place is a minimum.

Nulls: a null text has no lines with a word and stays null; null document ids come last. Rows that repeat an id and a
text are one document and get the same result; rows that share an id only are ordered by the hash of their texts. An
empty table gives an empty result. Other columns of the input are left alone.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidekeep.llm.base import WORD, row_of
from tidekeep.session import materialize

WORDS = 50
_DOC = ["_id", "_content"]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_id, _content, pos, h, n, s, total``: hashed lines with their words, the words before them and in all."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(plain).alias("_content"), F.split(plain, "\n").alias("lines"))
    marked = rows.select(*_DOC, F.filter(F.transform("lines", lambda x, i: F.struct(
        i.alias("pos"), F.xxhash64(x).alias("h"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("n"))),
        lambda x: x["n"] > 0).alias("lines"))
    once = marked.groupBy(*_DOC).agg(F.first("lines").alias("lines"))
    flat = once.select(*_DOC, F.inline("lines"))
    doc = Window.partitionBy(*_DOC)
    before = F.sum("n").over(doc.orderBy("pos")) - F.col("n")
    return flat.select("*", before.alias("s"), F.sum("n").over(doc).alias("total"))


def windows(docs: DataFrame, t: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every line the window that starts with it (``mark``: its fingerprint, ``same``: its content, ``last``) and
    the one that ends with it (``left_same``, ``first``); null where the document has too few words."""
    lines = _lines(docs, key, text).withColumn("e", F.col("s") + F.col("n"))
    doc = Window.partitionBy(*_DOC)
    ahead, behind = doc.orderBy("s").rangeBetween(0, t - 1), doc.orderBy("e").rangeBetween(1 - t, 0)
    full, full_left = F.col("total") - F.col("s") >= t, F.col("e") >= t
    return lines.select(
        *_DOC, "pos", F.when(full, F.min("h").over(ahead)).alias("mark"),
        F.when(full, F.xxhash64(F.collect_list("h").over(ahead))).alias("same"), F.max("pos").over(ahead).alias("last"),
        F.when(full_left, F.xxhash64(F.collect_list("h").over(behind))).alias("left_same"),
        F.min("pos").over(behind).alias("first"))


def deleted_lines(docs: DataFrame, t: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _content, deleted``: positions from the first to the last line of every run to delete, for documents that
    have any; lines without a word between them are among these."""
    place = F.struct(F.col("_id").isNull().alias("missing"), "_id", "_content", "pos")
    rows = materialize(windows(docs, t, key, text).withColumn("place", place), "windows")
    starts = rows.where("same IS NOT NULL")
    # A fingerprint is repeated if its windows start in two documents or their contents differ or recur.
    often = starts.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    found = starts.join(often, "mark", "left_semi").select("mark", "same", "place", "last")
    firsts = found.groupBy("mark", "same").agg(F.min("place").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    matched = materialize(found.join(firsts.select("mark", "same", "origin"), ["mark", "same"]).select(
        "place._id", "place._content", "place.pos", "last", (F.col("place") > F.col("origin")).alias("later")), "matches")
    # To the right: windows that end with a line and start where a repeated window starts.
    begun = matched.select(F.col("_id").alias("_m"), F.col("_content").alias("_c"), F.col("pos").alias("_p"))
    ends = rows.where("left_same IS NOT NULL").join(
        begun, F.col("_id").eqNullSafe(F.col("_m")) & (F.col("_content") == F.col("_c")) & (F.col("first") == F.col("_p")),
        "left_semi").select("left_same", "place")
    origin = ends.groupBy("left_same").agg(F.min("place").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    extended = ends.join(origin.select("left_same", "origin"), "left_same").where("place > origin") \
        .select("place._id", "place._content", "place.pos")
    # Lines a later window covers: those up to the farthest end of the windows that start before or at them.
    reach = matched.where("later").select(*_DOC, "pos", "last")
    touched = reach.select(*_DOC, "pos", F.col("last").alias("reach")) \
        .unionByName(extended.select(*_DOC, "pos", F.col("pos").alias("reach")))
    order = Window.partitionBy(*_DOC).orderBy("pos", "reach")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.coalesce(before, F.lit(-1)) < F.col("pos"), 1).otherwise(0)).over(order)
    spans = touched.select(*_DOC, "pos", "reach", island.alias("island")).groupBy(*_DOC, "island") \
        .agg(F.min("pos").alias("a"), F.max("reach").alias("b"))
    # At most a position for each line of the document.
    return spans.groupBy(*_DOC).agg(F.flatten(F.collect_list(F.sequence("a", "b"))).alias("deleted"))


def drop_repeated_runs(docs: DataFrame, t: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``), ``text`` without the later copies of repeated runs, ``n_lines`` (of the text
    as it was) and ``n_deleted``."""
    gone = deleted_lines(docs, t, key, text)
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(row_of(docs).alias("row"), F.col(key).alias("_key"), F.xxhash64(plain).alias("_hash"),
                       F.col(text).alias("_text"), F.split(plain, "\n").alias("_lines"))
    joined = rows.join(gone, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_content")), "left")
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    blank = F.filter(every, lambda i: ~F.get("_lines", i).rlike(WORD))
    joined = joined.withColumn("_gone", F.coalesce(F.array_except("deleted", blank), F.array().cast("array<int>")))
    left = F.array_join(F.transform(F.array_except(every, F.col("_gone")), lambda i: F.get("_lines", i)), "\n")
    return joined.select("row", F.when(F.size("_gone") == 0, F.col("_text")).otherwise(left).alias("text"),
                         F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_deleted"))
