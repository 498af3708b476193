"""Trees of digests over part files: one digest for a database, and the broken part where two trees differ.

A leaf is a file with the digest of its bytes. Files of a table hang below buckets (by a hash of their name), buckets
below tables, tables below the database; an inner digest is taken over its children's ``name:digest`` lines in name
order. A bucket holds a part of a table's files, so no group of rows grows with the whole table.
"""

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1024
LEVELS = ["table_name", "bucket", "part"]


def bucket_of(part, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(buckets)).cast("int")


def _folded(children: DataFrame, keys: list[str], name: str) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.concat_ws(":", F.col(name).cast("string"), "digest")))
    return children.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def digest_tree(leaves: DataFrame, keys=("host", "run_id", "db"), buckets: int = BUCKETS) -> list[DataFrame]:
    """Digests from the leaves up: files, buckets, tables, database; each has the keys of its level and ``digest``.

    ``leaves`` has the keys, table_name, part (name of a file) and sha256.
    """
    keys = list(keys)
    files = leaves.select(*keys, "table_name", bucket_of("part", buckets).alias("bucket"), "part", F.col("sha256").alias("digest"))
    tree = [files]
    for depth in (2, 1, 0):
        tree.append(_folded(tree[-1], [*keys, *LEVELS[:depth]], LEVELS[depth]))
    return tree


def root_digests(leaves: DataFrame, keys=("host", "run_id", "db")) -> DataFrame:
    """One digest for each database: (keys, digest)."""
    return digest_tree(leaves, keys)[-1]


def broken_parts(recorded: DataFrame, found: DataFrame, keys=("host", "run_id", "db")) -> DataFrame:
    """Parts that differ: (keys, table_name, part, fault), where fault is missing, changed or unexpected.

    Goes down the two trees together and leaves every branch whose digests agree, so only the buckets of broken parts
    are compared file by file.
    """
    keys = list(keys)
    left, right = digest_tree(recorded, keys), digest_tree(found, keys)
    open_ = None
    for depth in (0, 1, 2, 3):
        names = [*keys, *LEVELS[:depth]]
        a, b = (tree[3 - depth].select(*names, F.col("digest").alias(side)) for tree, side in ((left, "_a"), (right, "_b")))
        if open_ is not None:
            above = [*keys, *LEVELS[:depth - 1]]
            a, b = a.join(open_, above, "left_semi"), b.join(open_, above, "left_semi")
        both = a.join(b, names, "full_outer")
        open_ = both.where(~F.col("_a").eqNullSafe(F.col("_b")))
        if depth < 3:
            open_ = open_.select(*names)
    fault = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").otherwise("changed")
    return open_.select(*keys, "table_name", "part", fault.alias("fault"))
