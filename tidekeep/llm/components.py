"""Connected components of a graph that is a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node of its component.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest neighbour,
    then its smaller ones are. Neighbourhoods are only reduced by ``min`` and by a join with one row for each node, so
    a node with very many links is no group that a task must hold. Each round is written to the shared folder.
    """
    now = materialize(_ordered(links), "links")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(_ordered(large), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                              F.col("m").alias("b"))
        small = materialize(_ordered(small), "links")
        # Done when every node has one link and no root has one: the links then are stars.
        open_ = small.join(small.select(F.col("a").alias("b")), "b", "left_semi").limit(1) \
            .union(small.groupBy("a").count().where("count > 1").select("a", "count").limit(1))
        if open_.isEmpty():
            roots = small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        now = small


def _ordered(links: DataFrame) -> DataFrame:
    """Larger node first, no loops, no repeats."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
