"""Connected components of a table of links, by alternating stars.

Each round is two groupings with partial aggregation and two joins.  A node with very
many links is met by broadcast (:func:`tempolin.llm.common.spread_join`), so no task gets
them all.  The links of a round are written to the shared folder and those of the round
before deleted; the rounds end when they no longer change, after about the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, spread_join


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b); root is the component's least node.

    The root itself has a row too.  Null ends and links to oneself are left out.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    now = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = spread_join(both, least, "u", 2 * now[0])
        large = cut(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = spread_join(large, least, "u", now[0])
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        following = cut(small.distinct(), "links")
        before, now = now, _mark(following)
        discard(edges)
        discard(large)
        edges = following
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the links: one row."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
