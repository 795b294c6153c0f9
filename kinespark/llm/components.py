"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node of its component.

    Each round hangs every node's neighbours on the smallest of them; the rounds grow as the logarithm of the longest
    path. All steps are joins and combined minima; a round's links go to the shared folder and replace the last one's.
    """
    edges = cut(_ordered(links.select("a", "b")), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        later = cut(_ordered(small.union(least)), "links")
        discard(edges)
        edges = later
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node; none to itself."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
