"""Connected components of a table of links, by alternating stars (large star, small star).

A hub, a vertex that many links meet, is no hot task: its neighbours' minimum is pre-aggregated and comes back to its
links by broadcast (``join_counted``) once it has more than ``HUB`` of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, materialise


#: Links of a vertex that one task joins.
HUB = 1 << 16


def _stars(edges: DataFrame, large: bool, total: int, hub: int) -> DataFrame:
    """Link each vertex's neighbours (above it if large, else it and those below it) to the smallest of all."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("links")).select("a", F.least("a", "m").alias("m"), "links")
    joined = join_counted(both, least, ["a"], "links", total) if hub > HUB else both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of links(a, b); root is the smallest vertex reachable."""
    edges, seen = materialise(links.where("a <> b").select("a", "b").distinct()), None
    while True:
        ends = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count()
        hub, count = (x or 0 for x in ends.agg(F.max("count"), F.sum("count")).first())
        last, wide = edges, materialise(_stars(edges, True, count, hub))
        edges = materialise(_stars(wide, False, count, hub))
        discard(last), discard(wide)
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(roots)
