"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.shared import cut


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(r)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    Each round does a large star (every node hands its larger neighbours to the
    smallest one) and a small star, both as a min aggregate, which combines
    before the shuffle, and a join that may split a hub; rounds grow with the
    logarithm of the longest path.  No neighbour list is ever collected.
    Self links and nulls are left out.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct(), "stars")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
