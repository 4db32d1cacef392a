"""Health of a code graph: hubs, bridges, dead code, cycles, large symbols, untested hot spots."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, functions as F

from weftgraph.operators.edges import degrees
from weftgraph.operators.traverse import frontier
from weftgraph.storage import cut


def sure(edges: DataFrame, least: float = 0.5) -> DataFrame:
    return edges.where(F.coalesce("confidence", F.lit(1.0)) >= least).where("src <> dst").select("src", "dst").distinct()


def hubs(symbols: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    d = degrees(sure(edges)).withColumn("degree", F.col("fan_in") + F.col("fan_out"))
    return d.join(symbols.where("NOT is_test").select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(limit)


def dead_code(symbols: DataFrame, *inbound: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Functions outside tests that no edge of any given table leads to, by symbol id in the column dst."""
    rows = symbols.where("label = 'Function' AND NOT is_test").where(~F.col("name").rlike("^__.*__$") & ~F.col("name").isin(list(known)))
    parts = F.size(F.split("qname", "::"))
    rows = rows.where((parts < 3) | F.startswith("name", F.lit("_")))
    for edges in inbound:
        rows = rows.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return rows


def mentioned_once(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Symbols whose name stands at most once as an identifier in all sources (text)."""
    words = sources.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    return symbols.join(words.where("_n > 1"), "name", "left_anti")


def large(symbols: DataFrame, limit: int, lines: int = 60) -> DataFrame:
    rows = symbols.withColumn("lines", F.col("line_end") - F.col("line_start") + 1)
    return rows.orderBy(F.desc("lines"), "id").limit(limit).where(F.col("lines") >= lines)


def untested(symbols: DataFrame, edges: DataFrame, ranks: DataFrame, tests: DataFrame, limit: int, share: float = 0.1, hops: int = 3) -> DataFrame:
    """(id, pagerank): top ranked functions outside tests that no test reaches within hops calls, nor by a TESTS edge."""
    rows = symbols.where("label = 'Function' AND NOT is_test").join(ranks, "id")
    n = rows.count()
    top = rows.orderBy(F.desc("pagerank"), "id").limit(max(4 * limit, int(n * share))).select("id", "pagerank")
    walk = frontier(symbols.where("is_test").select(F.lit(0).alias("seed"), "id"), sure(edges), hops)
    covered = walk.select("id").unionByName(tests.select(F.col("dst").alias("id"))).distinct()
    return top.join(covered, "id", "left_anti").orderBy(F.desc("pagerank"), "id").limit(limit)


def betweenness(edges: DataFrame, *, samples: int | None = None, seed: int = 7) -> DataFrame:
    """(id, betweenness) on the undirected graph, normalised by (n - 1)(n - 2).

    Brandes by level: path counts grow outwards and dependencies fold back, for
    all sources at once.  With samples, that many sources stand for all.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = cut(both, "both-ways")
    nodes = both.select(F.col("src").alias("id")).distinct()
    n = nodes.count()
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    sources, scale = nodes, 1.0
    if samples is not None and samples < n:
        # sampled by rank of the id; at most `samples` numbers reach the executors
        from weftgraph.operators.rank import global_row_number

        chosen = [k + 1 for k in random.Random(seed).sample(range(n), samples)]
        sources, scale = global_row_number(nodes, F.asc("id"), name="_p").where(F.col("_p").isin(chosen)).select("id"), n / samples
    level = cut(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")), "level")
    levels, seen, d = [level], level.select("s", "id"), 0
    while True:
        d += 1
        step = level.select("s", F.col("id").alias("src"), "paths").join(both, "src").groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = cut(step.join(seen, ["s", "id"], "left_anti").select("s", "id", "paths"), "level")
        if not level.count():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "id"))
    share = levels[-1].select("s", "id", "paths", F.lit(0.0).alias("owed"))
    total = share.where("s <> id").select("id", "owed")
    for k in range(len(levels) - 2, -1, -1):
        given = share.select("s", F.col("id").alias("dst"), ((1 + F.col("owed")) / F.col("paths")).alias("g"))
        back = given.join(both, "dst").groupBy("s", F.col("src").alias("id")).agg(F.sum("g").alias("g"))
        share = cut(levels[k].join(back, ["s", "id"], "left").select("s", "id", "paths", (F.col("paths") * F.coalesce("g", F.lit(0.0))).alias("owed")), "dependency")
        total = total.unionByName(share.where("s <> id").select("id", "owed"))
    sums = total.groupBy("id").agg(F.sum("owed").alias("b"))
    return nodes.join(sums, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale / ((n - 1) * (n - 2)))).alias("betweenness"))
