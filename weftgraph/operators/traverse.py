"""Reachability over an edge table (src, dst, confidence): one frontier loop for all of it.

A level joins the frontier with the edges and drops what was seen; seeds carry
an id through, so many traversals share one loop.  Small frontiers are
broadcast by size at run time; edges are the only large side of any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.storage import cut


def directed(edges: DataFrame, direction: str = "out", min_confidence: float | None = None) -> DataFrame:
    """(src, dst) to walk along: out, in, or both ways; a null confidence counts as 1."""
    if min_confidence is not None:
        edges = edges.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def frontier(seeds: DataFrame, edges: DataFrame, depth: int, *, direction: str = "out", min_confidence: float | None = None, max_nodes: int | None = None) -> DataFrame:
    """(seed, id, depth, parent) of every node within depth of its seed (depth 0, no parent).

    seeds: (seed, id).  Of several parents on the shortest paths the smallest
    counts.  max_nodes ends the walk of all seeds together after the level that
    reaches it.
    """
    # every level scans the edge table and keeps what the frontier reaches: a small frontier is broadcast by its
    # measured size, so the edges aren't shuffled for it; repeated edges fall together in the aggregate
    hops = directed(edges, direction, min_confidence)
    level = seeds.select("seed", "id", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["id"].dataType).alias("parent")).dropDuplicates(["seed", "id"])
    seen = level = cut(level, "seeds")
    for d in range(1, depth + 1):
        step = level.select("seed", F.col("id").alias("src")).join(hops, "src").groupBy("seed", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        level = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(d).alias("depth"), "parent"), "frontier")
        reached = level.count()
        if not reached:
            break
        seen = seen.unionByName(level)
        if max_nodes is not None and seen.count() >= max_nodes:
            break
    return seen


def call_graph(edges: DataFrame, seeds: DataFrame, depth: int = 2, min_confidence: float | None = None) -> DataFrame:
    """(side, id, depth): what the seeds (id) reach, seeds included, and what reaches them, seeds excluded; depth is kept within 1 to 5."""
    depth = max(1, min(5, depth))
    start = seeds.select(F.lit(0).alias("seed"), "id")
    ahead = frontier(start, edges, depth, min_confidence=min_confidence)
    back = frontier(start, edges, depth, direction="in", min_confidence=min_confidence).where("depth > 0")
    return ahead.select(F.lit("callees").alias("side"), "id", "depth").unionByName(back.select(F.lit("callers").alias("side"), "id", "depth"))


def explore(edges: DataFrame, seeds: DataFrame, ranks: DataFrame, depth: int, limit: int) -> DataFrame:
    """(id, depth, score): both ways along all edges, scored 1 / (depth + 1) + pagerank / 2."""
    near = frontier(seeds.select(F.lit(0).alias("seed"), "id"), edges, depth, direction="both")
    score = F.round(1 / (F.col("depth") + 1) + 0.5 * F.coalesce("pagerank", F.lit(0.0)), 9)
    return near.join(ranks, "id", "left").select("id", "depth", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def trace(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 12, min_confidence: float | None = None) -> DataFrame:
    """(position, id): a shortest path from any source to any target, or from target to source if there is none.

    Sources count as seen from the start, so a target that is also a source is
    never the hit.  Among nearest targets the smallest id is taken, and of
    several parents the smallest.
    """
    for a, b in ((sources, targets), (targets, sources)):
        seen = frontier(a.select(F.lit(0).alias("seed"), "id"), edges, max_depth, min_confidence=min_confidence).select("id", "depth", "parent")
        hit = seen.where("depth > 0").join(b.select("id"), "id", "left_semi").orderBy("depth", "id").limit(1).collect()
        if hit:
            path, node = [], hit[0]
            # one row per level, from the hit back: a path is at most max_depth long
            while node is not None:
                path.append(node.id)
                node = seen.where(F.col("id") == node.parent).head() if node.parent is not None else None
            return seen.sparkSession.createDataFrame(list(enumerate(reversed(path))), f"position int, id {seen.schema['id'].dataType.simpleString()}")
    return seen.select(F.lit(0).alias("position"), "id").limit(0)


def closure(edges: DataFrame) -> DataFrame:
    """(id, ancestor): all pairs along src to dst, cycles included once; path doubling until nothing is new, so rounds are logarithmic in the longest path."""
    pairs = cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("ancestor")).where("id <> ancestor").distinct(), "closure")
    size = pairs.count()
    while size:
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.ancestor") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.ancestor").alias("ancestor"))
        pairs = cut(pairs.unionByName(longer.where("id <> ancestor")).distinct(), "closure")
        now = pairs.count()
        if now == size:
            break
        size = now
    return pairs


def short_cycles(edges: DataFrame, names: DataFrame, longest: int = 6, limit: int | None = None) -> DataFrame:
    """(length, path): cycles of up to `longest` nodes, each once, starting at its smallest name; by length, then path."""
    hops = edges.select("src", "dst").where("src <> dst").distinct()
    named = hops.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").select("a", "b").where("a <> b").distinct()
    paths = named.where("a < b").select(F.col("a").alias("first"), F.array("a", "b").alias("path"), F.col("b").alias("last"))
    found = None
    for n in range(2, longest + 1):
        closed = paths.join(named.select(F.col("a").alias("last"), F.col("b").alias("first")), ["last", "first"]).select(F.lit(n).alias("length"), "path")
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            # a path only grows by names above its first, so every cycle has one start
            paths = paths.join(named.select(F.col("a").alias("last"), F.col("b").alias("next")), "last").where("next > first").where(~F.array_contains("path", F.col("next")))
            paths = cut(paths.select("first", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last")), "paths")
    out = found.select("length", F.array_join("path", " > ").alias("path"))
    return out.orderBy("length", "path").limit(limit) if limit else out


def entry_points(symbols: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, pagerank): what nothing calls, that isn't a test and has rank."""
    free = symbols.where("NOT is_test").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return free.join(ranks, "id").where("pagerank > 0").select("id", "pagerank")


def flows(entries: DataFrame, edges: DataFrame, depth: int = 8, max_nodes: int = 50) -> DataFrame:
    """(entry, position, id, depth, parent): what each entry reaches, nearest first, at most max_nodes each; entries without callees are left out."""
    from pyspark.sql import Window

    walk = frontier(entries.select(F.col("id").alias("seed"), "id"), edges, max(2, min(12, depth)))
    busy = walk.where("depth = 1").select("seed").distinct()
    order = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "id"))
    return walk.join(busy, "seed").withColumn("position", order).where(F.col("position") <= max_nodes).select(F.col("seed").alias("entry"), "position", "id", "depth", "parent")


def test_impact(edges: DataFrame, tests: DataFrame, symbols: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth): tests of the targets by TESTS edges (depth 1), and test symbols that call them within depth."""
    direct = tests.join(targets.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.lit(1).alias("depth"))
    back = frontier(targets.select(F.lit(0).alias("seed"), "id"), edges, depth, direction="in").where("depth > 0")
    called = back.join(symbols.where("is_test").select("id"), "id", "left_semi").select("id", "depth")
    return direct.unionByName(called).groupBy("id").agg(F.min("depth").alias("depth"))
