"""What a change touches: symbols, callers, flows, tests and risk; and rename plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions import risk
from weftgraph.operators.edges import overlapping
from weftgraph.operators.rank import percentile_below
from weftgraph.operators.traverse import frontier
from weftgraph.storage import cut


#: Rows that a report lists at most, nearest first.
CALLERS, FLOWS, TESTS = 300, 100, 200


def changed_symbols(ranges: DataFrame, symbols: DataFrame, limit: int = 200) -> DataFrame:
    """Symbols that changed lines overlap, with the overlap; at most limit, by rank.

    A class is left out where one of its methods changed and at most two of its
    lines did.
    """
    hit = symbols.join(overlapping(ranges, symbols), "id").where("overlap > 0")
    parents = hit.where("label = 'Function'").select(F.regexp_replace("qname", "::[^:]*$", "").alias("qname")).distinct().withColumn("_inner", F.lit(True))
    kept = hit.join(parents, "qname", "left").where("NOT (label = 'Class' AND _inner IS NOT NULL AND overlap <= 2)").drop("_inner")
    return kept.orderBy(F.desc(F.coalesce("pagerank", F.lit(0.0))), "id").limit(limit)


def detect_changes(ranges: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = 3) -> dict[str, DataFrame]:
    """changed, callers, flows, tests and overall, from changed ranges (file, s, e); edges: (rel, src, dst, confidence).

    All changed symbols walk the graph in one loop, each under its own seed; a
    class walks with its methods.
    """
    changed = cut(changed_symbols(ranges, symbols), "changed")
    calls = edges.where("rel = 'CALLS'")
    inner = changed.where("label = 'Class'").select(F.col("id").alias("seed"), F.col("qname").alias("up")).join(symbols.select("id", F.regexp_replace("qname", "::[^:]*$", "").alias("up")), "up").select("seed", "id")
    seeds = changed.select(F.col("id").alias("seed"), "id").unionByName(inner).distinct()
    walk = cut(frontier(seeds, calls, 8, direction="in").where("depth > 0").join(changed.select("id"), "id", "left_anti"), "ancestors")
    info = symbols.select("id", "name", "file", "is_test")
    callers = walk.where(F.col("depth") <= max(1, min(6, depth))).join(info, "id")
    handlers = edges.where("rel = 'HANDLES'").select(F.col("dst").alias("id")).distinct()
    called = calls.select(F.col("dst").alias("id")).distinct()
    entries = info.where("NOT is_test").select("id").join(called, "id", "left_anti").withColumn("entry", F.lit("entry")).join(handlers, "id", "left_anti").unionByName(handlers.withColumn("entry", F.lit("handler")))
    flows = walk.select("seed", "id").unionByName(seeds).distinct().join(entries, "id")
    direct = edges.where("rel = 'TESTS'").join(seeds.withColumnRenamed("id", "dst"), "dst").select("seed", F.col("src").alias("id"), F.lit(1).alias("depth"))
    far = walk.where("depth <= 4").join(info.where("is_test").select("id"), "id").select("seed", "id", "depth")
    own = changed.where("is_test").select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    tests = direct.unionByName(far).unionByName(own).groupBy("seed", "id").agg(F.min("depth").alias("depth"))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("seed").alias("id")).agg(F.countDistinct("id").alias(name))

    pct = percentile_below(symbols.select("id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")), "id", "pagerank")
    rows = changed.join(pct, "id")
    for df, name in ((callers, "callers"), (flows.where("entry = 'handler'"), "routes"), (flows.where("entry = 'entry'"), "entries"), (tests, "tests")):
        rows = rows.join(count(df, name), "id", "left").fillna(0, [name])
    score = risk.symbol_score(percentile=F.col("below"), callers=F.col("callers"), routes=F.col("routes"), entries=F.col("entries"), tests=F.col("tests"), lines=F.col("overlap"))
    scored = cut(rows.withColumn("score", score).withColumn("level", risk.level(F.col("score"))), "scored")
    return {"changed": scored, "callers": callers.orderBy("depth", "seed", "id").limit(CALLERS), "flows": flows.orderBy("entry", "seed", "id").limit(FLOWS), "tests": tests.join(info.select("id", "name", "file"), "id").orderBy("depth", "file", "name", "seed", "id").limit(TESTS), "overall": scored.agg(risk.overall("score").alias("score")).withColumn("level", risk.level(F.col("score")))}


def test_command(tests: list[tuple[str, str]]) -> str:
    """A pytest line for (file, name) rows."""
    files = sorted({f for f, _ in tests})
    names = sorted({n for _, n in tests})
    return f"pytest {' '.join(files)} -k \"{' or '.join(names)}\"" if files else ""


def rename_plan(files: DataFrame, symbols: DataFrame, edges: DataFrame, old: str) -> DataFrame:
    """(file, line, col, confidence): a line's first use of a name; known definitions and calls 1.0, text in files that know it .6, elsewhere .3."""
    own = symbols.where(F.col("name") == old).select("id", "file", F.col("line_start").alias("line"))
    sites = edges.where("rel IN ('CALLS', 'INSTANTIATES')").join(own.select(F.col("id").alias("dst")), "dst", "left_semi").join(symbols.select(F.col("id").alias("src"), "file"), "src").select("file", "line")
    sure = own.select("file", "line").unionByName(sites).distinct().withColumn("known", F.lit(True))
    related = sure.select("file").distinct().withColumn("related", F.lit(True))
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("line", F.col("n") + 1)
    pattern = rf"(?<![\w$]){old}(?![\w$])"
    hit = lines.where(F.col("text").rlike(pattern)).withColumn("col", F.length(F.element_at(F.split("text", pattern, 2), 1)) + 1)
    out = hit.join(sure, ["file", "line"], "left").join(related, "file", "left")
    return out.select("file", "line", "col", F.when(F.col("known"), 1.0).when(F.col("related"), 0.6).otherwise(0.3).alias("confidence"))


def rename_plans(files: DataFrame, symbols: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, file, line, col, confidence): rename_plan of every one of names (name), which are identifiers of letters, digits, _ and $, in one pass over the lines.

    A line is cut into its runs of such characters; a name is used where a run equals it.
    """
    names = names.select("name").distinct()
    own = symbols.join(names, "name", "left_semi").select("name", "id", "file", F.col("line_start").alias("line"))
    calls = edges.where("rel IN ('CALLS', 'INSTANTIATES')").join(own.select("name", F.col("id").alias("dst")), "dst")
    sites = calls.join(symbols.select(F.col("id").alias("src"), "file"), "src").select("name", "file", "line")
    sure = own.select("name", "file", "line").unionByName(sites).distinct().withColumn("known", F.lit(True))
    related = sure.select("name", "file").distinct().withColumn("related", F.lit(True))
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("line", F.col("n") + 1)
    used = lines.select("file", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w$]+"), F.lit(0)))).alias("name"))
    hit = used.join(names, "name", "left_semi")
    col = F.regexp_instr("text", F.concat(F.lit(r"(?<![\w$])\Q"), "name", F.lit(r"\E(?![\w$])")))
    out = hit.join(sure, ["name", "file", "line"], "left").join(related, ["name", "file"], "left")
    return out.select("name", "file", "line", col.alias("col"), F.when(F.col("known"), 1.0).when(F.col("related"), 0.6).otherwise(0.3).alias("confidence"))


def shared_reach(walk: DataFrame) -> DataFrame:
    """(seed, shared): how many other seeds reach a symbol that a seed reaches; walk: (seed, id), distinct.

    The seeds of a symbol are a bit set, cut into words of 64 seeds, and a seed's
    partners are the union of its symbols' sets: no pair of seeds is ever a row,
    however many of them reach one symbol.
    """
    from weftgraph.operators.rank import global_row_number

    numbered = global_row_number(walk.select("seed").distinct(), F.asc("seed"), name="_p").select("seed", (F.col("_p") - 1).alias("_p"))
    word, bit = F.shiftright("_p", 6).alias("_w"), F.expr("shiftleft(1L, cast(_p & 63 AS int))")
    sets = walk.join(numbered, "seed").groupBy("id", word).agg(F.bit_or(bit).alias("_s"))
    own = walk.join(sets, "id").groupBy("seed", "_w").agg(F.bit_or("_s").alias("_s"))
    return own.groupBy("seed").agg((F.sum(F.bit_count("_s")) - 1).alias("shared"))


def api_impact(routes: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 5) -> DataFrame:
    """(route, reach, files, tests, shared): what a route's handler reaches, and other routes that reach some of it."""
    handles = edges.where("rel = 'HANDLES'").select(F.col("src").alias("seed"), F.col("dst").alias("id"))
    walk = cut(frontier(handles, edges.where("rel = 'CALLS'"), depth).select("seed", "id"), "reach")
    info = walk.join(symbols.select("id", "file"), "id").groupBy("seed").agg(F.countDistinct("id").alias("reach"), F.countDistinct("file").alias("files"))
    tests = edges.where("rel = 'TESTS'").join(walk.withColumnRenamed("id", "dst"), "dst").groupBy("seed").agg(F.countDistinct("src").alias("tests"))
    pairs = shared_reach(walk)
    out = routes.select(F.col("id").alias("seed"), "name").join(info, "seed", "left").join(tests, "seed", "left").join(pairs, "seed", "left")
    return out.fillna(0, ["reach", "files", "tests", "shared"]).withColumnRenamed("seed", "route")
