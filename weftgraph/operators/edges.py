"""Derived edges: tests, co-change, containment, overrides, symbol history, and what keeps tables clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.functions.text import test_target


#: Fixed value: rows (commit, file) that a task pairs.
TASK_ROWS = 500_000


def co_changed(touched: DataFrame, *, least: int = 2, window: int | None = None, order: Column | None = None) -> DataFrame:
    """(src, dst, count): files (src < dst) of the same commits, at least `least` times.

    touched: (commit, file).  window keeps the last so many commits by order.
    """
    if window is not None:
        last = touched.select("commit", order.alias("_o")).distinct().orderBy(F.desc("_o"), F.desc("commit")).limit(window).select("commit")
        touched = touched.join(last, "commit", "left_semi")
    # as many tasks as rows ask for, a given number of them, so that no task's pairs grow with the table
    parts = max(int(touched.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-touched.count() // TASK_ROWS))
    pair = touched.select("commit", "file").repartition(parts, "commit").distinct()
    other = pair.select("commit", F.col("file").alias("dst"))
    both = pair.select("commit", F.col("file").alias("src")).join(other.hint("merge"), "commit").where("src < dst")
    # pairs seldom repeat, so counts before the shuffle would hold a task's pairs and save little
    counts = both.repartition(2 * parts, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") >= least)


def tests_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst): tests to every other symbol that has the name they are named after."""
    tests = symbols.where("is_test").select(F.col("id").alias("src"), test_target(F.col("name")).alias("_t")).where("_t <> ''")
    return tests.join(symbols.select(F.col("id").alias("dst"), F.col("name").alias("_t")), "_t").where("src <> dst").select("src", "dst")


def contains_edges(symbols: DataFrame) -> DataFrame:
    """(parent, id): from the depth of the qualified name; the last definition of a name stands for it."""
    parts = F.split("qname", "::")
    rows = symbols.select("id", "qname", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::").alias("_up"))
    last = symbols.groupBy("qname").agg(F.max("id").alias("parent"))
    return rows.join(last.withColumnRenamed("qname", "_up"), "_up").select("parent", "id")


def overrides(inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst): a method and the methods of the same name of all classes its class descends from.

    inherits: (src, dst) child to parent class; methods: (class_id, name, id).
    The first definition of a name in a class counts.
    """
    from weftgraph.operators.traverse import closure

    first = methods.groupBy("class_id", "name").agg(F.min("id").alias("id"))
    up = closure(inherits)
    own = first.select(F.col("class_id").alias("id"), "name", F.col("id").alias("src"))
    base = first.select(F.col("class_id").alias("ancestor"), "name", F.col("id").alias("dst"))
    return up.join(own, "id").join(base, ["ancestor", "name"]).select("src", "dst").distinct()


def valid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def overlapping(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, overlap): lines of each span that changed ranges cover; ranges: (file, s, e), spans: (id, file, line_start, line_end)."""
    lines = F.least("line_end", "e") - F.greatest("line_start", "s") + 1
    return spans.join(ranges, "file").where("line_start <= e AND line_end >= s").groupBy("id").agg(F.sum(lines).alias("overlap"))


# What is joined by cells or bins is many times the file that it is read from, by whose size a join would be
# broadcast; so these joins are told to merge.
def _levels(spans: DataFrame) -> int:
    """How many levels of halving the longest span has."""
    longest = spans.agg(F.max(F.col("line_end").cast("long") - F.col("line_start"))).head()[0]
    return max(longest or 0, 0).bit_length() + 1


def _cells(levels: int) -> Column:
    """Cells (k, c), cell c of level k being the lines from c * 2^k on, that together are a span's lines: two of each level at most."""
    low, high = "-shiftright(-cast(line_start AS bigint), k)", "shiftright(cast(line_end AS bigint) + 1, k)"
    pick = f"array(IF({low} < {high} AND ({low}) % 2 <> 0, struct(k, {low} AS c), NULL), IF({low} < {high} AND {high} % 2 <> 0, struct(k, {high} - 1 AS c), NULL))"
    return F.explode(F.expr(f"filter(flatten(transform(sequence(0, {levels}), k -> {pick})), x -> x IS NOT NULL)")).alias("_c")


def _around(levels: int) -> Column:
    """The cells of each level that hold a line."""
    return F.explode(F.expr(f"transform(sequence(0, {levels}), k -> struct(k, shiftright(cast(line AS bigint), k) AS c))")).alias("_c")


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(point, id): the tightest span around each line; points: (point, file, line).

    Spans leave their best in the cells that they are made of, a line looks into
    the cells that it lies in: a row per level each, however spans overlap.
    """
    levels = _levels(spans)
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("n"), "id"))
    held = spans.where("line_start <= line_end").select("id", "file", "line_start", "line_end", _cells(levels)).groupBy("file", "_c.k", "_c.c").agg(best.alias("_b"))
    hit = points.select("point", "file", _around(levels)).select("point", "file", "_c.*").join(held.hint("merge"), ["file", "k", "c"])
    return hit.groupBy("point").agg(F.min("_b").getField("id").alias("id"))


def next_start(points: DataFrame, spans: DataFrame, window: int = 15) -> DataFrame:
    """(point, id): the first span that starts after a line, within window lines.

    Starts are gathered by bins of window lines, one span for each line, so a
    point looks into two short lists.
    """
    one = spans.groupBy("file", "line_start").agg(F.min("id").alias("id")).where("line_start IS NOT NULL")
    starts = one.groupBy("file", F.expr(f"floor(line_start / {window})").alias("_b")).agg(F.collect_list(F.struct("line_start", "id")).alias("_s"))
    bins = F.explode(F.expr(f"sequence(floor((line + 1) / {window}), floor((line + {window}) / {window}))")).alias("_b")
    first = F.expr(f"array_min(filter(_s, x -> x.line_start > line AND x.line_start <= line + {window}))")
    hit = points.where("line IS NOT NULL").select("point", "file", "line", bins).join(starts.hint("merge"), ["file", "_b"]).select("point", first.alias("_f")).where("_f IS NOT NULL")
    return hit.groupBy("point").agg(F.min("_f").getField("id").alias("id"))


def symbol_history(blame: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, first_ts, last_ts): the commit of a span's first line, and its latest; blame: (file, line, ts), a null ts is uncommitted.

    An uncommitted first line takes the earliest committed one; any uncommitted
    line leaves the last one null.  Lines are summed up in cells of each level, of
    which a span takes those that it is made of, and never line by line.
    """
    levels = _levels(spans)
    lines = blame.where("line IS NOT NULL").select("file", "line", "ts", _around(levels)).groupBy("file", "_c.k", "_c.c")
    cells = lines.agg(F.min(F.struct("line", "ts")).alias("_f"), F.min("ts").alias("_a"), F.max("ts").alias("_z"), F.bool_or(F.col("ts").isNull()).alias("_n"))
    hit = spans.where("line_start <= line_end").select("id", "file", _cells(levels)).select("id", "file", "_c.*").join(cells.hint("merge"), ["file", "k", "c"])
    return hit.groupBy("id").agg(F.coalesce(F.min("_f").getField("ts"), F.min("_a")).alias("first_ts"), F.when(F.bool_or("_n"), F.lit(None)).otherwise(F.max("_z")).alias("last_ts"))


def aggregate_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, weight, confidence): edges between groups of nodes, own ones dropped; groups: (id, grp)."""
    up = edges.join(groups.select(F.col("id").alias("src"), F.col("grp").alias("a")), "src").join(groups.select(F.col("id").alias("dst"), F.col("grp").alias("b")), "dst")
    return up.where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of distinct edges without self loops."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    both = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def majority(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, grp): the group that most neighbours (both ways) belong to; ties go to the smallest."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    votes = both.join(groups.select(F.col("id").alias("other"), "grp"), "other").groupBy("id", "grp").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "grp")).getField("grp").alias("grp"))


def per_line_changes(lines: DataFrame, key: str) -> DataFrame:
    """Running paragraph numbers of lines (key, line_no, line): a blank line ends one."""
    w = Window.partitionBy(key).orderBy("line_no")
    blank = (F.trim("line") == "").cast("int")
    return lines.withColumn("paragraph", F.sum(blank).over(w)).where(F.trim("line") != "")
