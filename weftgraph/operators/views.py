"""Reports that put several tables together: files, clusters, routes, impact, state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.operators.lookup import by_key
from weftgraph.operators.traverse import entry_points, frontier
from weftgraph.storage import cut

#: Rows of the parts of a cluster's report.
API, NEIGHBOURS, CLUSTER_LINKS = 25, 20, 500


def files_dump(files: DataFrame, edges: DataFrame, rels: tuple[str, ...] = ("IMPORTS", "CO_CHANGED_WITH")) -> tuple[DataFrame, DataFrame]:
    """((id, path, language, lines, pagerank), (rel, src, dst, confidence)): files, and the edges of the given kinds with both ends among them."""
    ids = files.select("id")
    inner = edges.where(F.col("rel").isin(*rels)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return files.select("id", "path", "language", "lines", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")), inner.select("rel", "src", "dst", "confidence").distinct()


def annotate(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, ...) with their community, and the greatest confidence of an edge of theirs to another of them (1 if it has none of its own)."""
    ids = cut(nodes.select("id").distinct(), "payload")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = inner.select(F.explode(F.array("src", "dst")).alias("id"), F.coalesce("confidence", F.lit(1.0)).alias("_c"))
    most = ends.groupBy("id").agg(F.max("_c").alias("max_confidence"))
    return nodes.join(members.select("id", "community"), "id", "left").join(most, "id", "left")


def _between(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): calls from one community to another."""
    m = members.select("id", "community")
    both = edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    return both.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def list_clusters(members: DataFrame, names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((community, name, size) by size, then name; (a, b, n): the strongest links between them)."""
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    heads = size.join(names.select("community", "name"), "community", "left").select("community", "name", "size").orderBy(F.desc("size"), "name")
    return heads, _between(members, edges).orderBy(F.desc("n"), "a", "b").limit(CLUSTER_LINKS)


def cluster(members: DataFrame, symbols: DataFrame, ranks: DataFrame, edges: DataFrame, community) -> dict[str, DataFrame]:
    """members, api (called from outside, by callers), depends_on and used_by (communities, by calls) of one community."""
    own = cut(members.where(F.col("community") == community).select("id"), "cluster")
    info = symbols.join(own, "id", "left_semi").join(ranks, "id", "left").select("id", "name", "file", "label", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))
    into = edges.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").join(own.withColumnRenamed("id", "src"), "src", "left_anti")
    api = into.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers")).join(info, "id").orderBy(F.desc("callers"), "id").limit(API)
    links = _between(members, edges)
    side = lambda here, there: links.where(F.col(here) == community).select(F.col(there).alias("community"), "n").orderBy(F.desc("n"), "community").limit(NEIGHBOURS)
    return {"members": info.orderBy(F.desc("pagerank"), "id"), "api": api, "depends_on": side("a", "b"), "used_by": side("b", "a")}


def route_map(routes: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(id, name, handler, reach): routes with what their handlers call within so many hops, the handler not counted; 0 without a handler."""
    handles = edges.where("rel = 'HANDLES'").select(F.col("src").alias("seed"), F.col("dst").alias("id"))
    walk = frontier(handles, edges.where("rel = 'CALLS'"), hops).where("depth > 0")
    reach = walk.groupBy(F.col("seed").alias("id")).agg(F.count(F.lit(1)).alias("reach"))
    first = handles.groupBy(F.col("seed").alias("id")).agg(F.min("id").alias("handler"))
    return routes.select("id", "name").join(first, "id", "left").join(reach, "id", "left").select("id", "name", "handler", F.coalesce("reach", F.lit(0)).alias("reach"))


def impact_of(symbols: DataFrame, edges: DataFrame, ranks: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """(kind, id, weight): callers, importers, co-changed files and tests of a file (by path) or of the symbols of a name.

    weight: rank of a caller, 1 for importers and tests, the count of common
    commits for co-changed files.  A file's callers are those of its symbols
    from other files.
    """
    path = files.where(F.col("path") == key).select("id", "path")
    as_file = bool(path.head(1))
    own = cut(symbols.where(F.col("file") == key).select("id", "file") if as_file else symbols.where(F.col("name") == key).select("id", "file"), "targets")
    ids, into = own.select(F.col("id").alias("dst")), lambda rel: edges.where(F.col("rel") == rel)
    callers = into("CALLS").join(ids, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    if as_file:
        callers = callers.join(own.select("id"), "id", "left_anti")
    callers = callers.join(ranks, "id", "left").select(F.lit("caller").alias("kind"), "id", F.coalesce("pagerank", F.lit(0.0)).alias("weight"))
    here = path.select("id") if as_file else files.join(own.select(F.col("file").alias("path")).distinct(), "path", "left_semi").select("id")
    here = cut(here.distinct(), "target-files")
    one = F.lit(1.0).alias("weight")
    importers = into("IMPORTS").join(here.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.lit("importer").alias("kind"), F.col("src").alias("id"), one).distinct()
    both = into("CO_CHANGED_WITH").select("src", "dst", "confidence").unionByName(into("CO_CHANGED_WITH").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    mates = both.join(here.withColumnRenamed("id", "src"), "src", "left_semi").join(here.withColumnRenamed("id", "dst"), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.max("confidence").alias("weight")).select(F.lit("co_changed").alias("kind"), "id", "weight")
    tests = into("TESTS").join(ids, "dst", "left_semi").select(F.lit("test").alias("kind"), F.col("src").alias("id"), one).distinct()
    return reduce(DataFrame.unionByName, [callers, importers, mates, tests])


def starting_points(symbols: DataFrame, edges: DataFrame, ranks: DataFrame, routes: DataFrame, limit: int) -> DataFrame:
    """(id, source, place): where flows begin: handlers of routes, then of tools, by file and line, then what nothing calls by rank; each once."""
    handles = edges.where("rel = 'HANDLES'").select(F.col("src").alias("route"), F.col("dst").alias("id"))
    kinds = F.when(F.col("kind") == "route", 0).otherwise(1)
    first = routes.select(F.col("id").alias("route"), kinds.alias("o"), "file", "line").join(handles, "route").groupBy("id").agg(F.min(F.struct("o", "file", "line")).alias("k"))
    free = entry_points(symbols, edges.where("rel = 'CALLS'"), ranks).orderBy(F.desc("pagerank"), "id").limit(3 * limit)
    rows = first.select("id", F.when(F.col("k.o") == 0, "route").otherwise("tool").alias("source"), F.col("k.o").alias("o"), F.lit(0.0).alias("r"), F.col("k.file").alias("f"), F.col("k.line").alias("l"))
    rest = free.join(first.select("id"), "id", "left_anti").select("id", F.lit("function").alias("source"), F.lit(2).alias("o"), (-F.col("pagerank")).alias("r"), F.lit("").alias("f"), F.lit(0).alias("l"))
    place = F.row_number().over(Window.orderBy("o", "f", "l", "r", "id"))  # handlers and 3 * limit rows
    return rows.unionByName(rest).select("id", "source", place.alias("place"))


def call_links(flow: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, src, dst): calls among the members of each flow, for flows() of traverse."""
    a, b = flow.select("entry", F.col("id").alias("src")), flow.select("entry", F.col("id").alias("dst"))
    return a.join(edges.select("src", "dst").distinct(), "src").join(b, ["entry", "dst"], "left_semi").select("entry", "src", "dst").where("src <> dst")


def index_info(tables: dict[str, DataFrame], capabilities: dict[str, bool]) -> DataFrame:
    """(item, value): rows of each table and what the index can do."""
    counts = reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(f"rows.{n}").alias("item"), "value") for n, t in sorted(tables.items())])
    spark = counts.sparkSession
    return counts.unionByName(spark.createDataFrame([(f"can.{k}", str(bool(v)).lower()) for k, v in sorted(capabilities.items())], "item string, value string"))


def node_payload(walk: DataFrame, symbols: DataFrame, ranks: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth, name, file, label, pagerank, community, max_confidence) of the nodes of a walk."""
    rows = walk.groupBy("id").agg(F.min("depth").alias("depth")).join(symbols.select("id", "name", "file", "label"), "id").join(ranks, "id", "left")
    return annotate(rows, members, edges)


def tests_for(symbols: DataFrame, edges: DataFrame, key: str, depth: int = 3) -> DataFrame:
    """(id, depth): tests of the symbols of a key, by TESTS edges and by calls."""
    from weftgraph.operators.traverse import test_impact

    return test_impact(edges.where("rel = 'CALLS'"), edges.where("rel = 'TESTS'"), symbols, by_key(symbols, key).select("id"), depth)
