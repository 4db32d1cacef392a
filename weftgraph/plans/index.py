"""From a table of source files to the tables of a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions.text import terms
from weftgraph.operators import edges as derive
from weftgraph.operators.rank import pagerank
from weftgraph.operators.resolve import imports, resolve
from weftgraph.sources import chunks, code, frameworks
from weftgraph.storage import cut


@dataclass
class Graph:
    """file, symbol, edge, chunk, route: the tables of a snapshot; edge has a column rel."""

    file: DataFrame
    symbol: DataFrame
    variable: DataFrame
    edge: DataFrame
    chunk: DataFrame
    route: DataFrame
    errors: DataFrame

    def views(self, prefix: str = "") -> None:
        for name in ("file", "symbol", "variable", "edge", "chunk", "route"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def symbol_id(label, qname, line):
    """The same id for the same definition in every pass."""
    return F.xxhash64(label, qname, line)


def symbols_of(found: DataFrame) -> DataFrame:
    """Symbols and variables, with their ids, of entities as sources.code gives them."""
    label = F.when(F.col("kind") == "class", "Class").when(F.col("kind").isin("function", "method"), "Function").when(F.col("kind") == "section", "Section").otherwise("Variable")
    rows = found.where("error IS NULL").select(symbol_id(label, F.col("qname"), F.col("line_start")).alias("id"), label.alias("label"), "name", "qname", F.col("path").alias("file"), "line_start", "line_end", "signature", "doc", "body", "is_test", (F.col("kind") == "method").alias("is_method"), terms(F.concat_ws(" ", "name", "body")).alias("terms"))
    return rows.dropDuplicates(["id"])


def build(files: DataFrame, *, commits: DataFrame | None = None) -> Graph:
    """files: (path, kind, text); commits: (commit, file) for co-change edges.

    Ids are hashes of label, qualified name and line, so passes over parts of
    the files agree with a pass over all of them.
    """
    files = cut(files.select("path", "kind", "text"), "files")
    found = cut(code.entities(files), "entities")
    raw = cut(code.raw_edges(files), "raw-edges")
    rows = cut(symbols_of(found), "symbols")
    symbol, variable = rows.where("label <> 'Variable'"), rows.where("label = 'Variable'").select("id", "name", "qname", "file", F.col("line_start").alias("line"))
    file = files.select(F.xxhash64(F.lit("File"), "path").alias("id"), "path", F.col("kind").alias("language"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.sha1(F.col("text").cast("binary")).alias("hash"))
    refs = cut(resolve(raw, symbol, files), "resolved")
    none = {"line": "int", "confidence": "double", "method": "string"}

    def edge(rel: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(rel).alias("rel"), "src", "dst", *[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in none.items()])

    last = rows.groupBy("qname").agg(F.max("id").alias("parent"))
    up = rows.select("id", "file", F.regexp_replace("qname", "::[^:]*$", "").alias("qname")).join(last, "qname", "left")
    contains = up.select(F.coalesce("parent", F.xxhash64(F.lit("File"), "file")).alias("src"), F.col("id").alias("dst"))
    imp = imports(raw, files)
    module = F.coalesce(F.xxhash64(F.lit("File"), "file"), F.xxhash64(F.lit("Module"), "module"))
    into = imp.where("rel = 'IMPORTS' OR file IS NOT NULL").select(F.xxhash64(F.lit("File"), "path").alias("src"), module.alias("dst")).distinct()
    symbols_in = imp.where("rel = 'IMPORTS_SYMBOL' AND file IS NOT NULL").join(symbol.select("name", "file", F.col("id").alias("dst")), ["name", "file"]).select(F.xxhash64(F.lit("File"), "path").alias("src"), "dst").distinct()
    inherits = refs.where("rel = 'INHERITS'").select("src", "dst")
    parent = last.select(F.col("qname").alias("_c"), F.col("parent").alias("class_id"))
    methods = symbol.where("label = 'Function'").select("id", "name", F.regexp_replace("qname", "::[^:]*$", "").alias("_c")).join(parent, "_c").select("class_id", "name", "id")
    all_edges = edge("CONTAINS", contains).unionByName(edge("IMPORTS", into)).unionByName(edge("IMPORTS_SYMBOL", symbols_in)).unionByName(refs.select("rel", "src", "dst", "line", "confidence", "method"))
    all_edges = all_edges.unionByName(edge("OVERRIDES", derive.overrides(inherits, methods))).unionByName(edge("TESTS", derive.tests_edges(symbol)))
    if commits is not None:
        pairs = derive.co_changed(commits).select(F.xxhash64(F.lit("File"), "src").alias("src"), F.xxhash64(F.lit("File"), "dst").alias("dst"), F.col("count").cast("double").alias("confidence"))
        all_edges = all_edges.unionByName(edge("CO_CHANGED_WITH", pairs))
    route = frameworks.detect(files, found)
    handles = route.where("handler IS NOT NULL").join(symbol.where("label = 'Function'").select("file", F.col("qname").alias("handler"), F.col("id").alias("dst")), ["file", "handler"]).select(F.col("id").alias("src"), "dst")
    all_edges = cut(all_edges.unionByName(edge("HANDLES", handles)), "edges")
    ranks = pagerank(symbol, all_edges.where("rel IN ('CALLS', 'INHERITS', 'INSTANTIATES')"))
    ranked = cut(symbol.join(ranks, "id", "left"), "ranked")
    per_file = ranked.groupBy(F.col("file").alias("path")).agg(F.sum("pagerank").alias("pagerank"))
    return Graph(file.join(per_file, "path", "left"), ranked, variable, all_edges, chunks.of_graph(files, ranked), route, found.where("error IS NOT NULL").select("path", "error"))
