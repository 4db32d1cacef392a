"""Queries on source text: parts written out as a small web application, so that what a parser must find is known.

A brand is a file; each of its parts, by key, is a function of four lines under
a route decorator, which calls the next one.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from weftgraph.catalog.base import query, table
from weftgraph.operators import changes
from weftgraph.operators.resolve import resolve
from weftgraph.plans.index import symbols_of
from weftgraph.sources import code, frameworks
from weftgraph.storage import once

HEAD = "from fastapi import FastAPI\napp = FastAPI()\n\n"
BASE = """
base AS (SELECT p_partkey AS k, 'src/' || lower(replace(p_brand, '#', '')) || '.py' AS path, CASE p_size % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'post' ELSE 'delete' END AS verb, p_type AS type,
  CAST(4 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next FROM part)"""


def files(spark, d):
    """(path, kind, text)."""

    def build():
        order = Window.partitionBy("p_brand").orderBy("p_partkey")
        p = table(spark, d, "part").withColumn("next", F.lead("p_partkey").over(order))
        verb = F.element_at(F.array(F.lit("get"), F.lit("post"), F.lit("delete")), (F.col("p_size") % 3 + 1).cast("int"))
        key = F.col("p_partkey").cast("string")
        body = F.coalesce(F.concat(F.lit("view_"), F.col("next").cast("string"), F.lit("(x)")), F.lit("x"))
        text = F.concat(F.lit("@app."), verb, F.lit('("/'), "p_type", F.lit("/"), key, F.lit('")\ndef view_'), key, F.lit("(x):\n    return "), body, F.lit("\n\n"))
        listed = p.select("p_brand", "p_partkey", text.alias("t")).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))).alias("ts"))
        path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".py"))
        return listed.select(path.alias("path"), F.lit("python").alias("kind"), F.concat(F.lit(HEAD), F.array_join(F.transform("ts", lambda x: x["t"]), "")).alias("text"))

    return once(spark, f"files {d}", build)


def _entities(spark, d):
    return once(spark, f"entities {d}", lambda: code.entities(files(spark, d)))


def _symbols(spark, d):
    return once(spark, f"symbols {d}", lambda: symbols_of(_entities(spark, d)))


def _references(spark, d):
    known = _symbols(spark, d).where("label <> 'Variable'")
    return once(spark, f"references {d}", lambda: resolve(code.raw_edges(files(spark, d)), known, files(spark, d)))


@query(f"WITH {BASE} SELECT path || '::view_' || k AS qname, 'Function' AS label, line + 1 AS line_start, line + 2 AS line_end, 'def view_' || k || '(x):' AS signature FROM base UNION ALL SELECT DISTINCT path || '::app', 'Variable', 2, 2, NULL FROM base")
def code_symbols(spark, d):
    return _symbols(spark, d).select("qname", "label", "line_start", "line_end", "signature")


@query(f"WITH {BASE} SELECT path || '::view_' || k AS src, path || '::view_' || next AS dst, line + 2 AS line, 0.9 AS confidence, 'same_module' AS method FROM base WHERE next IS NOT NULL")
def code_calls(spark, d):
    s = _symbols(spark, d).select("id", "qname")
    e = _references(spark, d).where("rel = 'CALLS'").withColumnRenamed("src", "a").withColumnRenamed("dst", "b")
    return e.join(s.select(F.col("id").alias("a"), F.col("qname").alias("src")), "a").join(s.select(F.col("id").alias("b"), F.col("qname").alias("dst")), "b").select("src", "dst", "line", "confidence", "method")


@query(f"WITH {BASE} SELECT upper(verb) || ' /' || type || '/' || k AS name, upper(verb) AS method, '/' || type || '/' || k AS path, 'fastapi' AS framework, path AS file, line, path || '::view_' || k AS handler FROM base")
def code_routes(spark, d):
    return frameworks.detect(files(spark, d), _entities(spark, d)).select("name", "method", "path", "framework", "file", "line", "handler")


@query(f"""WITH {BASE}, t AS (SELECT path, line, k, next FROM base WHERE k % 50 = 7 OR next % 50 = 7)
SELECT 'view_' || k AS name, path AS file, line + 1 AS line, 5 AS col, 1.0 AS confidence FROM t WHERE k % 50 = 7 UNION ALL SELECT 'view_' || next, path, line + 2, 12, 1.0 FROM t WHERE next % 50 = 7""")
def rename_sites(spark, d):
    names = table(spark, d, "part").where("p_partkey % 50 = 7").select(F.concat(F.lit("view_"), F.col("p_partkey").cast("string")).alias("name"))
    return changes.rename_plans(files(spark, d), _symbols(spark, d), _references(spark, d), names)


@query("""WITH s AS (SELECT p_partkey AS k, p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part), c AS (SELECT file, (r - 1) // 10 AS band, min(k) AS community FROM s GROUP BY 1, 2) SELECT s.k AS id, community FROM s JOIN c ON c.file = s.file AND band = (r - 1) // 10 WHERE (SELECT count(*) FROM s t WHERE t.file = s.file AND (t.r - 1) // 10 = band) > 1""")
def clique_communities(spark, d):
    """Communities of a graph of cliques, ten parts of a brand each, joined by weak links: the cliques."""
    from weftgraph.operators import community

    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, d, "part").withColumn("band", F.floor((F.row_number().over(order) - 1) / 10)).select(F.col("p_partkey").alias("id"), "p_brand", "band")
    a, b = p.select(F.col("id").alias("src"), "p_brand", "band"), p.select(F.col("id").alias("dst"), "p_brand", "band")
    inner = a.join(b, ["p_brand", "band"]).where("src < dst").select("src", "dst", F.lit(1.0).alias("weight"))
    weak = a.groupBy("p_brand", "band").agg(F.max("src").alias("src")).join(b.groupBy("p_brand", (F.col("band") - 1).alias("band")).agg(F.max("dst").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), ["p_brand", "band"]).select("src", "dst", F.lit(0.1).alias("weight"))
    return community.detect(p.select("id"), inner.unionByName(weak))
