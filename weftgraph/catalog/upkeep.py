"""Change feeds, chunks, tiles, history and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog.base import CALLS, SYMBOLS, calls, query, symbols, table
from weftgraph.functions import geometry
from weftgraph.operators import changes, layout
from weftgraph.sources import chunks, web
from weftgraph.streaming import feed


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def activity_windows(spark, d):
    out = feed.activity(table(spark, d, "events"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def text_chunks(spark, d):
    return chunks.split(table(spark, d, "documents"), "doc_id", "text")


@query()
def body_chunks(spark, d):
    return chunks.split(table(spark, d, "documents"), "doc_id", "text", bodies=True)


@query(f"""WITH {SYMBOLS}, r AS (SELECT p_brand AS file, s, s + 40 AS e FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest([10, 200, 900]) AS s)),
o AS (SELECT id, sum(least(line_end, e) - greatest(line_start, s) + 1) AS overlap FROM symbols JOIN r USING (file) WHERE line_start <= e AND line_end >= s GROUP BY id)
SELECT id, CAST(overlap AS BIGINT) AS overlap FROM o JOIN part ON p_partkey = id ORDER BY p_retailprice DESC, id LIMIT 200""")
def changed_symbols(spark, d):
    s = symbols(spark, d).withColumn("qname", F.concat_ws("::", "file", F.col("id").cast("string")))
    s = s.join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pagerank")), "id")
    r = table(spark, d, "part").select(F.col("p_brand").alias("file")).distinct().select("file", F.explode(F.array(*(F.lit(x).cast("long") for x in (10, 200, 900)))).alias("s"))
    return changes.changed_symbols(r.withColumn("e", F.col("s") + 40), s).select("id", "overlap")


@query()
def detect_changes_risk(spark, d):
    s = symbols(spark, d).withColumn("qname", F.concat_ws("::", "file", F.col("id").cast("string")))
    s = s.join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pagerank")), "id")
    r = spark.createDataFrame([("Brand#17", 100, 120)], "file string, s int, e int")
    e = calls(spark, d).select(F.lit("CALLS").alias("rel"), "src", "dst", "confidence").where("confidence >= 0.9")
    return changes.detect_changes(r, s, e)["changed"].select("id", "callers", "tests", "score", "level")


@query("""WITH g AS (SELECT p_partkey AS id, CAST(least(greatest(floor((p_retailprice - 900.0) / 1200.0 * 65536), 0), 65535) AS BIGINT) AS x, CAST(least(greatest(floor((p_size - 1) / 50.0 * 65536), 0), 65535) AS BIGINT) AS y FROM part)
SELECT id FROM g WHERE (x >> 14) = 0 AND (y >> 14) = 1""")
def tile_nodes(spark, d):
    p = table(spark, d, "part")
    code = geometry.morton(geometry.quantise(F.col("p_retailprice"), 900.0, 2100.0), geometry.quantise(F.col("p_size").cast("double"), 1.0, 51.0))
    nodes = p.select(F.col("p_partkey").alias("id"), code.alias("code"))
    none = spark.createDataFrame([], "src long, dst long, confidence double")
    return layout.tile(nodes, none, 2, 0, 1)[0].select("id")


@query()
def world_layout(spark, d):
    s = symbols(spark, d).select("id", "file")
    clusters = table(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.min("p_type").alias("cluster"))
    pairs = calls(spark, d).join(s.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    weights = pairs.where("a < b").groupBy("a", "b").agg(F.sum("confidence").alias("weight"))
    return layout.place(s, clusters, weights)


@query("""SELECT p_type AS cluster, round(avg(p_retailprice), 6) AS x, round(avg(CAST(p_size AS DOUBLE)), 6) AS y, count(*) AS size FROM part GROUP BY p_type""")
def lod_clusters(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_type", "p_brand").alias("file"))
    places = p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    clusters = s.select("file", F.split("file", "/")[0].alias("cluster")).distinct()
    none = spark.createDataFrame([], "src long, dst long, confidence double, weight double")
    nodes, _ = layout.lod(s, places, none, clusters)["cluster"]
    return nodes.select("cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "size")


@query("""SELECT DISTINCT o_custkey AS name, l_partkey AS candidate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'
EXCEPT SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'""")
def candidate_difference(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    both = o.join(l, o.o_orderkey == l.l_orderkey).select("o_orderstatus", F.col("o_custkey").alias("name"), F.col("l_partkey").alias("candidate"))
    old, new = (both.where(F.col("o_orderstatus") == x).select("name", "candidate") for x in ("F", "O"))
    return old.subtract(new)


@query("""WITH c AS (SELECT doc_id AS id, sha1(text) AS ehash, length(text) AS n FROM documents) SELECT ehash, count(*) AS chunks, min(id) AS first FROM c GROUP BY ehash""")
def embedding_reuse(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha1(F.col("text").cast("binary")).alias("ehash"), "text")
    known = c.where("length(text) > 2000").select("ehash", F.array(F.lit(0.0)).alias("embedding"))
    out = feed.reuse_embeddings(c, known, lambda missing: missing.select("ehash", F.array(F.lit(1.0)).alias("embedding")))
    return out.groupBy("ehash").agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first"))


@query()
def page_crawl(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    return web.crawl(pages, pages.select("url").orderBy("url").limit(3), depth=2)[0]


@query("SELECT page_id, substr(regexp_replace(regexp_replace(lower(regexp_replace(url, '^[a-z]+://', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) || '.html' AS file FROM pages")
def url_slugs(spark, d):
    return table(spark, d, "pages").select("page_id", web.file_name(F.col("url")).alias("file"))


@query("SELECT count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part")
def free_query(spark, d):
    from weftgraph.plans.sql import read_only

    table(spark, d, "part").createOrReplaceTempView("weft_part")
    return read_only(spark, "SELECT count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM weft_part")
