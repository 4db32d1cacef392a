"""Edge producers, band and as-of joins, sinks, and aggregates over edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog.base import CALLS, SYMBOLS, TOUCHED, calls, query, symbols, table, touched
from weftgraph.operators import edges
from weftgraph.sources import tables


@query(f"WITH {TOUCHED} SELECT a.file AS src, b.file AS dst, count(*) AS count FROM touched a JOIN touched b ON a.\"commit\" = b.\"commit\" AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 2")
def co_changed_pairs(spark, d):
    return edges.co_changed(touched(spark, d))


@query(f"""WITH {TOUCHED}, last AS (SELECT o_orderkey FROM orders JOIN (SELECT DISTINCT "commit" FROM touched) t ON t."commit" = o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200), t AS (SELECT * FROM touched WHERE "commit" IN (SELECT o_orderkey FROM last))
SELECT a.file AS src, b.file AS dst, count(*) AS count FROM t a JOIN t b ON a."commit" = b."commit" AND a.file < b.file GROUP BY 1, 2""")
def co_changed_window(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), "o_orderdate")
    return edges.co_changed(touched(spark, d).join(o, "commit"), least=1, window=200, order=F.col("o_orderdate"))


@query(f"""WITH {TOUCHED}, pairs AS (SELECT a.file AS src, b.file AS dst, count(*) AS c FROM touched a JOIN touched b ON a."commit" = b."commit" AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 2), ends AS (SELECT src AS id, c FROM pairs UNION ALL SELECT dst, c FROM pairs)
SELECT id, count(*) AS degree, CAST(sum(c) AS BIGINT) AS weight FROM ends GROUP BY id""")
def hub_degree(spark, d):
    pairs = edges.co_changed(touched(spark, d))
    return pairs.select(F.explode(F.array("src", "dst")).alias("id"), "count").groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("count").alias("weight"))


@query(f"WITH {CALLS} SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM calls UNION ALL SELECT dst, 1, 0 FROM calls) GROUP BY id")
def degree_histogram(spark, d):
    return edges.degrees(calls(spark, d))


@query("""SELECT c.c_custkey AS src, s.s_suppkey AS dst FROM (SELECT c_custkey, regexp_replace('test_' || replace(c_name, 'Customer', 'Supplier'), '^test_*', '', 'i') AS t FROM customer) c JOIN supplier s ON s.s_name = c.t WHERE c.c_custkey + 1000000000 <> s.s_suppkey""")
def tests_edges(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000000000).alias("id"), F.concat(F.lit("test_"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("name"), F.lit(True).alias("is_test"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(False).alias("is_test"))
    return edges.tests_edges(c.unionByName(s)).select((F.col("src") - 1000000000).alias("src"), "dst")


@query("""WITH q AS (SELECT r_regionkey AS id, r_name AS qname FROM region UNION ALL SELECT 100 + n_nationkey, r_name || '::' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 1000 + s_suppkey, r_name || '::' || n_name || '::' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT id, regexp_replace(qname, '::[^:]*$', '') AS up FROM q WHERE contains(qname, '::')), l AS (SELECT qname, max(id) AS parent FROM q GROUP BY qname) SELECT parent, id FROM u JOIN l ON l.qname = u.up""")
def contains_tree(spark, d):
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    rn = n.join(r, n.n_regionkey == r.r_regionkey)
    rows = r.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("qname"))
    rows = rows.unionByName(rn.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.concat_ws("::", "r_name", "n_name").alias("qname")))
    rows = rows.unionByName(s.join(rn, s.s_nationkey == rn.n_nationkey).select((F.col("s_suppkey") + 1000).alias("id"), F.concat_ws("::", "r_name", "n_name", "s_name").alias("qname")))
    return edges.contains_edges(rows)


@query(f"""WITH RECURSIVE inh AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation),
cl(id, ancestor) AS (SELECT src, dst FROM inh WHERE src <> dst UNION SELECT cl.id, inh.dst FROM cl JOIN inh ON inh.src = cl.ancestor),
m AS (SELECT n AS class_id, name, min(id) AS id FROM (SELECT c_nationkey AS n, c_mktsegment AS name, c_custkey AS id FROM customer) GROUP BY 1, 2)
SELECT DISTINCT a.id AS src, b.id AS dst FROM cl JOIN m a ON a.class_id = cl.id JOIN m b ON b.class_id = cl.ancestor AND a.name = b.name WHERE cl.id <> cl.ancestor""")
def overrides_edges(spark, d):
    inh = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst"))
    m = table(spark, d, "customer").select(F.col("c_nationkey").alias("class_id"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("id"))
    return edges.overrides(inh, m)


@query(f"""WITH {SYMBOLS}, r AS (SELECT p_brand AS file, s, s + 40 AS e FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest([10, 200, 900]) AS s))
SELECT id, CAST(sum(least(line_end, e) - greatest(line_start, s) + 1) AS BIGINT) AS overlap FROM symbols JOIN r USING (file) WHERE line_start <= e AND line_end >= s GROUP BY id""")
def span_overlap(spark, d):
    r = table(spark, d, "part").select(F.col("p_brand").alias("file")).distinct().select("file", F.explode(F.array(*(F.lit(x).cast("long") for x in (10, 200, 900)))).alias("s"))
    return edges.overlapping(r.withColumn("e", F.col("s") + 40), symbols(spark, d))


@query(f"""WITH {SYMBOLS}, pt AS (SELECT p_partkey AS point, p_brand AS file, p_partkey + 20 AS line FROM part)
SELECT point, arg_min(id, (line_end - line_start, id)) AS id FROM pt JOIN symbols USING (file) WHERE line BETWEEN line_start AND line_end GROUP BY point""")
def enclosing_span(spark, d):
    pt = table(spark, d, "part").select(F.col("p_partkey").alias("point"), F.col("p_brand").alias("file"), (F.col("p_partkey") + 20).alias("line"))
    return edges.enclosing(pt, symbols(spark, d))


@query(f"""WITH {SYMBOLS}, pt AS (SELECT p_partkey AS point, p_brand AS file, p_partkey + 3 AS line FROM part)
SELECT point, arg_min(id, (line_start, id)) AS id FROM pt JOIN symbols USING (file) WHERE line_start > line AND line_start <= line + 15 GROUP BY point""")
def next_definition(spark, d):
    pt = table(spark, d, "part").select(F.col("p_partkey").alias("point"), F.col("p_brand").alias("file"), (F.col("p_partkey") + 3).alias("line"))
    return edges.next_start(pt, symbols(spark, d))


@query(f"""WITH {SYMBOLS}, b AS (SELECT p_brand AS file, p_partkey + 1 AS line, CASE WHEN p_size % 10 <> 0 THEN 1000000 + p_partkey * 7 % 1000 END AS ts FROM part),
h AS (SELECT id, line, ts FROM symbols JOIN b USING (file) WHERE line BETWEEN line_start AND line_end)
SELECT id, coalesce(arg_min_null(ts, line), min(ts)) AS first_ts, CASE WHEN bool_or(ts IS NULL) THEN NULL ELSE max(ts) END AS last_ts FROM h GROUP BY id""")
def symbol_history(spark, d):
    ts = F.when(F.col("p_size") % 10 != 0, 1000000 + F.col("p_partkey") * 7 % 1000)
    b = table(spark, d, "part").select(F.col("p_brand").alias("file"), (F.col("p_partkey") + 1).alias("line"), ts.alias("ts"))
    return edges.symbol_history(b, symbols(spark, d))


@query(f"""WITH {CALLS} SELECT a.p_brand AS a, b.p_brand AS b, CAST(sum(n) AS BIGINT) AS weight, max(confidence) AS confidence FROM calls JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2""")
def lod_edges(spark, d):
    g = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"))
    return edges.aggregate_edges(calls(spark, d).withColumnRenamed("n", "weight"), g)


@query("SELECT p_brand AS file, round(avg(p_retailprice), 6) AS x, round(avg(CAST(p_size AS DOUBLE)), 6) AS y, count(*) AS size, max(abs(p_retailprice)) AS extent FROM part GROUP BY p_brand")
def lod_files(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.round(F.avg("p_retailprice"), 6).alias("x"), F.round(F.avg("p_size"), 6).alias("y"), F.count(F.lit(1)).alias("size"), F.max(F.abs("p_retailprice")).alias("extent"))


@query(f"""WITH {CALLS}, v AS (SELECT id, grp, count(*) AS n FROM (SELECT src AS id, dst AS o FROM calls UNION ALL SELECT dst, src FROM calls) JOIN (SELECT p_partkey AS o, p_brand AS grp FROM part) USING (o) GROUP BY 1, 2)
SELECT id, arg_min(grp, (-n, grp)) AS grp FROM v GROUP BY id""")
def neighbour_majority(spark, d):
    return edges.majority(calls(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp")))


@query("""SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def stats_counts(spark, d):
    out = None
    for t in ("customer", "part", "orders", "lineitem"):
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {CALLS}, {SYMBOLS} SELECT a.file AS src_file, b.file AS dst_file, count(*) AS calls FROM calls JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file <> b.file GROUP BY 1, 2 ORDER BY calls DESC, src_file, dst_file LIMIT 500""")
def cluster_links(spark, d):
    s = symbols(spark, d).select("id", "file")
    j = calls(spark, d).join(s.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(s.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    return j.where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "src_file", "dst_file").limit(500)


@query(f"""WITH {CALLS}, {SYMBOLS} SELECT id, name, count(*) AS external_callers FROM calls JOIN symbols ON id = dst JOIN part p ON p.p_partkey = src WHERE file = 'Brand#17' AND p.p_brand <> 'Brand#17' GROUP BY 1, 2 ORDER BY external_callers DESC, id LIMIT 25""")
def cluster_api(spark, d):
    s = symbols(spark, d)
    own = s.where("file = 'Brand#17'").select("id", "name")
    out = calls(spark, d).join(own.select(F.col("id").alias("src")), "src", "left_anti").join(own.withColumnRenamed("id", "dst"), "dst")
    return out.groupBy(F.col("dst").alias("id"), "name").agg(F.count(F.lit(1)).alias("external_callers")).orderBy(F.desc("external_callers"), "id").limit(25)


@query("""SELECT p_partkey AS id, p_name AS name, n_handlers, o FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_handlers, min(l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40 GROUP BY 1) ON l_partkey = p_partkey""")
def route_map_left(spark, d):
    h = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 40").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_handlers"), F.min("l_orderkey").alias("o"))
    p = table(spark, d, "part")
    return p.join(h, p.p_partkey == h.l_partkey, "left").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "n_handlers", "o")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def update_by_key(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return tables.update_columns(p, "id", p.where("id % 7 = 0").select("id", (F.col("p_size") + 100).alias("p_size")))


@query(f"WITH {CALLS} SELECT src, dst, confidence FROM calls WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4') AND dst NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4')")
def delete_touching(spark, d):
    gone = table(spark, d, "part").where("p_brand = 'Brand#4'").select(F.col("p_partkey").alias("id"))
    return tables.delete_touching(calls(spark, d), gone).select("src", "dst", "confidence")


@query(f"""WITH {CALLS}, x AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT src, dst, CASE WHEN x.src IS NOT NULL THEN 1.0 ELSE confidence END AS confidence, CASE WHEN x.src IS NOT NULL THEN 'scip' ELSE 'unique_global' END AS method FROM calls LEFT JOIN x USING (src, dst)
UNION ALL SELECT src, dst, 1.0, 'scip' FROM x ANTI JOIN calls USING (src, dst)""")
def upgrade_calls(spark, d):
    x = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return tables.upgrade_calls(calls(spark, d).select("src", "dst", "confidence", F.lit("unique_global").alias("method")), x)


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS state
FROM (SELECT doc_id, sha1(text) AS h FROM documents WHERE doc_id % 11 <> 0) a FULL JOIN (SELECT doc_id, sha1(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0) b USING (doc_id) WHERE coalesce(a.doc_id, b.doc_id) IS NOT NULL""")
def change_detect(spark, d):
    # two versions of the whole table: some rows added, some gone, some edited
    docs = table(spark, d, "documents")
    now = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.sha1(F.col("text").cast("binary")).alias("hash"))
    was = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), F.sha1(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary")).alias("hash"))
    return tables.changes_since(was, now)


@query("""WITH l AS (SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
p AS (SELECT doc_id, line, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM l)
SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM p WHERE trim(line) <> '' GROUP BY 1, 2""")
def paragraphs(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return edges.per_line_changes(lines, "doc_id").groupBy("doc_id", F.col("paragraph").cast("long").alias("paragraph")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))
