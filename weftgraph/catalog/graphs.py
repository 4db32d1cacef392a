"""Traversals, impact, health and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog.base import CALLS, SYMBOLS, calls, query, symbols, table
from weftgraph.catalog.ranking import ITERATIONS, PAGERANK, ranks
from weftgraph.functions import risk
from weftgraph.operators import community, health, lookup, traverse


def _bfs(name: str, seed: str, depth: int, direction: str = "out", where: str = "") -> str:
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    hop = f"SELECT {a} AS s, {b} AS t FROM calls {where}" + (f" UNION SELECT {b}, {a} FROM calls {where}" if direction == "both" else "")
    return f"{name}_h AS ({hop}), {name}_w(id, depth) AS (SELECT id, 0 FROM ({seed}) UNION SELECT t, depth + 1 FROM {name}_w JOIN {name}_h ON s = id WHERE depth < {depth}), {name} AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM {name}_w GROUP BY id)"


_ONE = "SELECT CAST(7 AS BIGINT) AS id"


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@query(f"WITH RECURSIVE {CALLS}, {_bfs('w', _ONE, 2)}, p AS (SELECT w.id, w.depth, min(src) AS parent FROM w LEFT JOIN (SELECT src, dst, depth FROM calls JOIN w ON w.id = src) c ON c.dst = w.id AND c.depth = w.depth - 1 GROUP BY 1, 2) SELECT id, depth, CASE WHEN depth > 0 THEN parent END AS parent FROM p")
def bfs_depth(spark, d):
    return traverse.frontier(_seed(spark, 7).select(F.lit(0).alias("seed"), "id"), calls(spark, d), 2).select("id", "depth", "parent")


@query(f"WITH RECURSIVE {CALLS}, {_bfs('f', _ONE, 2)}, {_bfs('b', _ONE, 2, 'in')} SELECT 'callees' AS side, id, depth FROM f UNION ALL SELECT 'callers', id, depth FROM b WHERE depth > 0")
def call_graph(spark, d):
    return traverse.call_graph(calls(spark, d), _seed(spark, 7), 2)


@query(f"WITH RECURSIVE {CALLS}, {_bfs('w', _ONE, 3, 'in', 'WHERE confidence >= 0.8')} SELECT id, depth FROM w WHERE depth > 0")
def impact_reach(spark, d):
    return traverse.frontier(_seed(spark, 7).select(F.lit(0).alias("seed"), "id"), calls(spark, d), 3, direction="in", min_confidence=0.8).where("depth > 0").select("id", "depth")


@query(f"WITH {CALLS} SELECT id, round(pr, 9) AS pagerank FROM ({PAGERANK} SELECT id, pr FROM r{ITERATIONS}) WHERE id IN (SELECT src FROM calls WHERE dst = 7) ORDER BY pagerank DESC, id")
def impact_callers(spark, d):
    into = calls(spark, d).where("dst = 7").select(F.col("src").alias("id")).distinct()
    return ranks(spark, d).join(into, "id", "left_semi").select("id", F.round("pagerank", 9).alias("pagerank"))


@query(f"WITH RECURSIVE {CALLS}, {SYMBOLS}, {_bfs('w', _ONE, 3, 'in', 'WHERE confidence >= 0.7')} SELECT id, min(depth) AS depth FROM (SELECT w.id, depth FROM w JOIN symbols USING (id) WHERE is_test AND depth > 0 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 7) AND p_type = 'PROMO' AND p_partkey <> 7) GROUP BY id")
def test_impact(spark, d):
    s = symbols(spark, d)
    name = s.where("id = 7").select("name")
    tests = s.where("is_test AND id <> 7").join(name, "name", "left_semi").select(F.col("id").alias("src"), F.lit(7).cast("long").alias("dst"))
    return traverse.test_impact(calls(spark, d).where("confidence >= 0.7"), tests, s, _seed(spark, 7), 3)


@query(f"WITH RECURSIVE {CALLS}, {_bfs('w', _ONE, 12, 'out', 'WHERE confidence >= 0.7')} SELECT CAST(depth AS INT) AS hops FROM w WHERE id = 1234 AND depth > 0")
def trace_length(spark, d):
    walk = traverse.frontier(_seed(spark, 7).select(F.lit(0).alias("seed"), "id"), calls(spark, d), 12, min_confidence=0.7)
    return walk.where("id = 1234 AND depth > 0").select(F.col("depth").alias("hops"))


@query()
def shortest_trace(spark, d):
    return traverse.trace(calls(spark, d), _seed(spark, 7), _seed(spark, 42))


@query(f"WITH RECURSIVE {CALLS}, {_bfs('w', 'SELECT CAST(unnest([7, 11]) AS BIGINT) AS id', 1, 'both')} SELECT id, depth, round(1.0 / (depth + 1) + 0.5 * pr, 9) AS score FROM w JOIN ({PAGERANK} SELECT id, pr FROM r{ITERATIONS}) USING (id) ORDER BY score DESC, id LIMIT 50")
def explore(spark, d):
    return traverse.explore(calls(spark, d), _seed(spark, 7, 11), ranks(spark, d), 1, 50)


@query(f"WITH RECURSIVE {CALLS}, {_bfs('w', _ONE, 2, 'both')} SELECT depth, count(*) AS n FROM w GROUP BY depth")
def node_neighbors(spark, d):
    walk = traverse.frontier(_seed(spark, 7).select(F.lit(0).alias("seed"), "id"), calls(spark, d), 2, direction="both")
    return walk.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CALLS}, {SYMBOLS} SELECT src, s.file || '::' || s.name AS qname, confidence FROM calls JOIN symbols s ON s.id = src JOIN symbols t ON t.id = dst WHERE t.name = 'red widget'")
def references_1hop(spark, d):
    s = symbols(spark, d)
    e = calls(spark, d).select(F.lit("CALLS").alias("rel"), "src", "dst", "confidence")
    hit = lookup.references(s.withColumn("qname", F.concat_ws("::", "file", "name")), e, "red widget")
    return hit.join(s.select(F.col("id").alias("src"), F.concat_ws("::", "file", "name").alias("qname")), "src").select("src", "qname", "confidence")


@query(f"WITH {CALLS} SELECT id, min(rel) AS rel FROM (SELECT dst AS id, 'CALLS' AS rel FROM calls WHERE src = 7 UNION ALL SELECT src, 'CALLS' FROM calls WHERE dst = 7 UNION ALL SELECT p_partkey, 'CONTAINS' FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 7) AND p_partkey <> 7) WHERE id <> 7 GROUP BY id")
def neighborhood(spark, d):
    s = symbols(spark, d).withColumn("qname", F.concat_ws("::", F.lit("n"), F.col("id").cast("string")))
    kin = s.where("id <> 7").join(s.where("id = 7").select("name"), "name", "left_semi").select(F.lit("CONTAINS").alias("rel"), F.lit(7).cast("long").alias("src"), F.col("id").alias("dst"))
    e = calls(spark, d).select(F.lit("CALLS").alias("rel"), "src", "dst").unionByName(kin)
    return lookup.neighborhood(s, e, spark.createDataFrame([], "id long, pagerank double"), "n::7", ("CALLS", "CONTAINS")).select("id", "rel")


@query(f"WITH {CALLS}, {SYMBOLS} SELECT id, p_retailprice AS pagerank FROM symbols JOIN part ON p_partkey = id WHERE NOT is_test AND id NOT IN (SELECT dst FROM calls WHERE confidence >= 0.75)")
def entry_points_anti(spark, d):
    price = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pagerank"))
    return traverse.entry_points(symbols(spark, d), calls(spark, d).where("confidence >= 0.75"), price)


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT src, dst FROM calls WHERE confidence >= 0.95), n AS (SELECT unnest([7, 8, 9]) AS id),
w(entry, id, depth) AS (SELECT id, id, 0 FROM n UNION SELECT entry, e.dst, depth + 1 FROM w JOIN e ON src = w.id WHERE depth < 8),
u AS (SELECT entry, id, min(depth) AS depth FROM w WHERE entry IN (SELECT src FROM e WHERE dst <> src) GROUP BY entry, id)
SELECT CAST(entry AS BIGINT) AS entry, CAST(row_number() OVER (PARTITION BY entry ORDER BY depth, id) AS INT) AS position, id, CAST(depth AS INT) AS depth FROM u QUALIFY row_number() OVER (PARTITION BY entry ORDER BY depth, id) <= 50""")
def processes(spark, d):
    return traverse.flows(_seed(spark, 7, 8, 9), calls(spark, d).where("confidence >= 0.95"), 8).select("entry", "position", "id", "depth")


@query("""WITH RECURSIVE inh AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 3 + 2) % 25 FROM nation),
cl(id, ancestor) AS (SELECT src, dst FROM inh WHERE src <> dst UNION SELECT cl.id, inh.dst FROM cl JOIN inh ON inh.src = cl.ancestor) SELECT id, ancestor FROM cl WHERE id <> ancestor""")
def inheritance_closure(spark, d):
    n = table(spark, d, "nation")
    e = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst")).unionByName(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + 2) % 25).alias("dst")))
    return traverse.closure(e)


def _cycle(n: int) -> str:
    """Cycles of n names as one join per step, each starting at its smallest name."""
    hop = [f"g h{k}" for k in range(n)]
    follow = [f"h{k}.b = h{k + 1}.a" for k in range(n - 1)] + [f"h{n - 1}.b = h0.a"]
    least = [f"h0.a < h{k}.a" for k in range(1, n)]
    differ = [f"h{i}.a <> h{j}.a" for i in range(1, n) for j in range(i + 1, n)]
    return f"SELECT CAST({n} AS INT) AS length, {" || ' > ' || ".join(f'h{k}.a' for k in range(n))} AS path FROM {', '.join(hop)} WHERE {' AND '.join(follow + least + differ)}"


@query(f"""WITH e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * k + k - 1) % 25 AS dst FROM nation, (SELECT unnest([2, 3]) AS k)), g AS (SELECT a.n_name AS a, b.n_name AS b FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE src <> dst)
{' UNION ALL '.join(map(_cycle, range(2, 7)))}""")
def short_cycles(spark, d):
    n = table(spark, d, "nation")
    e = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst")).unionByName(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + 2) % 25).alias("dst")))
    return traverse.short_cycles(e, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 6)


@query(f"""WITH {SYMBOLS} SELECT id, line_end - line_start + 1 AS lines FROM (SELECT * FROM symbols ORDER BY line_end - line_start DESC, id LIMIT 100) WHERE line_end - line_start + 1 >= 50""")
def large_spans(spark, d):
    return health.large(symbols(spark, d), 100, 50).select("id", "lines")


@query(f"WITH {CALLS}, {SYMBOLS}, e AS (SELECT src, dst FROM calls WHERE confidence >= 0.5), g AS (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id) SELECT g.id, fan_in, fan_out, fan_in + fan_out AS degree FROM g JOIN symbols USING (id) WHERE NOT is_test ORDER BY degree DESC, id LIMIT 25")
def hubs(spark, d):
    return health.hubs(symbols(spark, d), calls(spark, d), 25)


@query(f"WITH {CALLS}, {SYMBOLS} SELECT id, name FROM symbols WHERE label = 'Function' AND NOT is_test AND id NOT IN (SELECT dst FROM calls WHERE confidence >= 0.9)")
def dead_code(spark, d):
    s = symbols(spark, d).withColumn("qname", F.concat_ws("::", "file", "name"))
    return health.dead_code(s, calls(spark, d).where("confidence >= 0.9")).select("id", "name")


@query(f"""WITH RECURSIVE {CALLS}, {SYMBOLS}, top AS (SELECT id, p_retailprice AS pagerank FROM symbols JOIN part ON p_partkey = id WHERE label = 'Function' AND NOT is_test ORDER BY p_retailprice DESC, id LIMIT greatest(100, (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM symbols WHERE label = 'Function' AND NOT is_test))),
cov AS (SELECT DISTINCT dst AS id FROM calls JOIN symbols ON id = src WHERE is_test AND confidence >= 0.8)
SELECT id, pagerank FROM top WHERE id NOT IN (SELECT id FROM cov) ORDER BY pagerank DESC, id LIMIT 25""")
def untested_hotspots(spark, d):
    price = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pagerank"))
    none = spark.createDataFrame([], "src long, dst long")
    return health.untested(symbols(spark, d), calls(spark, d).where("confidence >= 0.8"), price, none, 25, hops=1)


_RISK = f"""WITH {CALLS}, {SYMBOLS}, c AS (SELECT dst AS id, count(*) AS callers FROM calls GROUP BY dst), pc AS (SELECT p_partkey AS id, (SELECT count(*) FROM part q WHERE q.p_retailprice < p.p_retailprice) / CAST((SELECT count(*) FROM part) AS DOUBLE) AS pct FROM part p),
s AS (SELECT id, file, least(100.0, round(round(25.0 * round(pct, 9) + least(25.0, 5.0 * log2(1.0 + coalesce(callers, 0))) + least(20.0, 7.0 * (id % 2) + 3.0 * (id % 3)) + CASE id % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 8.0 ELSE 0.0 END + least(10.0, (line_end - line_start + 1) / 5.0), 6), 1)) AS score FROM symbols JOIN pc USING (id) LEFT JOIN c USING (id))"""


def _risk(spark, d):
    from weftgraph.operators.rank import percentile_below

    s = symbols(spark, d)
    callers = calls(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    pct = percentile_below(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "id", "p_retailprice")
    rows = s.join(pct, "id").join(callers, "id", "left")
    score = risk.symbol_score(percentile=F.col("below"), callers=F.coalesce("callers", F.lit(0)), routes=F.col("id") % 2, entries=F.col("id") % 3, tests=F.col("id") % 4, lines=F.col("line_end") - F.col("line_start") + 1)
    return rows.select("id", "file", score.alias("score"))


@query(f"{_RISK} SELECT id, score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM s")
def risk_score(spark, d):
    return _risk(spark, d).select("id", "score", risk.level(F.col("score")).alias("level"))


@query(f"{_RISK} SELECT file, least(100.0, round(max(score) + 0.1 * (sum(score) - max(score)), 1)) AS risk FROM s GROUP BY file")
def overall_risk(spark, d):
    return _risk(spark, d).groupBy("file").agg(risk.overall("score").alias("risk"))


@query(f"""WITH {CALLS}, m AS (SELECT p_partkey AS id, p_brand AS community FROM part), u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(n) AS DOUBLE) AS weight FROM calls GROUP BY 1, 2),
j AS (SELECT x.community AS ca, y.community AS cb, weight FROM u JOIN m x ON x.id = a JOIN m y ON y.id = b), s AS (SELECT ca AS c, cb AS o, weight FROM j UNION ALL SELECT cb, ca, weight FROM j),
t AS (SELECT c AS community, sum(CASE WHEN c = o THEN weight / 2 ELSE 0 END) AS internal, sum(CASE WHEN c = o THEN 0 ELSE weight END) AS cut FROM s GROUP BY c)
SELECT community, size, internal, cut, round(internal / (internal + cut), 4) AS cohesion FROM t JOIN (SELECT community, count(*) AS size FROM m GROUP BY 1) USING (community)""")
def community_cohesion(spark, d):
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return community.cohesion(m, calls(spark, d).select("src", "dst", F.col("n").cast("double").alias("weight")))


@query()
def communities(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))
    return community.detect(p, calls(spark, d).select("src", "dst", F.col("confidence").alias("weight")))


@query()
def betweenness_brands(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"))
    e = calls(spark, d).where("confidence >= 0.98").join(b.select(F.col("id").alias("src"), F.col("grp").alias("a")), "src").join(b.select(F.col("id").alias("dst"), F.col("grp").alias("b")), "dst")
    return health.betweenness(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst").distinct())
