"""PageRank, percentiles, budgets and other orderings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from weftgraph.catalog.base import CALLS, SYMBOLS, calls, query, symbols, table
from weftgraph.operators import lookup, rank
from weftgraph.storage import once

ITERATIONS = 10


def _pagerank_sql(restart: str, rounds: int = ITERATIONS) -> str:
    """The iteration unrolled: one pair of table expressions per round."""
    parts = [CALLS.strip(), "nodes AS (SELECT p_partkey AS id FROM part)", f"base AS ({restart})", "deg AS (SELECT src, count(*) AS d FROM calls GROUP BY src)", "r0 AS (SELECT id, restart AS pr FROM base)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        parts.append(f"g{k} AS (SELECT dst AS id, sum({p}.pr / d) AS got FROM {p} JOIN deg ON deg.src = {p}.id JOIN calls ON calls.src = {p}.id GROUP BY dst)")
        parts.append(f"r{k} AS (SELECT b.id, 0.15 * b.restart + 0.85 * (coalesce(got, 0) + b.restart * (SELECT coalesce(sum(pr), 0) FROM {p} WHERE id NOT IN (SELECT src FROM deg))) AS pr FROM base b LEFT JOIN g{k} USING (id))")
    return "WITH " + ", ".join(parts)


_GLOBAL = "SELECT id, 1.0 / (SELECT count(*) FROM nodes) AS restart FROM nodes"
_FOCUS = "SELECT id, CASE WHEN p_brand = 'Brand#17' THEN 1.0 / (SELECT count(*) FROM part WHERE p_brand = 'Brand#17') ELSE 0.0 END AS restart FROM nodes JOIN part ON p_partkey = id"


def _ranks(spark, d):
    return rank.pagerank(table(spark, d, "part").select(F.col("p_partkey").alias("id")), calls(spark, d), iterations=ITERATIONS, tolerance=None)


def ranks(spark, d):
    """(id, pagerank) as a table: what ranks by it reads it, as it does the edges."""
    return once(spark, f"ranks {d}", lambda: _ranks(spark, d), order=["id"])


PAGERANK = _pagerank_sql(_GLOBAL)


@query(f"{PAGERANK} SELECT id, round(pr, 9) AS pagerank FROM r{ITERATIONS}")
def pagerank_10iter(spark, d):
    return _ranks(spark, d).select("id", F.round("pagerank", 9).alias("pagerank"))


@query(f"{_pagerank_sql(_FOCUS)} SELECT id, round(pr, 9) AS pagerank FROM r{ITERATIONS}")
def personalized_pagerank(spark, d):
    p = table(spark, d, "part")
    focus = p.where("p_brand = 'Brand#17'").select(F.col("p_partkey").alias("id"))
    return rank.pagerank(p.select(F.col("p_partkey").alias("id")), calls(spark, d), iterations=ITERATIONS, tolerance=None, focus=focus).select("id", F.round("pagerank", 9).alias("pagerank"))


@query()
def pagerank_converged(spark, d):
    return rank.pagerank(table(spark, d, "part").select(F.col("p_partkey").alias("id")), calls(spark, d))


@query(f"{PAGERANK} SELECT p_brand AS file, round(sum(pr), 9) AS pagerank, count(*) AS symbols FROM r{ITERATIONS} JOIN part ON p_partkey = id GROUP BY p_brand")
def file_rank_rollup(spark, d):
    return ranks(spark, d).join(symbols(spark, d).select("id", "file").hint("merge"), "id").groupBy("file").agg(F.round(F.sum("pagerank"), 9).alias("pagerank"), F.count(F.lit(1)).alias("symbols"))


@query("SELECT p_partkey AS id, round((SELECT count(*) FROM part q WHERE q.p_retailprice < p.p_retailprice) / CAST((SELECT count(*) FROM part) AS DOUBLE), 9) AS below FROM part p")
def percentile_below(spark, d):
    return rank.percentile_below(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "id", "p_retailprice")


@query(f"""WITH {SYMBOLS}, r AS (SELECT id, label, p_retailprice AS pr, row_number() OVER (PARTITION BY label ORDER BY p_retailprice DESC, id) AS k FROM symbols JOIN part ON p_partkey = id)
SELECT id, label, pr AS pagerank FROM r WHERE k <= CASE label WHEN 'Function' THEN 100 ELSE 40 END ORDER BY pr DESC, id LIMIT 200""")
def graph_dump(spark, d):
    price = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pagerank"))
    nodes, _ = lookup.graph_dump(symbols(spark, d), price, calls(spark, d), 200, {"Function": 0.5, "Class": 0.2})
    return nodes.select("id", "label", "pagerank")


@query(f"""WITH {CALLS}, {SYMBOLS}, r AS (SELECT id, label, p_retailprice AS pr, row_number() OVER (PARTITION BY label ORDER BY p_retailprice DESC, id) AS k FROM symbols JOIN part ON p_partkey = id),
n AS (SELECT id FROM r WHERE k <= CASE label WHEN 'Function' THEN 100 ELSE 40 END ORDER BY pr DESC, id LIMIT 200)
SELECT src, dst, confidence FROM calls WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def graph_dump_edges(spark, d):
    price = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pagerank"))
    _, inner = lookup.graph_dump(symbols(spark, d), price, calls(spark, d), 200, {"Function": 0.5, "Class": 0.2})
    return inner.select("src", "dst", "confidence")


@query(f"""WITH {SYMBOLS}, t AS (SELECT id, CAST(ceil(length(name || file) / 4.0) AS BIGINT) AS tokens, p_retailprice AS s FROM symbols JOIN part ON p_partkey = id WHERE NOT is_test),
c AS (SELECT id, tokens, sum(tokens) OVER (ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT * FROM t ORDER BY s DESC, id LIMIT 1500))
SELECT id, tokens, CAST(total AS BIGINT) AS total_tokens FROM c WHERE total <= 2000""")
def repo_map_budget(spark, d):
    from weftgraph.functions.text import estimate_tokens

    s = symbols(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("s")), "id").where("NOT is_test")
    top = s.select("id", estimate_tokens(F.concat("name", "file")).alias("tokens"), "s").orderBy(F.desc("s"), "id").limit(1500)
    return lookup.within_budget(top, "tokens", [F.desc("s"), "id"], 2000).select("id", "tokens", "total_tokens")


@query("""SELECT name, id FROM (SELECT p_name AS name, p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k = 1""")
def dedup_priority(spark, d):
    k = F.row_number().over(Window.partitionBy("p_name").orderBy(F.desc("p_size"), "p_partkey"))
    return table(spark, d, "part").withColumn("k", k).where("k = 1").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))


@query("""SELECT id, CASE WHEN k = 1 THEN name ELSE name || ' #' || k END AS name FROM (SELECT p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS k FROM part)""")
def name_suffixes(spark, d):
    k = F.row_number().over(Window.partitionBy("p_name").orderBy(F.desc("p_size"), "p_partkey"))
    p = table(spark, d, "part").withColumn("k", k)
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("k") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" #"), F.col("k").cast("string"))).alias("name"))


@query("""WITH s AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS k, lead(score) OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS second FROM s)
SELECT l_orderkey AS site, CASE WHEN score > 0 AND (second IS NULL OR score > second) THEN l_partkey END AS target FROM r WHERE k = 1""")
def strict_winner(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("score"))
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_partkey")
    r = s.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("k = 1")
    return r.select(F.col("l_orderkey").alias("site"), F.expr("CASE WHEN score > 0 AND (second IS NULL OR score > second) THEN l_partkey END").alias("target"))
