"""Keyword, vector and fused retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from weftgraph.catalog.base import SYMBOLS, query, symbols, table
from weftgraph.catalog.text import TOKENS
from weftgraph.operators import keyword, search
from weftgraph.storage import once

QUESTION = "the licensed work under version"


def _bm25_sql(k1: float) -> str:
    return f"""
WITH t AS (SELECT doc_id, {TOKENS} AS tok FROM documents), st AS (SELECT count(*) AS n, avg(len(tok)) AS av FROM t),
q AS (SELECT unnest(['the', 'licensed', 'work', 'under', 'version']) AS term),
tf AS (SELECT doc_id, len(tok) AS dl, term, len(list_filter(tok, lambda x: x = term)) AS tf FROM t, q),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)
SELECT doc_id AS id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / av))) AS score
FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id"""


def _keywords(spark, d, k1):
    """Scores from the data folder's postings, of which a query reads its own terms' folders."""
    docs = table(spark, d, "documents")
    posted = once(spark, f"postings {d}", lambda: keyword.indexed(docs, "doc_id", "text"), "bucket", ["term", "id"], keyword.BUCKETS)
    n, average = once(spark, f"lengths {d}", lambda: keyword.lengths(docs, "doc_id", "text").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))).head()
    return keyword.score(keyword.of_terms(posted, keyword.query_terms(spark, QUESTION)), n, average, k1)


@query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql(1.5)})")
def bm25_scores(spark, d):
    return _keywords(spark, d, 1.5).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql(1.2)}) ORDER BY score DESC, id LIMIT 20")
def bm25_top(spark, d):
    return _keywords(spark, d, 1.2).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql(1.5)})")
def bm25_scan(spark, d):
    """Without an index: one scan counts the query's terms."""
    out = search.bm25(table(spark, d, "documents"), QUESTION, id_col="doc_id", text_col="text")
    return out.select("id", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT p_partkey AS id, 1.0 / (60 + row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)) AS part FROM part),
b AS (SELECT p_partkey AS id, 1.0 / (60 + row_number() OVER (ORDER BY p_size DESC, p_partkey)) AS part FROM part)
SELECT id, round(sum(part), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_fuse(spark, d):
    p = table(spark, d, "part")
    legs = [p.select(F.col("p_partkey").alias("id"), F.col(c).cast("double").alias("score")) for c in ("p_retailprice", "p_size")]
    return search.rrf(legs).select("id", F.round("rrf", 9).alias("rrf"))


_SIM = """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT src, dst, round(s, 6) AS score FROM p WHERE s >= {t} QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 5"""


def _similar(spark, d, threshold):
    out = search.similar(table(spark, d, "embeddings"), id_col="vec_id", threshold=threshold)
    return out.select("src", "dst", F.round("score", 6).alias("score"))


@query(_SIM.format(t=0.5))
def similar_threshold(spark, d):
    return _similar(spark, d, 0.5)


@query(_SIM.format(t=0.3))
def similar_topk(spark, d):
    return _similar(spark, d, 0.3)


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 6) AS score FROM embeddings, q""")
def vector_scan(spark, d):
    e = table(spark, d, "embeddings")
    v = e.where("vec_id = 0").select("embedding").head()[0]
    return search.vector_scores(e, v, "vec_id").select("id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT conv_id, turn, length(text) / 1000.0 AS s FROM conversations)
SELECT conv_id AS parent, round(max(s), 6) AS best, CAST(arg_min(turn, (-s, turn)) AS BIGINT) AS best_chunk, count(*) AS chunks FROM c GROUP BY conv_id""")
def chunk_max_pool(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") / 1000.0).alias("s"))
    best = F.min(F.struct((-F.col("s")).alias("s"), "turn")).getField("turn").cast("long")
    return c.groupBy(F.col("conv_id").alias("parent")).agg(F.round(F.max("s"), 6).alias("best"), best.alias("best_chunk"), F.count(F.lit(1)).alias("chunks"))


@query(f"""WITH {SYMBOLS} SELECT id, name, file, label FROM symbols WHERE lower(name) = 'red widget' ORDER BY id LIMIT 50""")
def name_probe(spark, d):
    return symbols(spark, d).where(F.lower("name") == "red widget").select("id", "name", "file", "label").orderBy("id").limit(50)


@query(f"""WITH {SYMBOLS} SELECT id, file || '::' || name AS qname, label, line_start, line_end FROM symbols WHERE file || '::' || name = 'Brand#17::red widget' OR name = 'blue bolt'""")
def definition(spark, d):
    from weftgraph.operators.lookup import definition

    s = symbols(spark, d).withColumn("qname", F.concat_ws("::", "file", "name"))
    return definition(s, "Brand#17::red widget").unionByName(definition(s, "blue bolt")).select("id", "qname", "label", "line_start", "line_end")


@query("""WITH q AS (SELECT doc_id AS qid, text FROM documents), g AS (SELECT doc_id, quality FROM labels),
r AS (SELECT g.doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY g.doc_id) AS rank FROM g JOIN q ON q.qid = g.doc_id)
SELECT quality, round(sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS recall_at_5, round(avg(1.0 / rank), 9) AS mrr FROM r GROUP BY quality""")
def retrieval_metrics(spark, d):
    from weftgraph.operators.lookup import retrieval_metrics

    got = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("quality").orderBy("doc_id")))
    return retrieval_metrics(ranked, "quality", "rank")


@query()
def hybrid_search(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    return search.hybrid(docs, "red widget", limit=10)


@query()
def hashed_embeddings(spark, d):
    return search.hashed_embedding(table(spark, d, "part"), id_col="p_partkey", text_col="p_name")
