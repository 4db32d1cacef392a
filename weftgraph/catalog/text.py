"""Text and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog.base import query, table
from weftgraph.functions import geometry, text

#: Tokens in DuckDB: two replacements stand in for look-around.
_TOK = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) >= 2)"
TOKENS = _TOK.format(x="coalesce(text, '')")


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def token_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def doc_freq(spark, d):
    from weftgraph.operators.search import term_statistics

    return term_statistics(table(spark, d, "documents"), "text")


@query(f"SELECT doc_id AS id, count(*) AS terms, max(tf) AS top_tf, CAST(sum(tf) AS BIGINT) AS length FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def term_postings(spark, d):
    from weftgraph.operators.search import postings

    docs = table(spark, d, "documents")
    rows = postings(docs, "doc_id", "text")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        rows = rows.groupBy("id", "term").agg(F.sum("tf").alias("tf"))  # several rows are one document
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.max("tf").alias("top_tf"), F.sum("tf").alias("length"))


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT p_partkey AS id, array_to_string(list_distinct_ordered, ' ') AS terms FROM (SELECT p_partkey, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, {_TOK.format(x='''p_name || p_brand || 'HTTPServer' || p_type''')} AS t FROM part))")
def symbol_terms(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.terms(F.concat("p_name", "p_brand", F.lit("HTTPServer"), "p_type")).alias("terms"))


@query("SELECT p_partkey AS id, sha1('hashed' || chr(0) || p_name) AS ehash FROM part")
def content_hashes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.content_hash(F.lit("hashed"), F.col("p_name")).alias("ehash"))


@query("SELECT doc_id, sha1(coalesce(text, '')) AS hash, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM documents")
def file_hashes(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha1(t.cast("binary")).alias("hash"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


_PATHS = "SELECT p_partkey AS id, p_name, lower(p_type) || '/' || replace(p_brand, '#', '_') || '/' || CASE WHEN p_size % 5 = 0 THEN '__init__.py' WHEN p_size % 5 = 1 THEN 'index.ts' ELSE replace(p_name, ' ', '_') || '.py' END AS path FROM part"


def _paths(spark, d):
    last = F.when(F.col("p_size") % 5 == 0, "__init__.py").when(F.col("p_size") % 5 == 1, "index.ts").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.concat_ws("/", F.lower("p_type"), F.replace("p_brand", F.lit("#"), F.lit("_")), last).alias("path"))


@query(f"""WITH p AS ({_PATHS}), s AS (SELECT *, string_split(path, '/') AS c FROM p), b AS (SELECT *, regexp_replace(c[-1], '\\.(pyi?|jsx?|tsx?|mjs|cjs)$', '') AS base FROM s)
SELECT id, CASE WHEN base IN ('__init__', 'index', 'mod') THEN c[-2] ELSE base END AS stem, c[1] AS bucket1, c[1] || '/' || c[2] AS bucket2, regexp_extract(path, '[^./]*$') AS tail FROM b""")
def path_functions(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("id", text.stem(p).alias("stem"), text.module_bucket(p, 1).alias("bucket1"), text.module_bucket(p, 2).alias("bucket2"), text.module_tail(p).alias("tail"))


@query(f"""WITH p AS ({_PATHS}) SELECT string_split(path, '/')[1] AS module, count(*) AS files, count(DISTINCT path) AS paths FROM p GROUP BY 1""")
def module_buckets(spark, d):
    return _paths(spark, d).groupBy(text.module_bucket(F.col("path"), 1).alias("module")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("path").alias("paths"))


@query("""SELECT c_custkey AS id, lower(replace('test_' || c_name, '_', '')) AS norm, regexp_replace('Test__' || c_name, '^test_*', '', 'i') AS target,
       regexp_replace(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer""")
def name_functions(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.name_norm(F.concat(F.lit("test_"), n)).alias("norm"), text.test_target(F.concat(F.lit("Test__"), n)).alias("target"), text.slug(F.concat_ws(" ", n, "c_mktsegment")).alias("slug"))


@query("SELECT event_id, strftime(to_timestamp(epoch(ts)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM events")
def event_days(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", text.utc_day(F.col("ts"), e.schema["ts"].dataType.simpleString() == "timestamp").alias("day"))


@query("SELECT doc_id, CASE WHEN length(text) <= 1300 THEN text ELSE left(text, 900) || chr(10) || '…' || chr(10) || right(text, 400) END AS sample FROM documents")
def body_samples(spark, d):
    return table(spark, d, "documents").select("doc_id", text.body_sample(F.col("text")).alias("sample"))


@query("""SELECT p_partkey AS id, left('Function ' || p_name || chr(10) || p_brand || '::' || p_name || chr(10) || p_type, 2200) AS text FROM part""")
def embedding_texts(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.embedding_text(F.lit("Function"), F.col("p_name"), none, F.concat_ws("::", "p_brand", "p_name"), F.lit(""), F.col("p_type")).alias("text"))


@query("SELECT doc_id, round((CAST(contains(lower(text), 'and') AS INT) + CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'license') AS INT)) / 3.0, 6) AS recall FROM documents")
def keyword_recall(spark, d):
    words = F.array(F.lit("and"), F.lit("the"), F.lit("License"))
    return table(spark, d, "documents").select("doc_id", F.round(text.keyword_recall(F.col("text"), words), 6).alias("recall"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) AS href FROM pages),
r AS (SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/]+') || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target FROM l)
SELECT page_id, count(*) AS links, count(DISTINCT target) AS targets FROM r GROUP BY page_id""")
def page_links(spark, d):
    from weftgraph.sources.web import links

    return links(table(spark, d, "pages"), "page_id", "url", "html").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("target").alias("targets"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) AS href FROM pages),
t AS (SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/]+') || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target FROM l),
r AS (SELECT DISTINCT page_id, regexp_replace(target, '[#].*$', '') AS target FROM t),
host AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
SELECT host AS src_host, count(*) AS edges, count(DISTINCT target) AS targets FROM r JOIN host USING (page_id) GROUP BY host""")
def links_to_hosts(spark, d):
    from weftgraph.sources.web import links

    pages = table(spark, d, "pages")
    got = links(pages, "page_id", "url", "html").select("page_id", F.regexp_replace("target", "#.*$", "").alias("target")).distinct()
    host = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("src_host"))
    return got.join(host, "page_id").groupBy("src_host").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("target").alias("targets"))


def _blank(t: str, pattern: str) -> str:
    """A step of html_text in SQL: what the pattern finds goes, but for its line ends."""
    hits = f"list_transform(regexp_extract_all({t}, '{pattern}'), lambda h: regexp_replace(h, '[^\\n]+', '', 'g'))"
    return f"array_to_string(list_transform(list_zip(string_split_regex({t}, '{pattern}'), list_concat({hits}, [''])), lambda z: z[1] || coalesce(z[2], '')), '')"


@query(f"""WITH a AS (SELECT page_id, {_blank("coalesce(html, '')", r"(?is)<(?:script|style)" + chr(92) + r"b.*?</(?:script|style)" + chr(92) + "s*>")} AS t FROM pages), b AS (SELECT page_id, {_blank("t", "(?s)<!--.*?-->")} AS t FROM a), c AS (SELECT page_id, {_blank("t", "(?s)<[^>]*>")} AS t FROM b)
SELECT page_id, length(t) AS n_chars, sha1(t) AS hash FROM (SELECT page_id, trim(regexp_replace(t, '[ \t]+', ' ', 'g')) AS t FROM c)""")
def html_text(spark, d):
    t = table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha1(F.col("t").cast("binary")).alias("hash"))


@query("""WITH g AS (SELECT p_partkey AS id, CAST(least(greatest(floor((p_retailprice - 900.0) / 1200.0 * 65536), 0), 65535) AS BIGINT) AS x, CAST(least(greatest(floor((p_size - 1) / 50.0 * 65536), 0), 65535) AS BIGINT) AS y FROM part),
s AS (SELECT id, x, y, (SELECT CAST(sum(((x >> i) & 1) << (2 * i)) AS BIGINT) FROM range(16) r(i)) AS mx, (SELECT CAST(sum(((y >> i) & 1) << (2 * i)) AS BIGINT) FROM range(16) r(i)) AS my FROM g)
SELECT id, x, y, mx | (my << 1) AS code, (mx | (my << 1)) >> 26 AS tile FROM s""")
def morton_tiles(spark, d):
    p = table(spark, d, "part")
    g = p.select(F.col("p_partkey").alias("id"), geometry.quantise(F.col("p_retailprice"), 900.0, 2100.0).alias("x"), geometry.quantise(F.col("p_size").cast("double"), 1.0, 51.0).alias("y"))
    code = geometry.morton(F.col("x"), F.col("y"))
    return g.select("id", "x", "y", code.alias("code"), F.shiftright(code, 26).alias("tile"))


@query("""SELECT p_partkey AS id, round(10.0 * sqrt(i) * cos(i * 2.399963229728653), 6) AS x, round(10.0 * sqrt(i) * sin(i * 2.399963229728653), 6) AS y
FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)""")
def spiral_layout(spark, d):
    from pyspark.sql import Window

    i = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i")
    x, y = geometry.spiral(F.col("i"))
    return table(spark, d, "part").select("p_partkey", i).select(F.col("p_partkey").alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT c_custkey AS id, round(CAST('0x' || left(sha1(c_name), 8) AS BIGINT) / 4294967295.0, 9) AS place FROM customer")
def path_places(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(geometry.hash01(F.col("c_name")), 9).alias("place"))


@query(r"""SELECT page_id, regexp_matches(url, '^(https?)://(m\.)') AS mobile, regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^(.*/)?en(/.*)?$') AS ignored FROM pages""")
def ignore_globs(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", url.rlike(r"^(https?)://(m\.)").alias("mobile"), text.matches_any(F.regexp_replace(url, "^[a-z]+://", ""), ["en"]).alias("ignored"))
