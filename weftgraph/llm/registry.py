"""The corpus operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Where the public tokenizers' package finds its files; a parameter of the packing operator.
TOKENIZER = "byte_bpe_50k"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftgraph.llm import packing

    pieces = packing.tokenize_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(f"{TOKENIZER}.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return packing.pack(pieces)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import neardup

    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import decontaminate

    return decontaminate.decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=8)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import substrings

    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=20, keep_text=False)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import suffixes

    return suffixes.remove_repeated_strings(_table(spark, sf_dir, "documents"), length=400, keep_bytes=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import langid

    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~_held_out()))
    out = langid.label(docs.select("doc_id", "text"), model, spans=False)
    return out.select("doc_id", _held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import pii

    return pii.report(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import warc

    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=1000).drop("url")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import neighbours

    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import licenses

    docs = _table(spark, sf_dir, "documents")
    # documents have no path of their own: source and language are their directories
    return licenses.scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_language_id": op2_language_id,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_license_scan": op4_license_scan,
        "op5_pii": op5_pii,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_warc": op9_warc,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
    }


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS head FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to
FROM d LEFT JOIN m USING (h)"""


def oracle_sql() -> dict[str, str]:
    from weftgraph.llm import licenses

    return {"op4_license_scan": licenses.oracle(), "op9_warc": WARC_SQL}
