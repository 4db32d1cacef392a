"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; run() writes each result to the shared folder and
reads it back as the next one's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.llm import decontaminate, langid, neardup, packing, pii
from weftgraph.llm.registry import TOKENIZER
from weftgraph.llm.shared import cut, free_names, scratch_path

#: Texts whose chosen language has less of their letters than this are rejected.
LEAST_LANGUAGE_SHARE = 0.5
#: A document leaks if it holds windows of so many items, or so much of one item's windows.
LEAK_ITEMS, LEAK_SHARE = 2, 0.5
#: Or if it quotes so many words of items, however long these are: words of shorter windows, with so many words between at most.
LEAK_RUN, LEAK_WINDOW, LEAK_GAP = 13, 5, 2


def _short_batches(spark: SparkSession) -> None:
    """This application's session hands texts to Python in short Arrow batches from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of a known language; null, letterless and undecided texts go."""
    _short_batches(spark)
    lang, score = free_names(docs.columns, "_lang", "_score")
    found = langid.label(docs, langid.train(docs), spans=False, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies; a null id is in no group."""
    _short_batches(spark)
    found = cut(neardup.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "kept")
    # not broadcast at any size: the ids that are kept grow with the documents
    kept = docs.join(found.where("kept").select("doc_id").hint("merge"), "doc_id", "left_semi")
    if found.where("kept AND rows > 1").limit(1).count():
        twice = found.where("rows > 1").select("doc_id")
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark items, or quote them at some length, if with words changed."""
    _short_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    prefix = "_"
    while free_names(docs.columns, *(names := [prefix + n for n in decontaminate.FOUND])) != names:
        prefix += "_"
    found = decontaminate.find_leaks(docs, items, prefix=prefix)
    left = found.where(~decontaminate.is_contaminated(LEAK_ITEMS, LEAK_SHARE, prefix)).select(*docs.columns)
    found = decontaminate.find_leaks(left, items, window=LEAK_WINDOW, prefix=prefix)
    return found.where(decontaminate.longest_quote(LEAK_GAP, prefix) < LEAK_RUN).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put kinds in the place of personal data; n_chars follows the text."""
    _short_batches(spark)
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 1024 tokens."""
    _short_batches(spark)
    import public_tokenizers

    pieces = packing.tokenize_pieces(docs, public_tokenizers.path(f"{TOKENIZER}.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return packing.pack(pieces)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: SQL can express neither the models nor the packing; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
