"""A keyword index: postings in folders by term hash, with a small delta and tombstones between compactions.

A query reads the folders of its own terms and nothing else.  Every posting
carries the generation that wrote it; a tombstone of generation g hides what an
id had before g, so a change is a tombstone and new rows.  Document counts,
frequencies and the mean length are those of the live documents at any time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions.text import tokenize
from weftgraph.operators.search import postings
from weftgraph.sources.tables import GraphTables

BUCKETS = 64


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def indexed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, term, id, tf, length): postings to be written by bucket, in order of term."""
    return postings(docs, id_col, text_col).select(bucket(F.col("term")).alias("bucket"), "term", "id", "tf", "length")


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, length) of all documents, those without tokens included."""
    return docs.select(F.col(id_col).alias("id"), F.size(tokenize(F.col(text_col))).alias("length"))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    return sorted(set(spark.range(1).select(tokenize(F.lit(query))).head()[0]))


def of_terms(table: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of the terms: their folders by name, their rows by the order within."""
    spark = table.sparkSession
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term"))).distinct().collect()]
    return table.where(F.col("bucket").isin(folders) & F.col("term").isin(terms))


def score(found: DataFrame, n: int, average: float, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) from the postings (term, id, tf, length) of a query's terms; idf = ln(1 + (N - df + .5) / (df + .5))."""
    df = {r.term: r.n for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per term of the query
    if not df:
        return found.select("id", F.lit(0.0).alias("score")).limit(0)
    idf = F.create_map(*[F.lit(x) for t, k in df.items() for x in (t, math.log((n - k + 0.5) / (k + 0.5) + 1.0))])
    part = F.element_at(idf, F.col("term")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(average or 1.0))))
    return found.groupBy("id").agg(F.sum(part).alias("score"))


class KeywordIndex:
    """posting and length tables of a base, the same of a delta, and tombstones (id, gen)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, GraphTables(spark, root)

    def build(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        """Index all documents anew."""
        self._replace(indexed(docs, id_col, text_col).withColumn("gen", F.lit(0)), lengths(docs, id_col, text_col).withColumn("gen", F.lit(0)))

    def _replace(self, rows: DataFrame, sizes: DataFrame) -> None:
        self.tables.replace("posting", rows.repartition("bucket").sortWithinPartitions("bucket", "term", "id"), "bucket")
        self.tables.replace("length", sizes)
        rows, sizes = self.tables.read("posting"), self.tables.read("length")
        self.tables.replace("delta_posting", rows.limit(0), "bucket")
        self.tables.replace("delta_length", sizes.limit(0))
        self.tables.replace("tombstone", sizes.select("id", "gen").limit(0))
        self.tables.replace("generation", self.spark.createDataFrame([(0,)], "gen int"))

    def _next(self) -> int:
        gen = self.tables.read("generation").head()[0] + 1
        self.tables.replace("generation", self.spark.createDataFrame([(gen,)], "gen int"))
        return gen

    def remove(self, ids: DataFrame) -> None:
        """Hide documents (id); only the tombstones are rewritten."""
        dead = ids.select("id").distinct().withColumn("gen", F.lit(self._next()))
        self.tables.replace("tombstone", self.tables.read("tombstone").unionByName(dead).groupBy("id").agg(F.max("gen").alias("gen")))

    def put(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        """Add documents, or replace those of the same id; only the delta is rewritten."""
        self.remove(docs.select(F.col(id_col).alias("id")))
        gen = F.lit(self.tables.read("generation").head()[0])
        self.tables.replace("delta_posting", self.tables.read("delta_posting").unionByName(indexed(docs, id_col, text_col).withColumn("gen", gen)), "bucket")
        self.tables.replace("delta_length", self.tables.read("delta_length").unionByName(lengths(docs, id_col, text_col).withColumn("gen", gen)))

    def _live(self, name: str, terms: list[str] | None = None) -> DataFrame:
        both = [self.tables.read(name), self.tables.read(f"delta_{name}")]
        rows = [of_terms(t, terms) if terms is not None else t for t in both]
        dead = self.tables.read("tombstone").withColumnRenamed("gen", "_dead")
        # a row that the tombstone's own generation wrote is alive
        return rows[0].unionByName(rows[1]).join(dead, "id", "left").where("_dead IS NULL OR gen >= _dead").drop("_dead", "gen")

    def search(self, query: str, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(id, score) of the live documents that hold a term of the query."""
        terms = query_terms(self.spark, query)
        n, average = self._live("length").agg(F.count(F.lit(1)), F.avg("length")).head()
        return score(self._live("posting", terms), n, average, k1, b)

    def pending(self) -> int:
        """Rows that a compaction would fold in."""
        return self.tables.read("tombstone").count() + self.tables.read("delta_length").count()

    def compact(self) -> None:
        """Fold delta and tombstones into a new base; results stay as they are."""
        self._replace(self._live("posting").withColumn("gen", F.lit(0)), self._live("length").withColumn("gen", F.lit(0)))
