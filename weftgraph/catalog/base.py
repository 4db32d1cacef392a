"""Registration, the driver's tables, and the graph that they stand in for.

The star schema is read as a code base: a part is a symbol of the file named by
its brand, an order is a commit that touches the parts of its lines, and
consecutive lines of an order are a call from one part to the next.  A call's
confidence is one less ten times the mean discount of its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph.storage import once

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL twin if it has one."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, n, confidence): distinct calls without self loops; one table for all queries over a data folder, in order of src."""

    def build() -> DataFrame:
        line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_discount", "l_quantity", "l_extendedprice")
        rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(line).alias("dst"), F.round(F.col("l_discount") * 100).cast("long").alias("pct"))
        # dealt by src before they are counted: pairs seldom repeat, so counts before the shuffle, and another one by ranges, cost more than they save
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        each = rows.where("dst IS NOT NULL AND src <> dst").repartition(parts, "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("pct").alias("pct"))
        return each.select("src", "dst", "n", F.round(1 - F.col("pct") / (10.0 * F.col("n")), 6).alias("confidence"))

    return once(spark, f"calls {d}", build, order=["src", "dst"])


CALLS = """
calls AS (
  SELECT src, dst, count(*) AS n, round(1 - sum(pct) / (10.0 * count(*)), 6) AS confidence
  FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount, l_quantity, l_extendedprice) AS dst, CAST(round(l_discount * 100) AS BIGINT) AS pct FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, file, label, line_start, line_end, is_test)."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("file"),
        F.when(F.col("p_type") == "LARGE", "Class").otherwise("Function").alias("label"),
        (F.col("p_partkey") + 1).alias("line_start"),
        (F.col("p_partkey") + F.col("p_size") + 1).alias("line_end"),
        (F.col("p_type") == "PROMO").alias("is_test"),
    )


SYMBOLS = """
symbols AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS file, CASE WHEN p_type = 'LARGE' THEN 'Class' ELSE 'Function' END AS label,
         p_partkey + 1 AS line_start, p_partkey + p_size + 1 AS line_end, p_type = 'PROMO' AS is_test FROM part)"""


def touched(spark: SparkSession, d: str) -> DataFrame:
    """(commit, file): distinct parts of orders."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).distinct()


TOUCHED = 'touched AS (SELECT DISTINCT l_orderkey AS "commit", l_partkey AS file FROM lineitem)'
