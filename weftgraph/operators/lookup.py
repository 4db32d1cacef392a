"""Point look-ups over symbol and edge tables, and small reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def by_key(symbols: DataFrame, key: str) -> DataFrame:
    """Symbols by qualified name if the key has ::, else by name."""
    return symbols.where(F.col("qname" if "::" in key else "name") == key)


def definition(symbols: DataFrame, name: str, file: str | None = None) -> DataFrame:
    got = by_key(symbols, name)
    return got.where(F.col("file") == file) if file else got


def name_probe(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols whose name is the query in any case, by id."""
    return symbols.where(F.lower("name") == query.lower()).orderBy("id").limit(limit)


def references(symbols: DataFrame, edges: DataFrame, name: str, rels: tuple[str, ...] = ("CALLS", "REFERENCES_", "INSTANTIATES")) -> DataFrame:
    """(rel, src, dst, line, confidence): edges of the given kinds into the named symbols."""
    into = edges.where(F.col("rel").isin(*rels))
    return into.join(by_key(symbols, name).select(F.col("id").alias("dst")), "dst", "left_semi")


def neighborhood(symbols: DataFrame, edges: DataFrame, ranks: DataFrame, name: str, rels: tuple[str, ...] = ("CALLS", "INHERITS", "INSTANTIATES", "CONTAINS", "IMPORTS")) -> DataFrame:
    """(id, rel, pagerank): one hop both ways; of several edges to a node the first kind in rels counts."""
    own = by_key(symbols, name).select("id")
    order = F.array_position(F.array(*map(F.lit, rels)), F.col("rel"))
    picked = edges.where(F.col("rel").isin(*rels)).select("rel", "src", "dst", order.alias("_o"))
    out = picked.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select("rel", F.col("dst").alias("id"), "_o")
    back = picked.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select("rel", F.col("src").alias("id"), "_o")
    near = out.unionByName(back).join(own, "id", "left_anti").groupBy("id").agg(F.min(F.struct("_o", "rel")).getField("rel").alias("rel"))
    return near.join(ranks, "id", "left").select("id", "rel", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")).orderBy(F.desc("pagerank"), "id")


def file_map(symbols: DataFrame, imports: DataFrame, file: str) -> DataFrame:
    """(kind, name, line): what a file defines and imports."""
    own = symbols.where(F.col("file") == file).select(F.col("label").alias("kind"), "name", F.col("line_start").alias("line"))
    return own.unionByName(imports.where(F.col("file") == file).select(F.lit("import").alias("kind"), F.col("target").alias("name"), F.col("line")))


def pick(symbols: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """The one symbol meant by a name: most rank, not a test, first file."""
    got = by_key(symbols, name).join(ranks, "id", "left")
    return got.orderBy(F.desc(F.coalesce("pagerank", F.lit(0.0))), "is_test", "file", "id").limit(1)


def graph_dump(symbols: DataFrame, ranks: DataFrame, edges: DataFrame, limit: int, shares: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """The highest ranked nodes of each label by its share of limit, trimmed to limit, and the edges among them."""
    from pyspark.sql import Window

    rows = symbols.join(ranks, "id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    budget = F.lit(0)
    for label, share in shares.items():
        budget = F.when(F.col("label") == label, F.lit(max(1, int(limit * share)))).otherwise(budget)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("pagerank"), "id"))
    nodes = rows.withColumn("_r", place).where(F.col("_r") <= budget).drop("_r").orderBy(F.desc("pagerank"), "id").limit(limit)
    own = nodes.select("id")
    inner = edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, inner


def within_budget(rows: DataFrame, tokens: str, order: list, budget: int) -> DataFrame:
    """The longest prefix in the given order whose tokens fit the budget.

    Sums run inside range partitions and are shifted by those before them, of
    which there is one row per partition.
    """
    from pyspark.sql import Window

    from weftgraph.storage import cut

    parts = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_p").agg(F.sum(tokens).alias("_m"))
    before = sums.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_b"))
    total = F.sum(tokens).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("_s", total).join(F.broadcast(before), "_p").withColumn("total_tokens", F.col("_s") + F.col("_b"))
    return out.where(F.col("total_tokens") <= budget).select(*rows.columns, "total_tokens")


def retrieval_metrics(ranked: DataFrame, group: str, rank: str) -> DataFrame:
    """(group, recall_at_5, mrr) of the ranks at which references were found."""
    hit = F.avg((F.col(rank) <= 5).cast("double"))
    return ranked.groupBy(group).agg(F.round(hit, 9).alias("recall_at_5"), F.round(F.avg(1.0 / F.col(rank)), 9).alias("mrr"))
