"""PageRank as a join and an aggregate per iteration; ranks and edges share their partitioning key."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from weftgraph.storage import cut, release


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, focus: DataFrame | None = None) -> DataFrame:
    """(id, pagerank).  Repeated edges collapse; dangling mass goes where the restart goes.

    focus (id): the restart's nodes, for a personalised rank; all nodes if it
    holds none.  Stops when the L1 change is under N * tolerance (None: runs
    all iterations).
    """
    nodes = cut(nodes.select("id").distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    # a table of ranks packs into files far smaller than its rows, so joins are told to hash the side of nodes within
    # partitions, and not to send it through the driver; edges are dealt twice, never sorted, and stay by src
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = edges.select("src", "dst").join(nodes.withColumnRenamed("id", "dst").hint("shuffle_hash"), "dst", "left_semi")
    # read in every round: held by the key that rounds join on, recomputed if an executor goes
    pairs = inside.repartition(parts, "src").distinct().join(nodes.withColumnRenamed("id", "src").hint("shuffle_hash"), "src", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    degree = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    restart = nodes.withColumn("restart", F.lit(1.0 / n))
    if focus is not None:
        own = focus.select("id").distinct().join(nodes.hint("shuffle_hash"), "id", "left_semi")
        k = own.count()
        if k:
            restart = nodes.join(own.withColumn("_f", F.lit(1.0 / k)).hint("shuffle_hash"), "id", "left").select("id", F.coalesce("_f", F.lit(0.0)).alias("restart"))
    base = restart.repartition(parts, "id").join(degree.withColumnRenamed("src", "id").hint("shuffle_hash"), "id", "left").persist(StorageLevel.MEMORY_AND_DISK)
    ranks = base.select("id", "restart", "degree", F.col("restart").alias("pagerank"))
    for i in range(1, iterations + 1):
        dangling = ranks.where("degree IS NULL").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("lost"))
        share = ranks.where("degree IS NOT NULL").select(F.col("id").alias("src"), (F.col("pagerank") / F.col("degree")).alias("share"))
        given = pairs.join(share.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        new = base.join(given.hint("shuffle_hash"), "id", "left").join(F.broadcast(dangling))  # one row
        rank = F.lit(1 - damping) * F.col("restart") + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("restart"))
        new = cut(new.select("id", "restart", "degree", rank.alias("pagerank")), "ranks")
        moved = None
        if tolerance is not None:
            moved = new.select("id", F.col("pagerank").alias("_new")).join(ranks.select("id", "pagerank").hint("shuffle_hash"), "id").agg(F.sum(F.abs(F.col("_new") - F.col("pagerank")))).head()[0]
        release(ranks)
        ranks = new
        if moved is not None and moved < n * tolerance:
            break
    out = ranks.select("id", "pagerank") if hasattr(ranks, "_written") else cut(ranks.select("id", "pagerank"), "pagerank")
    pairs.unpersist()
    base.unpersist()
    return out


def global_row_number(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in a total order, without bringing all of them to one task.

    Range partitions are numbered inside, and shifted by the rows before them;
    the offsets are one row per partition.
    """
    from pyspark.sql import Window

    from weftgraph.storage import cut

    parts = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_m"))
    before = sizes.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_k", place).join(F.broadcast(before), "_p").select(*rows.columns, (F.col("_k") + F.col("_b")).cast("long").alias(name))


def percentile_below(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, below): the share of all rows whose value is strictly smaller, by one count per distinct value."""
    from pyspark.sql import Window

    from weftgraph.storage import cut

    per = cut(values.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), "values")
    total = per.agg(F.sum("_n")).head()[0]
    # running counts in two steps: a sum per range partition, then within it
    parts = cut(per.repartitionByRange(value).withColumn("_p", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_p").agg(F.sum("_n").alias("_m"))
    before = before.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_b"))
    inner = parts.withColumn("_c", F.sum("_n").over(Window.partitionBy("_p").orderBy(value)) - F.col("_n")).join(F.broadcast(before), "_p")
    share = inner.select(value, F.round((F.col("_c") + F.col("_b")) / F.lit(total), 9).alias("below"))
    return values.join(share, value).select(key, "below")
