"""World layout and level-of-detail tables for tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftgraph.functions.geometry import GRID_BITS, morton, quantise, spiral
from weftgraph.storage import cut

FILE_GAP, CLUSTER_GAP = 15.0, 60.0
#: Fixed value: aggregated edges that a tile shows at least.
EDGES_LEAST = 2000
#: Zoom of the folders that tiles are stored in.
STORE_ZOOM = 4


def apart(at: np.ndarray, cell: float) -> np.ndarray:
    """Places moved to the centres of free cells of a square grid, the nearest ring first; no two share a cell."""
    taken: set[tuple[int, int]] = set()
    start: dict[tuple[int, int], int] = {}
    out = np.empty_like(at)
    for k in range(len(at)):
        x0, y0 = (int(v) for v in np.round(at[k] / cell))
        ring = start.get((x0, y0), 0)
        while True:
            edge = [(x0 + dx, y0 + dy) for dx in range(-ring, ring + 1) for dy in ((-ring, ring) if abs(dx) < ring else range(-ring, ring + 1))]
            free = [c for c in edge if c not in taken]
            if free:
                best = min(free, key=lambda c: (np.hypot(c[0] * cell - at[k, 0], c[1] * cell - at[k, 1]), c))
                break
            ring += 1
        start[x0, y0] = ring
        taken.add(best)
        out[k] = best[0] * cell, best[1] * cell
    return out


def place(symbols: DataFrame, clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, x, y): symbols on a spiral in their file, files by force in their cluster, clusters on a spiral by size.

    symbols: (id, file); clusters: (file, cluster); weights: (a, b, weight)
    between files of a cluster.  Deterministic; discs of files don't overlap,
    since each has a cell of the widest disc's size of its own.
    """
    i = F.row_number().over(Window.partitionBy("file").orderBy("id")) - 1
    own = symbols.select("id", "file").withColumn("i", i)
    x, y = spiral(F.col("i"))
    own = own.select("id", "file", x.alias("dx"), y.alias("dy"))
    radius = symbols.groupBy("file").agg((10.0 * F.sqrt(F.count(F.lit(1))) + FILE_GAP).alias("r"))
    files = radius.join(clusters, "file")
    pull = weights.join(clusters.select(F.col("file").alias("a"), F.col("cluster").alias("cluster")), "a")

    def arrange(key, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("file").reset_index(drop=True)
        n, r = len(rows), rows["r"].to_numpy(float)
        order = np.argsort(-r, kind="stable")
        at = np.empty((n, 2))
        step = 2 * r.max() if n else 0.0
        for k, j in enumerate(order):
            at[j] = step * np.sqrt(k) * np.array([np.cos(k * 2.399963229728653), np.sin(k * 2.399963229728653)])
        if n > 1 and len(links):
            # links pull, whatever the cluster's size: time and memory follow the links
            number = {f: k for k, f in enumerate(rows["file"])}
            ok = links["a"].isin(number) & links["b"].isin(number)
            a, b = links.loc[ok, "a"].map(number).to_numpy(int), links.loc[ok, "b"].map(number).to_numpy(int)
            w = links.loc[ok, "weight"].to_numpy(float)
            for _ in range(60):
                move = np.zeros_like(at)
                gap = at[b] - at[a]
                np.add.at(move, a, 0.01 * np.minimum(w, 5)[:, None] * gap)
                np.add.at(move, b, -0.01 * np.minimum(w, 5)[:, None] * gap)
                at += np.clip(move, -step / 4, step / 4)
        if n:
            at[order] = apart(at[order], step)
        size = float((np.sqrt((at**2).sum(1)) + r).max()) if n else 0.0
        return pd.DataFrame({"cluster": rows["cluster"], "file": rows["file"], "fx": at[:, 0], "fy": at[:, 1], "size": size})

    kind = clusters.schema["cluster"].dataType.simpleString()
    inner = files.groupBy("cluster").cogroup(pull.groupBy("cluster")).applyInPandas(arrange, f"cluster {kind}, file string, fx double, fy double, size double")
    inner = inner.where("file IS NOT NULL")
    sizes = inner.groupBy("cluster").agg(F.max("size").alias("size"))
    widest = sizes.agg(F.max("size")).head()[0] or 0.0
    k = F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1  # one row per cluster
    cx, cy = spiral(k, 2 * widest + CLUSTER_GAP)
    centres = sizes.select("cluster", cx.alias("cx"), cy.alias("cy"))
    out = own.join(inner, "file").join(centres, "cluster")
    return out.select("id", (F.col("cx") + F.col("fx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("fy") + F.col("dy")).alias("y"))


def world_box(places: DataFrame) -> tuple[float, float]:
    """The square around all places, padded by an eighth and 50."""
    e = places.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).head()[0] or 0.0
    half = e * 1.125 + 50.0
    return -half, half


def with_codes(places: DataFrame, low: float, high: float) -> DataFrame:
    """places with their Morton code, ordered by it within range partitions, so a tile reads one range."""
    code = morton(quantise(F.col("x"), low, high), quantise(F.col("y"), low, high))
    return places.withColumn("code", code).repartitionByRange("code").sortWithinPartitions("code")


def tile_code(tx: int, ty: int) -> int:
    return sum(((tx >> i & 1) << (2 * i)) | ((ty >> i & 1) << (2 * i + 1)) for i in range(GRID_BITS))


def in_tile(nodes: DataFrame, zoom: int, tx: int, ty: int) -> DataFrame:
    """Rows whose code is in a tile's range; nodes: with_codes()."""
    shift, code = 2 * (GRID_BITS - zoom), tile_code(tx, ty)
    return nodes.where((F.col("code") >= code << shift) & (F.col("code") < (code + 1) << shift))


def tile(nodes: DataFrame, edges: DataFrame, zoom: int, tx: int, ty: int, min_confidence: float = 0.0, aggregated: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of a tile, edges that start or end in it, and ghosts: the far ends of these, with their places.

    Of aggregated edges (with a weight) only the heaviest count, six for each
    node of the tile and at least EDGES_LEAST.
    """
    inside = in_tile(nodes, zoom, tx, ty)
    ids = cut(inside.select("id"), "tile")
    sure = edges.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    own = sure.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    received = sure.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    found = own.unionByName(received.select(own.columns))
    if aggregated:
        found = found.orderBy(F.desc("weight"), "src", "dst").limit(max(EDGES_LEAST, 6 * ids.count()))
    ends = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(ids, "id", "left_anti")
    return inside, found, nodes.join(ends, "id", "left_semi")


def pick_lod(levels: dict[str, DataFrame], zoom: int, tx: int, ty: int, budget: int) -> str:
    """The finest level (in the order given) of which a tile holds at most budget nodes; the last one, if none does."""
    for name, nodes in levels.items():
        if in_tile(nodes, zoom, tx, ty).limit(budget + 1).count() <= budget:
            return name
    return name


def locate(places: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, x, y) of the asked nodes (id) that have a place."""
    return places.join(ids.select("id").distinct(), "id", "left_semi").select("id", "x", "y")


class TileStore:
    """Placed nodes in folders by tile of STORE_ZOOM; a patch rewrites the folders of what it touches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("tile").sortWithinPartitions("tile", "code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(self.root)

    def save(self, nodes: DataFrame) -> None:
        """nodes (id, x, y, code, ...) as the store's first contents."""
        self._write(nodes.withColumn("tile", F.shiftright("code", 2 * (GRID_BITS - STORE_ZOOM)).cast("int")))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.root).where("id IS NOT NULL")

    def patch(self, changed: DataFrame, removed: DataFrame) -> None:
        """Put changed nodes in the place of their old rows, and drop removed ones (id)."""
        new = cut(changed.withColumn("tile", F.shiftright("code", 2 * (GRID_BITS - STORE_ZOOM)).cast("int")), "patch")
        gone = new.select("id").unionByName(removed.select("id")).distinct()
        left = self.read().join(gone, "id", "left_semi").select("tile")
        tiles = [r[0] for r in left.unionByName(new.select("tile")).distinct().collect()]  # at most 4 ** STORE_ZOOM
        kept = self.read().where(F.col("tile").isin(tiles)).join(gone, "id", "left_anti")
        rows = kept.unionByName(new.select(kept.columns))
        # a row without an id keeps a folder that is left empty
        marks = self.spark.createDataFrame([(t,) for t in tiles], "tile int").join(rows.select("tile").distinct(), "tile", "left_anti")
        self._write(cut(rows.unionByName(marks, allowMissingColumns=True), "patch"))


def lod(symbols: DataFrame, places: DataFrame, edges: DataFrame, clusters: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(nodes, edges) per level: sym, file and cluster; upper levels are centroids by size, with edges added up by kind."""
    from weftgraph.operators.edges import aggregate_edges

    base = symbols.select("id", "file").join(places, "id")
    file = base.groupBy("file").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("size"))
    grouped = file.join(clusters, "file")
    cluster = grouped.groupBy("cluster").agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("x"), (F.sum(F.col("y") * F.col("size")) / F.sum("size")).alias("y"), F.sum("size").alias("size"))
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    by_file = aggregate_edges(weighted, symbols.select("id", F.col("file").alias("grp")))
    by_cluster = aggregate_edges(weighted, symbols.select("id", "file").join(clusters, "file").select("id", F.col("cluster").alias("grp")))
    return {"sym": (base, edges), "file": (file, by_file), "cluster": (cluster, by_cluster)}
