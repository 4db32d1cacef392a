"""Graph tables as Parquet: keyed inserts, updates and deletes.

Each change reads a table's current version, writes a new one beside it and
points the table at it; readers of the old version are not disturbed.  Edge
tables are partitioned by relation, so scans of one relation read its files
alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weftgraph.storage import cut


class GraphTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.root}/_current/{name}"

    def read(self, name: str) -> DataFrame:
        row = self.spark.read.schema("at string, fields string").json(self._pointer(name)).head()
        # by its own schema: a table of no rows has no file to read one from
        return self.spark.read.schema(StructType.fromJson(json.loads(row["fields"]))).parquet(f"{self.root}/{name}/{row['at']}")

    def replace(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        version = uuid.uuid4().hex
        writer = df.write.partitionBy(partition) if partition else df.write
        writer.parquet(f"{self.root}/{name}/{version}")
        self.spark.createDataFrame([(version, df.schema.json())], "at string, fields string").coalesce(1).write.mode("overwrite").json(self._pointer(name))

    def append_nodes(self, name: str, rows: DataFrame) -> None:
        self.replace(name, self.read(name).unionByName(rows, allowMissingColumns=True))

    def append_edges(self, rows: DataFrame, nodes: DataFrame, name: str = "edge") -> None:
        """Only edges whose ends are nodes are taken."""
        from weftgraph.operators.edges import valid

        self.replace(name, self.read(name).unionByName(valid(rows, nodes), allowMissingColumns=True), "rel")

    def update(self, name: str, key: str, changes: DataFrame) -> None:
        self.replace(name, update_columns(self.read(name), key, changes))

    def delete(self, name: str, key: str, ids: DataFrame) -> None:
        self.replace(name, delete_ids(self.read(name), key, ids))

    def append_vectors(self, name: str, rows: DataFrame) -> None:
        """Rows (id, ehash, embedding) of a side table; of an id that is there already the new vector stays."""
        kept = delete_ids(self.read(name), "id", rows.select("id"))
        self.replace(name, kept.unionByName(rows.dropDuplicates(["id"])))

    def drop_relation(self, rel: str, name: str = "edge") -> None:
        """All edges of one relation; as the table is partitioned by it, the others' files alone are read."""
        self.replace(name, self.read(name).where(F.col("rel") != rel), "rel")

    def replace_partition(self, name: str, column: str, value, rows: DataFrame) -> None:
        kept = self.read(name).where(F.col(column) != value)
        self.replace(name, kept.unionByName(rows, allowMissingColumns=True), column)


def update_columns(rows: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Rows with the columns of changes put over theirs where the key matches; a null change keeps the old value."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def delete_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def delete_touching(edges: DataFrame, ids: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    for end in ends:
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return edges


def delete_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti")


def upgrade_calls(edges: DataFrame, exact: DataFrame) -> DataFrame:
    """Edges (src, dst, confidence, method) that an exact index confirms become certain; the others of it are added."""
    pairs = exact.select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    old = edges.join(pairs, ["src", "dst"], "left").select("src", "dst", F.when(F.col("_hit"), 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("_hit"), "scip").otherwise(F.col("method")).alias("method"))
    new = pairs.drop("_hit").join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(1.0).alias("confidence"), F.lit("scip").alias("method"))
    return old.unionByName(new)


def changes_since(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, state): added, changed, deleted or unchanged by content hash; both: (path, hash)."""
    both = scan.select("path", F.col("hash").alias("now")).join(manifest.select("path", F.col("hash").alias("was")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "changed").otherwise("unchanged")
    return both.select("path", state.alias("state"))


def by_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


class ParseCache:
    """Parse results by path and content hash, in folders by hash of the path; a write touches the folders of its own paths alone."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _read(self, folders: list[int] | None = None) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(self.root)
        except AnalysisException:  # nothing has been written yet
            return None
        return rows if folders is None else rows.where(F.col("bucket").isin(folders))

    def lookup(self, files: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """(cached rows, files to parse) for files (path, hash, ...): a path whose hash has changed is to be parsed."""
        own = by_bucket(files, "path", self.buckets)
        folders = [r[0] for r in own.select("bucket").distinct().collect()]  # as many as there are buckets at most
        cached = self._read(folders)
        if cached is None:
            return None, files
        cached = cached.where("hash IS NOT NULL")
        hit = cached.join(own.select("path", "hash"), ["path", "hash"], "left_semi").drop("bucket")
        return hit, files.join(cached.select("path", "hash").distinct(), ["path", "hash"], "left_anti")

    def store(self, rows: DataFrame, dropped: DataFrame | None = None) -> None:
        """Put rows (path, hash, ...) in the place of what their paths had; dropped (path) goes."""
        new = by_bucket(rows, "path", self.buckets)
        if dropped is not None:
            # a row without a hash, so that no folder is ever left without rows
            new = new.unionByName(by_bucket(dropped.select("path").distinct(), "path", self.buckets), allowMissingColumns=True)
        gone = new.select("path", "bucket").distinct()
        old = self._read([r[0] for r in gone.select("bucket").distinct().collect()])
        out = new if old is None else old.join(gone.select("path"), "path", "left_anti").unionByName(new)
        # written aside first, as the folders that are read are those that are replaced
        cut(out, "parse-cache").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
