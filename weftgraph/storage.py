"""Where intermediate tables live: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_own: list[str] = []


def _drop_own() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session names none (tests) a temporary folder of this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="weftgraph-"))
            atexit.register(_drop_own)
        path = "file://" + _own[0]
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: ends lineage, feeds several consumers."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Remove what cut() wrote for df; nothing that reads it may run later."""
    path = getattr(df, "_written", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_tables: dict[tuple[str, str], str] = {}


def once(spark: SparkSession, key: str, build, partition: str | None = None, order: list[str] = (), folders: int = 1) -> DataFrame:
    """The table that build() gives, written the first time this application asks for the key, read afterwards.

    For what many queries read and the data alone determines: an edge table, an
    index, ranks.  order sorts each file, so that ranges of those columns skip
    row groups; partition makes folders; if there
    are about `folders` of them, and more tasks, the first column of order deals
    a folder's rows out to several tasks, so that none sorts a whole folder.
    """
    at = (spark.sparkContext.applicationId, key)
    if at not in _tables:
        path = scratch_path(spark, "once")
        df = build()
        if partition:
            # a given number of tasks: sorting and writing them is the work, however few bytes there are
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            shares = [F.pmod(F.hash(order[0]), F.lit(-(-parts // folders)))] if order else []
            df = df.repartition(parts, partition, *shares)
        if order or partition:
            df = df.sortWithinPartitions(*([partition] if partition else []), *order)
        (df.write.partitionBy(partition) if partition else df.write).parquet(path)
        _tables[at] = path
    return spark.read.parquet(_tables[at])
