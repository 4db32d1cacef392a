"""Storage and session helpers used by every corpus operator."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.storage import cut, scratch_path, shared_dir

__all__ = ["cut", "free_names", "id_bitmap", "in_bitmap", "lean", "only", "scratch_path", "shared_dir", "small_batches"]

_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Short Arrow batches for the tables written inside: rows that carry texts or sets are large."""
    old = {k: spark.conf.get(k) for k in _BATCH}
    try:
        for k, v in _BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def lean(run):
    """A batch function that hands free memory back when its task ends.

    Python workers are reused: what one stage's arrays have left in the
    allocators would stand beside the next stage's.
    """

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return wrapped


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so extra columns of the input can't clash."""
    return df.select(*[F.col(c) for c in cols])


def free_names(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores after it as it takes not to be one of the columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_bitmap(ids: DataFrame, col: str):
    """A broadcast bitmap over hashes of ids, of at most 8 MB, and its size in bits.

    It only lets rows that surely have no partner stay out of a shuffle; an
    exact join follows, so a crowded bitmap costs bytes, never results.
    """
    import numpy as np

    n = ids.count()
    bits = 1 << min(26, max(16, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(col), F.lit(bits))
    words = ids.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("v"))
    got = words.toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(table), bits


def in_bitmap(table, hashes, bits: int):
    """Which of the xxhash64 values are (maybe) in an id_bitmap()."""
    import numpy as np

    at = np.mod(hashes.astype(np.int64), bits).astype(np.uint64)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
