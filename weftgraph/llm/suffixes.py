"""Removal of repeated byte strings by suffix sorting in shards.

1. Candidates.  Every `length`-byte string has an anchor, the `gram` of its
   bytes with the smallest hash; equal strings have equal anchors.  Strings that
   start one after another under one anchor form a run.  Runs whose anchor
   occurs once in all texts hold no repeats and go no further.
2. Equal runs collapse: all strings of a run that occurs again are repeats.
3. Shards.  Runs that differ under one anchor are dealt out by anchor, so all
   that can match meet in one shard, and each shard is suffix-sorted by
   external induced sorting with common-prefix values (see induction.py): a
   string is a repeat if its suffix agrees with a neighbour for `length` bytes.
   A task sorts shard after shard of about SHARD_BYTES.  An anchor is never
   parted between shards, so one that very many texts share makes a shard of its
   own of any size: a shard's bytes, and all that grows with them, are mapped
   files of the task's own scratch folder beyond IN_MEMORY bytes each, and the sorter's queues keep no more
   than QUEUE_BYTES in memory.

Matches never cross documents, nor runs.  The result covers each byte of every
occurrence, the first included.

Defined cases: null text is empty; texts under `length` bytes are kept whole;
rows that repeat an id and text count as one document (rows that share an id
must share the text); a null id takes no part and keeps all; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm import textops
from weftgraph.llm.induction import BLOCK, Spool, repeats
from weftgraph.llm.shared import cut, id_bitmap, in_bitmap, lean, only, small_batches
from weftgraph.llm.substrings import with_marks

SHARD_BYTES = 4 << 20
#: What a queue holds in memory; a shard of SHARD_BYTES has several times that.
QUEUE_BYTES = 1 << 20
SLICE_BYTES = 1 << 19


def _grams(part: textops.Slice, gram: int) -> np.ndarray:
    sums = textops.prefix_sums(textops.byte_values()[part.buf])
    at = np.arange(max(0, len(part.buf) - gram + 1))
    return textops.range_hash(sums, at, at + gram)


def _anchors(docs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch.column(1), size=SLICE_BYTES):
                if len(part.buf) < length:
                    continue
                grams = _grams(part, gram)
                anchor = textops.sliding_argmin(grams, length - gram + 1)[textops.window_starts(part.off, length)[: len(part.buf) - length + 1]]
                if not len(anchor):
                    continue
                anchor = anchor[np.concatenate(([True], anchor[1:] != anchor[:-1]))]
                row = np.searchsorted(part.off, anchor, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(textops.signed(grams[anchor])), batch.column(0).slice(part.lo, len(part)).take(pa.array(row)), pa.array((anchor - part.off[row]).astype(np.int32))], names=["gram", "doc_id", "at"])

    return docs.mapInArrow(lean(run), f"gram long, doc_id {kind}, at int")


def _runs(docs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """(gram, run, doc_id, at, n, bytes): n strings from at on under one repeated anchor, with all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch.column(1), size=SLICE_BYTES):
                if len(part.buf) < length:
                    continue
                marked = np.zeros(len(part.buf) + 1, bool)
                for k, v in enumerate(batch.column(2).slice(part.lo, len(part))):
                    at = v.values.to_numpy() + part.off[k]
                    marked[at[at < part.off[k + 1]]] = True
                grams = _grams(part, gram)
                anchor = textops.sliding_argmin(grams, length - gram + 1)
                live = np.flatnonzero(textops.window_starts(part.off, length)[: len(anchor)] & marked[anchor])
                if not len(live):
                    continue
                anchor = anchor[live]
                edge = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (live[1:] != live[:-1] + 1), [True])))
                a, b = live[edge[:-1]], live[edge[1:] - 1] + length
                row = np.searchsorted(part.off, a, "right") - 1
                data = part.buf.tobytes()
                held = [data[x:y] for x, y in zip(a, b)]
                key = [hashlib.blake2b(x, digest_size=16).digest() for x in held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(textops.signed(grams[anchor[edge[:-1]]])), pa.array(key, pa.binary()), batch.column(0).slice(part.lo, len(part)).take(pa.array(row)), pa.array((a - part.off[row]).astype(np.int32)), pa.array(np.diff(edge).astype(np.int32)), pa.array(held, pa.binary())],
                    names=["gram", "run", "doc_id", "at", "n", "bytes"],
                )

    return docs.mapInArrow(lean(run), f"gram long, run binary, doc_id {kind}, at int, n int, bytes binary")


class _Shard:
    """Runs of one or more anchors: beyond a bounded size their bytes go to a file as they come; ids, places and sizes stay in memory."""

    def __init__(self, folder: str):
        self.text, self.bytes = Spool(folder, np.uint16), 0
        self.rows: list[pa.RecordBatch] = []
        self.sizes: list[int] = []

    def add(self, part: pa.RecordBatch) -> None:
        """part: rows of (gram, doc_id, at, bytes)."""
        self.rows.append(pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(1)]), pa.concat_arrays([part.column(2)])], names=["doc_id", "at"]))
        for v in part.column(3):
            symbols = np.zeros(len(v.as_buffer()) + 1, np.uint16)
            symbols[:-1] = np.frombuffer(v.as_buffer(), np.uint8)
            symbols[:-1] += np.uint16(1)
            self.text.add(symbols)
            self.sizes.append(len(symbols) - 1)
            self.bytes += len(symbols) - 1

    def finish(self) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """Rows (doc_id, at), their sizes, and the text: symbols of 1 to 256, a 0 after each run."""
        return pa.concat_batches(self.rows), np.array(self.sizes, np.int64), self.text.array()


def _sorted_shards(apart: DataFrame, kind: str, length: int) -> DataFrame:
    """(doc_id, at, n) of the repeated strings among runs; apart is dealt out and ordered by gram."""

    def sort(shard: "_Shard", folder: str) -> pa.RecordBatch | None:
        rows, size, text = shard.finish()
        at = np.cumsum(size + 1) - size - 1
        marks = repeats(text, length, folder, QUEUE_BYTES)
        runs: list[list[int]] = []
        for lo in range(0, len(text), BLOCK):
            mine = np.flatnonzero(marks[lo : lo + BLOCK]) + lo
            row = np.searchsorted(at, mine, "right") - 1
            # the last length - 1 bytes of a string are no starts
            fits = mine <= at[row] + size[row] - length
            mine, row = mine[fits], row[fits]
            if len(mine):
                edge = np.flatnonzero(np.concatenate(([True], (np.diff(mine) != 1) | (np.diff(row) != 0), [True])))
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    first, end, r = int(mine[i]), int(mine[j - 1]) + 1, int(row[i])
                    if runs and runs[-1][1] == first and runs[-1][2] == r:
                        runs[-1][1] = end
                    else:
                        runs.append([first, end, r])
        if not runs:
            return None
        a, b, row = np.array(runs, np.int64).T
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array((rows.column(1).to_numpy()[row] + a - at[row]).astype(np.int32)), pa.array((b - a).astype(np.int32))], names=["doc_id", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        with tempfile.TemporaryDirectory() as folder:
            shard = _Shard(folder)
            for batch in batches:
                gram = batch.column(0).to_numpy()
                edge = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
                for a, b in zip(edge[:-1], edge[1:]):
                    if shard.bytes > SHARD_BYTES and gram[a] != last:
                        if (got := sort(shard, folder)) is not None:
                            yield got
                        shard = _Shard(folder)
                    shard.add(batch.slice(a, b - a))
                    last = gram[a]
            if shard.bytes and (got := sort(shard, folder)) is not None:
                yield got

    return apart.mapInArrow(lean(run), f"doc_id {kind}, at int, n int")


def repeated_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 100) -> DataFrame:
    """(doc_id, at, n): from byte at on, n successive starts of strings of `length` bytes that start elsewhere too."""
    docs = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "text").where("doc_id IS NOT NULL").where(F.octet_length("text") >= length)
    kind = docs.schema["doc_id"].dataType.simpleString()
    anchors = cut(_anchors(docs, kind, length, gram), "anchors")
    often = cut(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "often")
    marks = cut(anchors.join(often, "gram").groupBy("doc_id").agg(F.collect_set("at").alias("marks")), "marks")
    runs = cut(_runs(with_marks(docs, marks, kind), kind, length, gram), "runs")
    per_run = runs.groupBy("gram", "run").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.countDistinct("doc_id", "at").alias("_c"))
    per_run = cut(per_run, "run-heads")
    kinds = per_run.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram")
    told = runs.select("gram", "run", "doc_id", "at", "n").join(per_run.where("_c > 1").select("gram", "run"), ["gram", "run"]).select("doc_id", "at", "n")
    heads = per_run.join(kinds, "gram").select("gram", "run", F.col("head.doc_id").alias("doc_id"), F.col("head.at").alias("at"))
    apart = runs.join(heads, ["gram", "run", "doc_id", "at"]).dropDuplicates(["gram", "run"]).select("gram", "doc_id", "at", "bytes")
    shards = apart.repartition("gram").sortWithinPartitions("gram")
    return told.union(_sorted_shards(shards, kind, length))


def remove_repeated_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 100, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans (flat starts and ends) and kept_bytes.

    What is left of a text can be cut inside a character, so it is binary.
    """
    all_docs = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "text")
    kind = all_docs.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        found = repeated_strings(all_docs, length=length, gram=gram)
        marks = cut(found.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_set(F.array("at", "n")))).alias("marks")), "removed")
    table, bits = id_bitmap(marks, "doc_id")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans", "kept_bytes"] * keep_bytes]
    fields = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<long>, kept_bytes binary" if keep_bytes else "")

    def kept(part: textops.Slice, marks: list, ids: pa.Array) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names[1:]]
        for k, (a, b) in enumerate(zip(part.off[:-1], part.off[1:])):
            mine, spans = part.buf[a:b], np.zeros(0, np.int64)
            if marks[k] is not None and len(marks[k]):
                at, count = np.asarray(marks[k], np.int64).reshape(-1, 2).T
                inside = at < b - a
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, at[inside], 1)
                np.add.at(edge, np.minimum(at + count + length - 1, b - a)[inside], -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                mine = mine[~gone]
            data = mine.tobytes()
            for col, v in zip(cols, (int(b - a), int(b - a) - len(data), len(spans) // 2, hashlib.sha256(data).hexdigest(), spans, data)):
                col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that lose nothing are done here; the others go on."""
        for batch in batches:
            touched = in_bitmap(table.value, batch.column(2).to_numpy(), bits)
            free, rest = batch.filter(pa.array(~touched)), batch.filter(pa.array(touched))
            for part in textops.slices(free.column(1)):
                got = kept(part, [None] * len(part), free.column(0).slice(part.lo, len(part)))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.nulls(len(got), pa.string())], names=[*names, "text"])
            if len(rest):
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64()), pa.binary()] * keep_bytes]
                yield pa.RecordBatch.from_arrays([rest.column(0), *(pa.nulls(len(rest), t) for t in kinds), rest.column(1)], names=[*names, "text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = batch.filter(batch.column("n_bytes").is_valid()).select(names)
            if len(done):
                yield done
            rest = batch.filter(batch.column("n_bytes").is_null())
            for part in textops.slices(rest.column("text")):
                marks = [v.values.to_numpy() if v.is_valid else None for v in rest.column("marks").slice(part.lo, len(part))]
                yield kept(part, marks, rest.column("doc_id").slice(part.lo, len(part)))

    first = all_docs.withColumn("_h", F.xxhash64("doc_id")).mapInArrow(lean(whole), fields + ", text string")
    return first.join(marks, "doc_id", "left").mapInArrow(lean(finish), fields)
