"""Removal of repeated word windows by level-wise doubling.

A window of `window` words is judged at growing lengths: base, twice base, and
so on (5, 10 and 20 words by default).  At a length L below the window it is stood for by its anchor, the run
of L of its words with the smallest hash, which repeats wherever the window
does; neighbouring windows share anchors, so a level posts far fewer rows than
there are windows.  Only windows whose anchor repeats are extended to anchors
of twice the length, and at the full length only those still left are compared
as a whole.  Nothing is sampled: a repeated window has repeated anchors at
every level, so it always survives to the comparison.

At the last level windows that stand one after another under one anchor form a
run.  Equal runs collapse to a minimum first, so what thousands of copies share
is compared once; only runs that differ under one anchor are taken apart into
windows.  All groups are min or count aggregates, combined before the shuffle,
and joins back, which adaptive execution may split: no group is collected.

Defined cases: a null text has no words; a document under `window` words keeps
all; rows repeating an id and text are the same document and keep alike (rows
that share an id must share the text); a null id takes part in no comparison
and keeps all; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm import textops
from weftgraph.llm.shared import cut, id_bitmap, in_bitmap, lean, only, small_batches


def _alive(part: textops.Slice, first: np.ndarray, words: np.ndarray, at: list | None, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that are left, given the anchors of the length before (None: all)."""
    ok = textops.window_starts(first, window)[: max(0, len(words) - window + 1)]
    if at is not None:
        marked = np.zeros(len(words) + 1, bool)
        for k, mine in enumerate(at):
            if mine is not None and len(mine):
                p = np.asarray(mine) + first[k]
                marked[p[p < first[k + 1]]] = True
        anchor = textops.sliding_argmin(textops.gram_hashes(words, length), window - length + 1)
        ok &= marked[anchor]
    return np.flatnonzero(ok), ok


def _anchors(docs: DataFrame, kind: str, window: int, length: int, before: int | None) -> DataFrame:
    """(gram, doc_id, at): the anchors of `length` words of all windows left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(2) if before else None
            for part in textops.slices(batch.column(1)):
                start, end, first = part.words(textops.SPACE)
                words = part.hashes(start, end)
                at = [v.values.to_numpy() if v.is_valid else None for v in known.slice(part.lo, len(part))] if before else None
                live, _ = _alive(part, first, words, at, before or 0, window)
                if not len(live):
                    continue
                grams = textops.gram_hashes(words, length)
                anchor = textops.sliding_argmin(grams, window - length + 1)[live]
                anchor = anchor[np.concatenate(([True], anchor[1:] != anchor[:-1]))]
                row = np.searchsorted(first, anchor, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(textops.signed(grams[anchor])), batch.column(0).slice(part.lo, len(part)).take(pa.array(row)), pa.array((anchor - first[row]).astype(np.int32))], names=["gram", "doc_id", "at"])

    return docs.mapInArrow(lean(run), f"gram long, doc_id {kind}, at int")


def _runs(docs: DataFrame, kind: str, window: int, length: int) -> DataFrame:
    """(gram, run, doc_id, at, n, windows): windows left, as runs under one anchor of `length` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch.column(1)):
                start, end, first = part.words(textops.SPACE)
                words = part.hashes(start, end)
                at = [v.values.to_numpy() if v.is_valid else None for v in batch.column(2).slice(part.lo, len(part))]
                live, _ = _alive(part, first, words, at, length, window)
                if not len(live):
                    continue
                grams = textops.gram_hashes(words, length)
                anchor = textops.sliding_argmin(grams, window - length + 1)[live]
                whole = textops.gram_hashes(words, window, 1)[live]
                cut_ = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (live[1:] != live[:-1] + 1), [True])))
                a, b = cut_[:-1], cut_[1:]
                row = np.searchsorted(first, live[a], "right") - 1
                key = textops.range_hash(textops.prefix_sums(whole), a, b)
                payload = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((cut_ * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(textops.signed(grams[anchor[a]])), pa.array(textops.signed(key)), batch.column(0).slice(part.lo, len(part)).take(pa.array(row)), pa.array((live[a] - first[row]).astype(np.int32)), pa.array((b - a).astype(np.int32)), payload],
                    names=["gram", "run", "doc_id", "at", "n", "windows"],
                )

    return docs.mapInArrow(lean(run), f"gram long, run long, doc_id {kind}, at int, n int, windows binary")


def with_marks(docs: DataFrame, marks: DataFrame, kind: str) -> DataFrame:
    """Documents that have marks, with them; texts of the others stay out of the shuffle."""
    table, bits = id_bitmap(marks, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(table.value, batch.column(2).to_numpy(), bits)
            if keep.any():
                yield batch.select([0, 1]).filter(pa.array(keep))

    some = docs.withColumn("_h", F.xxhash64("doc_id")).mapInArrow(lean(run), f"doc_id {kind}, text string")
    return some.join(marks, "doc_id").select("doc_id", "text", "marks")


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, base: int = 5) -> DataFrame:
    """(doc_id, at, n): runs of windows, by start, whose words start earlier too (in a smaller id, or before in the same text)."""
    docs = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    kind = docs.schema["doc_id"].dataType.simpleString()
    source, before, length = docs, None, base
    while True:
        anchors = cut(_anchors(source, kind, window, length, before), "anchors")
        often = cut(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "often")
        marks = cut(anchors.join(often, "gram").groupBy("doc_id").agg(F.collect_set("at").alias("marks")), "marks")
        source, before = with_marks(docs, marks, kind), length
        if length * 2 >= window:
            break
        length *= 2
    runs = cut(_runs(source, kind, window, length), "runs")
    per_run = runs.groupBy("gram", "run").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count(F.lit(1)).alias("_c"))
    per_run = cut(per_run, "run-heads")
    per_gram = per_run.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("_c").alias("_c")).where("_c > 1").drop("_c")
    # heads of runs that differ under one anchor go on as windows; copies of a run are settled here
    told = runs.join(per_run.where("_c > 1").drop("_c"), ["gram", "run"]).where("doc_id <> head.doc_id OR at <> head.at").select("doc_id", "at", "n")
    heads = per_run.join(per_gram.where("kinds > 1").drop("kinds"), "gram").select("gram", "run", F.col("head.doc_id").alias("doc_id"), F.col("head.at").alias("at"))
    apart = runs.join(heads, ["gram", "run", "doc_id", "at"]).select("gram", "doc_id", "at", "windows")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(w) // 8 for w in (v.as_buffer() for v in batch.column(3))], np.int64)
            if not size.sum():
                continue
            row = np.repeat(np.arange(len(size)), size)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            whole = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(3)])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(whole), batch.column(1).take(take), pa.array((batch.column(2).to_numpy()[row] + inner).astype(np.int32))], names=["gram", "whole", "doc_id", "at"])

    single = cut(apart.mapInArrow(lean(explode), f"gram long, whole long, doc_id {kind}, at int"), "windows")
    # the same window may stand in a document's runs twice: rows are distinct by (doc_id, at)
    least = single.groupBy("gram", "whole").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    later = single.join(least, ["gram", "whole"]).where("doc_id <> head.doc_id OR at <> head.at").select("doc_id", "at", F.lit(1).alias("n"))
    return told.union(later)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, base: int = 5, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the kept words joined by one space."""
    all_docs = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "text")
    kind = all_docs.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        found = repeated_windows(all_docs, window=window, base=base)
        marks = cut(found.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_set(F.array("at", "n")))).alias("marks")), "removed")
    table, bits = id_bitmap(marks, "doc_id")
    fields = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def kept(part: textops.Slice, marks: list, ids: pa.Array) -> pa.RecordBatch:
        start, end, first = part.words(textops.SPACE)
        n, gone, digests, texts = [], [], [], []
        for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
            s, e = start[a:b], end[a:b]
            n.append(int(b - a))
            if marks[k] is not None and len(marks[k]):
                at, count = np.asarray(marks[k], np.int64).reshape(-1, 2).T
                inside = at < len(s)
                edge = np.zeros(len(s) + 1, np.int64)
                np.add.at(edge, at[inside], 1)
                np.add.at(edge, np.minimum(at + count + window - 1, len(s))[inside], -1)
                keep = np.cumsum(edge[:-1]) == 0
                s, e = s[keep], e[keep]
            gone.append(int(b - a) - len(s))
            text = b""
            if len(s):
                # kept words with one space after each, but the last
                size = e - s + 1
                to = np.cumsum(size) - size
                out = np.full(int(size.sum()), 32, np.uint8)
                src = np.repeat(s - to, size - 1)
                where = np.arange(int((size - 1).sum())) + np.repeat(np.arange(len(s)), size - 1)
                out[where] = part.buf[where + src]
                text = out[:-1].tobytes()
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text)
        cols = [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)]
        if keep_text:
            cols.append(pa.array(texts, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without removals are done here; the others go on as text."""
        for batch in batches:
            touched = in_bitmap(table.value, batch.column(2).to_numpy(), bits)
            for part in textops.slices(batch.column(1)):
                ids = batch.column(0).slice(part.lo, len(part))
                mine = pa.array(touched[part.lo : part.lo + len(part)])
                done = batch.column(1).slice(part.lo, len(part)).filter(pa.compute.invert(mine))
                free = ids.filter(pa.compute.invert(mine))
                for sub in textops.slices(done):
                    got = kept(sub, [None] * len(sub), free.slice(sub.lo, len(sub)))
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.nulls(len(got), pa.string())], names=[*got.schema.names, "text"])
                rest = ids.filter(mine)
                if len(rest):
                    text = batch.column(1).slice(part.lo, len(part)).filter(mine)
                    empty = [pa.nulls(len(rest), t) for t in (pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text)]
                    yield pa.RecordBatch.from_arrays([rest, *empty, text], names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text, "text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text]
        for batch in batches:
            done = batch.filter(batch.column("n_words").is_valid()).select(names)
            if len(done):
                yield done
            rest = batch.filter(batch.column("n_words").is_null())
            for part in textops.slices(rest.column("text")):
                marks = [v.values.to_numpy() if v.is_valid else None for v in rest.column("marks").slice(part.lo, len(part))]
                yield kept(part, marks, rest.column("doc_id").slice(part.lo, len(part)))

    first = all_docs.withColumn("_h", F.xxhash64("doc_id")).mapInArrow(lean(whole), fields + ", text string")
    return first.join(marks, "doc_id", "left").mapInArrow(lean(finish), fields)
