"""Benchmark decontamination by a prefix-filtered containment join.

Each benchmark item is cut into windows of `window` consecutive words (an item
of fewer words is one window).  A document holds a window only if it holds all
its words, so one necessary token, its rarest word in the corpus, is enough to
find every occurrence: the prefix.  A document word that is such a token gives
a candidate start by the token's offset in the window (positional bound), which
must lie with the window's whole length inside the document (length bound).  A
64-bit hash of the words in order leaves few false candidates, and those that
pass are compared word by word.

The benchmark is taken in blocks of about BLOCK_BYTES bytes of text; a block's
index is what is broadcast, so its size is bounded however large the benchmark
is (but for one item larger than that), and more blocks are more passes over the
documents' batches.  Nothing is shuffled
but the word counts of the benchmark's own vocabulary.

Defined cases: null texts have no words; a wordless item occurs nowhere; rows
repeating an item id are one item with the windows of all; repeated documents
are judged each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm import textops
from weftgraph.llm.shared import free_names, lean, only

BLOCK_BYTES = 6_000_000
#: The columns that find_leaks() adds, after a prefix.
FOUND = ("n_words", "hits", "items", "shares")


def _lower_words(column: pa.Array) -> Iterator[tuple[textops.Slice, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]]:
    for part in textops.slices(column, lower=True):
        start, end, first = part.words(textops.NOT_ALNUM)
        yield part, part.hashes(start, end), (start, end), first


def _spelt(part: textops.Slice, at: tuple[np.ndarray, np.ndarray], a: int, b: int) -> bytes:
    """Words a to b of a slice, with a space between."""
    return b" ".join(part.buf[s:e].tobytes() for s, e in zip(at[0][a:b], at[1][a:b]))


def _windows(items: list[tuple[str, str]], window: int) -> dict[bytes, dict]:
    """{the window's words: {length, words, items}} of a block of items; words: their hashes."""
    out: dict[bytes, dict] = {}
    if not items:
        return out
    at = 0
    for part, one, where, first in _lower_words(pa.array([t for _, t in items], pa.string())):
        for a, b in zip(first[:-1], first[1:]):
            name, n = items[at][0], min(window, int(b - a))
            at += 1
            if not n:
                continue
            for k in range(a, b - n + 1):
                w = out.setdefault(_spelt(part, where, k, k + n), {"length": n, "words": one[k : k + n].copy(), "items": set()})
                w["items"].add(name)
    return out


def _word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences over all documents of each of the (sorted) word hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, one, _, _ in _lower_words(batch.column(0)):
                at = np.searchsorted(shared.value, one)
                at[at == len(total)] = 0
                total += np.bincount(at[shared.value[at] == one], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(lean(run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.word] = r.n
    return out


def _index(docs: DataFrame, found: dict[bytes, dict], names: list[str]) -> dict:
    """Arrays for the scan: rarest words, and under each the windows that it stands for."""
    keys = list(found)
    vocabulary = np.unique(np.concatenate([w["words"] for w in found.values()]))
    counts = _word_counts(docs, vocabulary)
    rows = []
    number = {n: k for k, n in enumerate(names)}
    for k, key in enumerate(keys):
        words = found[key]["words"]
        n = counts[np.searchsorted(vocabulary, words)]
        offset = int(np.lexsort((words, n))[0])
        rows.append((int(words[offset]), offset, k))
    rows.sort()
    token = np.array([r[0] for r in rows], np.uint64)
    tokens, first = np.unique(token, return_index=True)
    held = [sorted(number[i] for i in found[k]["items"]) for k in keys]
    return {
        "token": tokens,
        "first": np.append(first, len(rows)),
        "offset": np.array([r[1] for r in rows]),
        "window": np.array([r[2] for r in rows]),
        "length": np.array([found[k]["length"] for k in keys]),
        "hash": np.array([int(textops.gram_hashes(found[k]["words"], found[k]["length"])[0]) for k in keys], np.uint64),
        "text": keys,
        "item_at": np.cumsum([0, *map(len, held)]),
        "item": np.array([i for h in held for i in h], np.int64),
    }


def _occurrences(ix: dict, part: textops.Slice, one: np.ndarray, where: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start word, window number) of every occurrence in a slice."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(ix["token"]) or not len(one):
        return none
    at = np.searchsorted(ix["token"], one)
    at[at == len(ix["token"])] = 0
    pos = np.flatnonzero(ix["token"][at] == one)
    if not len(pos):
        return none
    at = at[pos]
    lo, n = ix["first"][at], ix["first"][at + 1] - ix["first"][at]
    row = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    pos = np.repeat(pos, n)
    start, window = pos - ix["offset"][row], ix["window"][row]
    doc = np.searchsorted(first, pos, "right") - 1
    end = start + ix["length"][window]
    inside = (start >= first[doc]) & (end <= first[doc + 1])
    start, end, window = start[inside], end[inside], window[inside]
    same = textops.range_hash(textops.prefix_sums(one), start, end) == ix["hash"][window]
    start, end, window = start[same], end[same], window[same]
    if not len(start):
        return none
    same = np.array([_spelt(part, where, a, b) == ix["text"][w] for a, b, w in zip(start, end, window)])
    return start[same], window[same]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, prefix: str = "_") -> DataFrame:
    """docs with _n_words, _hits (start and end words of merged runs, flat), _items, _shares; prefix takes the place of their underscore.

    _items: ids as strings of the items with a window in the document; _shares:
    for each the part of its distinct windows that occur.
    """
    spark = docs.sparkSession
    columns = docs.columns
    new = [prefix + n for n in FOUND]
    if free_names(columns, *new) != new:
        raise ValueError(f"the table has a column named like one of {new}")
    text_at = columns.index(text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    out = docs.select("*", F.lit(0).cast("long").alias(new[0]), F.array().cast("array<long>").alias(new[1]), F.array().cast("array<string>").alias(new[2]), F.array().cast("array<double>").alias(new[3]))
    for block in range(blocks):
        # one block of the benchmark, of about BLOCK_BYTES, as ids hash evenly
        rows = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        found = _windows(rows, window)
        names = sorted({n for n, _ in rows})
        ix = _index(docs.select(F.col(text_col).alias("text")), found, names) if found else None
        of_item = np.bincount(ix["item"], minlength=len(names)) if ix else None
        shared = spark.sparkContext.broadcast((ix, names, of_item))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix, names, of_item = shared.value
            for batch in batches:
                for part, one, where, first in _lower_words(batch.column(text_at)):
                    lo, n = part.lo, len(part)
                    hits, items_, shares = (batch.column(len(columns) + k).slice(lo, n).to_pylist() for k in (1, 2, 3))
                    start, win = _occurrences(ix, part, one, where, first) if ix else (np.zeros(0, np.int64),) * 2
                    if len(start):
                        doc = np.searchsorted(first, start, "right") - 1
                        order = np.lexsort((start, doc))
                        start, win, doc = start[order], win[order], doc[order]
                        for d in np.unique(doc):
                            mine = slice(*np.searchsorted(doc, [d, d + 1]))
                            runs = [(int(s - first[d]), int(s - first[d] + ix["length"][w])) for s, w in zip(start[mine], win[mine])]
                            runs += list(zip(hits[d][::2], hits[d][1::2]))
                            hits[d] = _merged(runs)
                            held = np.unique(win[mine])
                            got = np.bincount(np.concatenate([ix["item"][ix["item_at"][w] : ix["item_at"][w + 1]] for w in held]), minlength=len(names))
                            for i in np.flatnonzero(got):
                                items_[d].append(names[i])
                                shares[d].append(float(got[i] / of_item[i]))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(lo, n) for c in batch.columns[: len(columns)]), pa.array(np.diff(first).astype(np.int64)), pa.array(hits, pa.list_(pa.int64())), pa.array(items_, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                        names=[*columns, *new],
                    )

        out = out.mapInArrow(lean(run), out.schema)
    return out


def _merged(runs: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def is_contaminated(min_items: int = 2, min_share: float = 0.5, prefix: str = "_"):
    """Whether windows of several items, or a good part of one item's windows, occur."""
    return (F.size(f"{prefix}items") >= min_items) | F.exists(f"{prefix}shares", lambda x: x >= min_share)


def longest_quote(gap: int = 2, prefix: str = "_"):
    """The most hit words of a stretch whose runs have at most `gap` words between them."""
    first = F.struct(F.lit(-gap - 1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("most"))
    runs = F.zip_with(F.filter(f"{prefix}hits", lambda _, k: k % 2 == 0), F.filter(f"{prefix}hits", lambda _, k: k % 2 == 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def add(s, run):
        n = F.when(run["a"] - s["end"] <= gap, s["n"]).otherwise(F.lit(0).cast("long")) + run["b"] - run["a"]
        return F.struct(run["b"].alias("end"), n.alias("n"), F.greatest(s["most"], n).alias("most"))

    return F.aggregate(runs, first, add, lambda s: s["most"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """find_leaks() as counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more)."""
    leaks = find_leaks(only(docs, id_col, text_col), benchmark, text_col=text_col, **options)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign"))
    n_hit = F.aggregate("_hits", none, lambda s, x: F.struct((s["n"] + x * s["sign"]).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"])
    n_items = F.size("_items").cast("long")
    return leaks.select(F.col(id_col).alias("doc_id"), F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))
