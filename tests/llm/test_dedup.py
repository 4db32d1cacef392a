"""Near-duplicates, repeated windows and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import induction, neardup, substrings, suffixes
from weftgraph.llm.components import connected_components
from weftgraph.llm.induction import repeats

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, shingle=n, percent=percent).collect()}
    assert got == components(texts, n, percent)


def test_near_group_of_edited_copies(spark):
    # a large group: the leader links some, the rest is told by differences
    r = random.Random(5)
    words = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(160):
        w = list(words)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == {i: c for i, (_, c, _) in components(rows, 3, 85).items()}


def test_near_duplicates_odd_rows(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == 4 and all(r.kept for r in rows)


def test_components(spark):
    df = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def windows_removed(texts, size):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = bytearray(len(w))
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if g in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(g)
        kept = " ".join(x for x, r in zip(w, gone) if not r)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("base", [5, 10])
def test_windows(docs, texts, base):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substrings.remove_repeats(docs, window=20, base=base).collect()}
    assert got == windows_removed(texts, 20)


def test_windows_odd_rows(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(df).collect()] == [0, 0, 0]


def strings_removed(texts, size):
    data = {i: (t or "").encode() for i, t in texts}
    count = Counter(b[k : k + size] for b in data.values() for k in range(len(b) - size + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, r in zip(b, gone) if not r)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_strings(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) for r in suffixes.remove_repeated_strings(docs, length=400).collect()}
    assert got == strings_removed(texts, 400)


def test_strings_short_shards(docs, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffixes, "QUEUE_BYTES", 500)
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeated_strings(docs, length=120, gram=30, keep_bytes=False).collect()}
    assert got == {i: v[1] for i, v in strings_removed(texts, 120).items()}


def test_strings_empty(empty):
    assert suffixes.remove_repeated_strings(empty).count() == 0


def test_induced_sorting(tmp_path):
    for seed in range(60):
        r = random.Random(seed)
        size = r.randint(1, 15)
        t = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(1, 200))]
        t += t[2:40] + [0]
        marks = repeats(np.array(t, np.uint16), size, str(tmp_path), memory=r.choice([64, 1 << 20]))
        count = Counter(tuple(t[k : k + size]) for k in range(len(t) - size + 1))
        assert all(marks[k] == (count[tuple(t[k : k + size])] > 1) for k in range(len(t) - size + 1) if 0 not in t[k : k + size])


def test_recursive_order(tmp_path, monkeypatch):
    """Suffixes of any alphabet, in tiny blocks, ranges and queues: the order of plain sorting."""
    for seed in range(60):
        r = random.Random(seed)
        monkeypatch.setattr(induction, "SMALL_ALPHABET", r.choice([2, 8, 512]))
        monkeypatch.setattr(induction, "BLOCK", r.choice([4, 16, 1 << 16]))
        monkeypatch.setattr(induction, "SHORT", r.choice([0, 0, 1 << 17]))
        monkeypatch.setattr(induction, "IN_MEMORY", r.choice([0, 64, 1 << 20]))
        t = [1, 2] * r.choice([0, 50]) + [r.randint(0, r.choice([1, 3, 30, 600])) for _ in range(r.randint(1, 120))]
        t += t[: r.choice([0, 40])]
        assert induction.suffix_order(np.array(t, np.int32), str(tmp_path), r.choice([64, 1 << 20])).tolist() == sorted(range(len(t)), key=lambda k: t[k:])


def test_queues_spill_in_a_shard_of_usual_size(tmp_path):
    r = np.random.default_rng(1)
    text = r.integers(97, 117, suffixes.SHARD_BYTES).astype(np.uint16)
    text[300_000:300_900] = text[1000:1900]
    is_s = induction.types(text, str(tmp_path))
    seeds = induction.seed_order(text, is_s, induction.lms_positions(is_s, str(tmp_path)), str(tmp_path), suffixes.QUEUE_BYTES)
    assert induction.induce(text, is_s, seeds, None, str(tmp_path), suffixes.QUEUE_BYTES, 0) > 0
    marks = repeats(text, 400, str(tmp_path), suffixes.QUEUE_BYTES)
    assert np.flatnonzero(marks).tolist() == [*range(1000, 1501), *range(300_000, 300_501)]


def test_one_anchor_larger_than_memory(spark, monkeypatch):
    """A passage that all texts share, each with neighbours of its own, is one shard many times the queue and the block."""
    monkeypatch.setattr(suffixes, "QUEUE_BYTES", 1 << 12)
    monkeypatch.setattr(induction, "IN_MEMORY", 1 << 10)
    monkeypatch.setattr(induction, "SHORT", 0)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1 << 10)
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(450))
    rows = [(k, "".join(r.choice("ijklmnop ") for _ in range(380)) + passage + "".join(r.choice("qrstuvw ") for _ in range(380))) for k in range(60)]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffixes.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"), keep_bytes=False).collect()}
    data = [t.encode() for _, t in rows]
    count = Counter(t[k : k + 400] for t in data for k in range(len(t) - 399))
    for (i, _), t in zip(rows, data):
        gone = set()
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone |= set(range(k, k + 400))
        assert got[i] == (len(gone), 1)


def test_nothing_is_lost_to_the_bitmap(docs):
    from weftgraph.llm.shared import id_bitmap, in_bitmap

    ids = docs.select("doc_id").distinct()
    table, bits = id_bitmap(ids, "doc_id")
    assert in_bitmap(table.value, ids.select(F.xxhash64("doc_id")).toPandas().iloc[:, 0].to_numpy(), bits).all()
