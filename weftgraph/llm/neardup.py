"""MinHash near-duplicates by an inverted join over signature coordinates.

1. One Arrow pass hashes each document's distinct word shingles and takes
   COORDINATES minima.  Documents of equal sets collapse to the one of the
   smallest id.
2. A signature is a set of (coordinate, value) pairs.  Two documents at the
   similarity agree in at least `matches` of them but for a chance of a few
   in a million (2.4e-6 at 0.85).  With the pairs in order of their frequency, rarest first,
   two such documents must meet in their first COORDINATES - matches + 1: only
   that prefix is posted.  Pairs of one document alone are skipped outright,
   so common passages, whose values are the frequent ones, post nothing.
3. Documents of a posting list (kept apart by classes of set size, since
   similar sets have similar sizes) are first compared with one leader alone,
   the one whose pairs are shared most.  A group of thousands of copies costs
   one comparison per copy, and the confirmed links make components.
4. What a list holds beside its leader's component is compared by differences.
   Let x* be the set in which x differs from the leader.  If x is not linked
   with the leader, it can only be linked with y if x* and y* overlap by more
   than nearly half of y*; so x* and y* must meet in short prefixes, again
   rarest first, where the edits of unrelated copies never meet.  The overlap of
   the differences also decides the link exactly.  Where two prefixes first
   meet, the shorter of what follows bounds the overlap: pairs that it rules
   out never leave the join.
5. Skip merging: the lists beyond a prefix, the long ones, are never merged;
   what a candidate pair has in them is looked up in its two signatures, which
   gives its whole count of collisions.  Pairs that agree in `matches`
   coordinates are confirmed on the full sets.

Defined cases: a null or wordless text has an empty set, is linked with nothing
and kept; repeated rows collapse like other copies; a null id takes part in no
link and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm import textops
from weftgraph.llm.components import connected_components
from weftgraph.llm.shared import cut, id_bitmap, in_bitmap, lean, only, small_batches

COORDINATES = 64

_XOR = textops.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL = textops.mix(_XOR) | np.uint64(1)


def _sets(part: textops.Slice, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    start, end, first = part.words(textops.SPACE)
    words = part.hashes(start, end)
    grams = textops.gram_hashes(words, shingle)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= shingle:
            s = np.sort(grams[a : b - shingle + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield textops.gram_hashes(words[a:b], int(b - a))
        else:
            yield grams[:0]


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the set; null if empty), sig."""
    rows = only(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch.column(1), lower=True):
                sets = list(_sets(part, shingle))
                size = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                full = np.flatnonzero(size)
                sig = np.zeros((len(sets), COORDINATES), np.int32)
                if len(full):
                    at = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    for k in range(COORDINATES):
                        v = ((flat ^ _XOR[k]) * _MUL[k]) >> np.uint64(32)
                        sig[full, k] = np.minimum.reduceat(v, at).astype(np.uint32).view(np.int32)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                off = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, len(part)), pa.array(size), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(off, pa.array(sig.ravel()))],
                    names=["doc_id", "n_shingles", "set_key", "sig"],
                )

    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, set_key binary, sig array<int>")


def match_threshold(similarity: float, coordinates: int = COORDINATES) -> int:
    """Coordinates that a pair at the similarity has in common but for five standard deviations."""
    return max(1, math.floor(coordinates * similarity - 5 * math.sqrt(coordinates * similarity * (1 - similarity))))


def postings(reps: DataFrame, matches: int, percent: int) -> DataFrame:
    """(token, class, node, score): each document under its rarest coordinate-value pairs; score: how much its pairs are shared."""
    prefix = COORDINATES - matches + 1
    step = math.log(100 / percent)
    tokens = reps.select(F.col("rep").alias("node"), "n_shingles", F.posexplode("sig").alias("_k", "_v"))
    tokens = tokens.select("node", "n_shingles", (F.shiftleft(F.col("_k").cast("long"), 32) + F.col("_v")).alias("token"))
    often = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    held = tokens.join(often, "token").groupBy("node", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("_t"))
    take = F.greatest(F.lit(0), F.lit(prefix - COORDINATES) + F.size("_t"))
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int")
    score = F.aggregate("_t", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    posted = held.select("node", score.alias("score"), size_class.alias("_c"), F.explode(F.slice("_t", F.lit(1), take)).alias("_p"))
    return posted.select("node", "score", F.col("_p.token").alias("token"), F.explode(F.array(F.col("_c"), F.col("_c") + 1)).alias("class"))


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, matches: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar: first by signature, then on the full sets."""
    sig = reps.select(F.col("rep"), "sig")
    near = (
        pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        .where(F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= matches)
        .select("a", "b")
    )
    near = cut(near, "candidates")
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = _members(near, docs, shingle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = full.select(F.col("doc_id").alias("a"), F.col("members").alias("ma"))
    right = full.select(F.col("doc_id").alias("b"), F.col("members").alias("mb"))
    both = near.join(left, "a").join(right, "b").select("a", "b", "ma", "mb")
    return cut(both.mapInArrow(lean(compare), f"a {kind}, b {kind}"), "links")


def _members(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, members): the full sets of the documents in pairs (a, b)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()

    table, bits = id_bitmap(wanted, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(table.value, batch.column(2).to_numpy(), bits)
            if keep.any():
                likely = batch.filter(pa.array(keep))
                for part in textops.slices(likely.column(1), lower=True):
                    got = [s.tobytes() for s in _sets(part, shingle)]
                    yield pa.RecordBatch.from_arrays([likely.column(0).slice(part.lo, len(part)), pa.array(got, pa.binary())], names=["doc_id", "members"])

    full = docs.withColumn("_h", F.xxhash64("doc_id")).mapInArrow(lean(sets), f"doc_id {kind}, members binary")
    # a table of its own, so that what joins it may be split where one leader has many partners
    return cut(full.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sets")


def _beside_leaders(stars: DataFrame, links: DataFrame, parts: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of one star (a: leader, b) of which one isn't linked with the leader.

    With r = (100 - percent) / (100 + percent), x and y are linked if and only
    if they differ in at most r * (|x| + |y|) members.  Of x* and y*, what x
    and y differ in from the leader, the symmetric difference is that of x and
    y.  Where x is not linked with the leader, an overlap of over
    (1 - r) / 2 * |y*| follows, and for both of |x*| - r * |x| * (1 + 100 / percent).
    """
    r, wide = (100 - percent) / (100 + percent), 1 + 100 / percent
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = stars.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").fillna(False, ["linked"])
    open_ = seen.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("linked")).cast("long")).alias("apart")).where("n > 1 AND apart > 0").select("a")
    need = cut(seen.join(open_, "a"), "open-stars")
    full = _members(need, docs, shingle)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, delta, linked = [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                d = np.setxor1d(x, y, assume_unique=True)
                size.append(len(y))
                delta.append(textops.signed(d))
                linked.append((100 + percent) * len(d) <= (100 - percent) * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(linked, pa.bool_()), pa.array(delta, pa.list_(pa.int64()))], names=["a", "x", "size", "linked", "delta"])

    both = need.join(full.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b").select("a", "b", "ma", "mb")
    delta = cut(both.mapInArrow(lean(differ), f"a {kind}, x {kind}, size int, linked boolean, delta array<long>"), "differences")
    part = parts.select(F.col("node").alias("x"), F.col("component").alias("part"))
    each = delta.select("a", "x", "size", "linked", F.size("delta").alias("n"), F.explode("delta").alias("member"))
    often = each.groupBy("a", "member").agg(F.count(F.lit(1)).alias("_f")).where("_f > 1")
    held = each.join(often, ["a", "member"]).groupBy("a", "x", "size", "linked", "n").agg(F.array_sort(F.collect_list(F.struct("_f", "member"))).alias("_m"))
    shared = need.groupBy(F.col("b").alias("x")).agg(F.collect_set("a").alias("stars"))  # no more than its posting lists
    held = held.join(part, "x", "left").withColumn("part", F.coalesce("part", "x")).join(shared, "x")
    alone = F.col("n") - F.size("_m")
    least = F.col("n") - F.lit(r * wide) * F.col("size")
    overlap = F.greatest(F.lit(1), F.ceil(least - 1e-6))
    index = F.greatest(overlap, F.ceil(F.lit((1 - r) / 2) * F.col("n") - 1e-6))
    short = lambda o: F.greatest(F.lit(0), F.col("n") - o + 1 - alone).cast("int")
    held = cut(held.select("a", "x", "size", "linked", "n", "part", "stars", "_m", short(index).alias("_i"), short(overlap).alias("_o")), "prefixes")
    posted = lambda n: F.posexplode(F.slice(F.col("_m.member"), F.lit(1), F.col(n)))
    rest = F.size("_m") - F.col("_at")
    left = held.where("NOT linked").select("*", posted("_o").alias("_at", "member"))
    left = left.select("a", F.col("x").alias("u"), F.col("size").alias("su"), F.col("n").alias("nu"), F.col("part").alias("pu"), F.col("stars").alias("tu"), rest.alias("ru"), "member")
    right = held.select("*", posted("_i").alias("_at", "member"))
    right = right.select("a", F.col("x").alias("y"), F.col("size").alias("sy"), F.col("n").alias("ny"), F.col("part").alias("py"), F.col("stars").alias("ty"), rest.alias("ry"), "linked", "member")
    # a pair of several stars in common is compared in the first of them alone
    once = F.array_min(F.array_intersect("tu", "ty")) == F.col("a")
    # where two prefixes first meet, what follows in the shorter rest bounds the overlap
    reach = 2 * F.least("ru", "ry") >= F.col("nu") + F.col("ny") - F.lit(r) * (F.col("su") + F.col("sy")) - 1e-6
    meet = left.join(right, ["a", "member"]).where(reach & (F.col("pu") != F.col("py")) & once & (F.col("linked") | (F.col("u") < F.col("y"))))
    pairs = cut(meet.select("a", "u", "y").distinct(), "different")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for su, sy, du, dy in zip(batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4), batch.column(5)):
                du, dy = du.values.to_numpy(), dy.values.to_numpy()
                far = len(du) + len(dy) - 2 * len(np.intersect1d(du, dy, assume_unique=True))
                keep.append((100 + percent) * far <= (100 - percent) * (int(su) + int(sy)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = delta.select("a", F.col("x").alias("u"), F.col("size").alias("su"), F.col("delta").alias("du"))
    other = delta.select("a", F.col("x").alias("y"), F.col("size").alias("sy"), F.col("delta").alias("dy"))
    checked = pairs.join(own, ["a", "u"]).join(other, ["a", "y"]).select(F.col("u").alias("a"), F.col("y").alias("b"), "su", "sy", "du", "dy")
    return cut(checked.mapInArrow(lean(compare), f"a {kind}, b {kind}"), "more-links")


def _linked(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, the document that stands for each set, and the components of these; all written tables."""
    matches = match_threshold(percent / 100)
    signed = cut(signatures(docs, shingle=shingle), "signatures")
    reps = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = cut(reps, "sets-by-key")
    # an id that repeats with several texts stands for one of them only in the joins below; its rows share the component
    nodes = cut(reps.dropDuplicates(["rep"]), "nodes")
    posted = cut(postings(nodes, matches, percent), "postings")
    lists = ["token", "class"]

    leader = posted.groupBy(*lists).agg(F.max(F.struct("score", "node")).getField("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = cut(posted.join(leader, lists).where("node <> a").select("a", F.col("node").alias("b")).distinct(), "stars")
    links = _confirmed(stars, nodes, docs, shingle, matches, percent)
    parts = cut(connected_components(links, "a", "b"), "parts")
    more = _beside_leaders(stars, links, parts, docs, shingle, percent)
    parts = cut(connected_components(links.union(more), "a", "b"), "components")
    return signed, reps, parts


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Links are pairs with 100 * intersection >= percent * union of their sets
    of word shingles; component_id is the smallest id reachable over links.
    """
    docs = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "text")
    with small_batches(docs.sparkSession):
        signed, reps, parts = _linked(docs, shingle, percent)
    found = reps.select("set_key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("_component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
