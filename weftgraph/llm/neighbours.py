"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt into shards of about SHARD_ROWS by a hash of their id.  Each
shard builds a graph: points come in by growing batches; a greedy search from
the point nearest the centre proposes neighbours, and relaxed distance pruning
keeps an edge only if no kept neighbour is nearer to its end by the factor
ALPHA, so edges are diverse.  Reverse edges are added and pruned alike.  Greedy
and pruned distances are Euclidean, on vectors with one component more that
brings all to one length: their order is that of the largest inner product.

Rows of a shard that are equal to the graph (in single precision) are one point
of it, as pruning would leave all but one of them without an edge to them.  A
point found stands for all its rows: its distinct vectors are scored each, and
each gives as many of its smallest ids as the result can hold.

Queries meet every shard, in blocks of QUERY_ROWS: a beam search finds each
one's nearest in the shard, scored in double precision on the original vectors,
and the shards' results are merged by rank.  The index covers every row; it is
a table in the shared folder, so a lost executor repeats a shard at most.

Defined cases: vectors that are null, zero, of another width than most, or hold
null or non-finite components take no part, nor do rows of null id; with fewer
candidates than k all are returned; equal scores go by the smaller id; repeated
rows (same id) are one candidate each, but never their own id's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.llm.shared import cut

SHARD_ROWS, QUERY_ROWS = 8192, 8192
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 128, 1.2
EXPAND = 4


def beam_search(x: np.ndarray, edges: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the beam's ids and squared distances, nearest first (id -1: none).

    edges: a row of neighbour ids for each point, padded with -1.
    """
    b, n = len(q), len(x)
    norm = np.einsum("ij,ij->i", x, x)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    ids = np.full((b, beam), n, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    rows = np.arange(b)[:, None]

    def near(cand: np.ndarray) -> np.ndarray:
        at = np.minimum(cand, n - 1)
        d = norm[at] - 2 * np.matmul(x[at], q[:, :, None])[:, :, 0]
        d[cand == n] = np.inf
        return d

    start = np.broadcast_to(entry, (b, len(entry)))[:, :beam]
    seen[rows, start] = True
    ids[:, : start.shape[1]], dist[:, : start.shape[1]], done[:, : start.shape[1]] = start, near(start), False
    while True:
        order = np.where(done, np.inf, dist)
        pick = np.argpartition(order, EXPAND - 1, axis=1)[:, :EXPAND]
        ok = np.isfinite(np.take_along_axis(order, pick, 1))
        live = ok.any(axis=1)
        if not live.any():
            break
        np.put_along_axis(done, pick, True, 1)
        from_ = np.where(ok, np.take_along_axis(ids, pick, 1), n)
        cand = np.where(from_[:, :, None] == n, n, edges[np.minimum(from_, n - 1)])
        cand = np.where(cand < 0, n, cand).reshape(b, -1)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
        cand[seen[rows, cand]] = n
        seen[rows, cand] = True
        both = np.concatenate((ids, cand), 1)
        far = np.concatenate((dist, near(cand)), 1)
        flag = np.concatenate((done, cand == n), 1)
        keep = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        ids, dist, done = (np.take_along_axis(v, keep, 1) for v in (both, far, flag))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of own at most `degree` diverse ids among its candidates (-1: none)."""
    b, c = cand.shape
    cand = np.sort(cand, axis=1)
    bad = (cand < 0) | (cand == own[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    at = np.maximum(cand, 0)
    v = x[at]
    d = ((v - x[own][:, None, :]) ** 2).sum(axis=2)
    d[bad] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    norm = np.einsum("bcd,bcd->bc", v, v)
    rows = np.arange(b)
    alive = np.isfinite(d)
    out = np.full((b, degree), -1, np.int64)
    for k in range(degree):
        first = alive.argmax(axis=1)
        ok = alive[rows, first]
        if not ok.any():
            break
        out[ok, k] = cand[rows, first][ok]
        w = v[rows, first]
        gap = norm + norm[rows, first][:, None] - 2 * np.matmul(v, w[:, :, None])[:, :, 0]
        alive &= ~(ok[:, None] & (alpha * alpha * np.maximum(gap, 0) <= d))
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges of every point, and the entry point."""
    n = len(x)
    slack = degree + degree // 2
    edges = np.full((n, slack), -1, np.int64)
    fill = np.zeros(n, np.int64)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    at, width = 1, 1
    while at < n:
        step = order[at : at + width]
        found, _ = beam_search(x, edges, np.array([entry]), x[step], beam)
        kept = robust_prune(x, step, found, degree, alpha)
        edges[step, :degree] = kept
        fill[step] = (kept >= 0).sum(axis=1)
        src = np.repeat(step, degree)
        dst = kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        first = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1]))) if len(dst) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(dst)))
        goal = dst[first]
        place = np.arange(len(dst)) - np.repeat(first, size) + fill[dst]
        fits = place < slack
        edges[dst[fits], place[fits]] = src[fits]
        over = np.flatnonzero(fill[goal] + size > slack)
        fill[goal] = np.minimum(fill[goal] + size, slack)
        for k in range(0, len(over), 256):
            part = over[k : k + 256]
            most = int(size[part].max())
            extra = np.full((len(part), most), -1, np.int64)
            for r, o in enumerate(part):
                extra[r, : size[o]] = src[first[o] : first[o] + size[o]]
            pruned = robust_prune(x, goal[part], np.concatenate((edges[goal[part]], extra), 1), degree, alpha)
            edges[goal[part]] = -1
            edges[goal[part], :degree] = pruned
            fill[goal[part]] = (pruned >= 0).sum(axis=1)
        at, width = at + width, min(512, max(1, at), width * 2)
    return edges, entry


def first_equal(rows: np.ndarray) -> np.ndarray:
    """For each row the number of the first row equal to it."""
    rows = np.ascontiguousarray(rows + 0.0)  # one zero
    _, first, of = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first[of]


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): for each k the numbers first[k] to first[k] + size[k], and k beside each."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]


def _place(group: np.ndarray) -> np.ndarray:
    """Each row's place within its group, from 0; groups lie together."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(fine)
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").head()
    return rows.where(F.size("v") == (widths.w if widths else 0))


def build_index(rows: DataFrame, *, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The index as a table (shard, pos, vec_id, v, node, edges, entry), and its number of shards."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("longest")).head()
    shards = max(1, math.ceil(stats.n / shard_rows))
    longest = stats.longest or 0.0
    kind = rows.schema["vec_id"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        v = _matrix(table["v"])
        lift = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", v, v), 0))
        x = np.column_stack((v, lift)).astype(np.float32)
        node = first_equal(x)
        own = np.flatnonzero(node == np.arange(len(x)))
        graph, entry = build_graph(np.ascontiguousarray(x[own]))
        edges = [np.zeros(0, np.int32)] * len(x)
        for p, e in zip(own, graph):
            edges[p] = own[e[e >= 0]].astype(np.int32)
        return pa.table({"shard": table["shard"], "pos": pa.array(np.arange(len(v), dtype=np.int32)), "vec_id": table["vec_id"], "v": table["v"], "node": pa.array(node.astype(np.int32)), "edges": pa.array(edges, pa.list_(pa.int32())), "entry": pa.array(np.full(len(v), own[entry], np.int32))})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards)).cast("int")).select("shard", "vec_id", "v")
    return cut(dealt.groupBy("shard").applyInArrow(build, f"shard int, pos int, vec_id {kind}, v array<double>, node int, edges array<int>, entry int"), "vector-index"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, *, k: int = 20, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, v) its k nearest of the index but its own id."""
    blocks = max(1, math.ceil(queries.count() / query_rows))
    kind = queries.schema["vec_id"].dataType.simpleString()
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = pa.table({"query_id": pa.array([], index.select("vec_id").limit(0).toArrow().schema[0].type), "vec_id": pa.array([], index.select("vec_id").limit(0).toArrow().schema[0].type), "score": pa.array([], pa.float64())})

    def find(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(rows) or not len(wanted):
            return none
        rows = rows.sort_by("pos").combine_chunks()
        v, q = _matrix(rows["v"]), _matrix(wanted["v"])
        lift = np.einsum("ij,ij->i", v, v)
        x = np.column_stack((v, np.sqrt(np.maximum(lift.max() - lift, 0)))).astype(np.float32)
        far = rows["edges"].combine_chunks()
        size = np.diff(np.asarray(far.offsets))
        edges = np.full((len(v), max(1, int(size.max()))), -1, np.int64)
        edges[np.repeat(np.arange(len(v)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(far.flatten())
        entry = np.array([rows["entry"][0].as_py()])
        out = []
        ids, own = rows["vec_id"].combine_chunks(), wanted["query_id"].combine_chunks()
        number = {i: [] for i in own.to_pylist()}
        for p, i in enumerate(ids.to_pylist()):
            if i in number:
                number[i].append(p)
        # a query's own id is at most so many rows
        most = k + max(map(len, number.values()))
        exact = first_equal(v)
        member = np.argsort(exact, kind="stable")
        member = member[_place(exact[member]) < most]
        heads = np.flatnonzero(exact == np.arange(len(v)))
        member_size = np.bincount(exact[member], minlength=len(v))
        member_at = np.cumsum(member_size) - member_size
        node = np.asarray(rows["node"])
        heads = heads[np.argsort(node[heads], kind="stable")]
        head_size = np.bincount(node[heads], minlength=len(v))
        head_at = np.cumsum(head_size) - head_size
        for a in range(0, len(q), 512):
            asked_ = q[a : a + 512]
            part = np.column_stack((asked_, np.zeros(len(asked_)))).astype(np.float32)
            found, _ = beam_search(x, edges, entry, part, max(beam, 2 * k))
            row, col = np.nonzero(found >= 0)
            which, at = _spread(head_at[found[row, col]], head_size[found[row, col]])
            row, head = row[which], heads[at]
            score = np.concatenate([np.zeros(0), *(np.einsum("bd,bd->b", v[head[c : c + 65536]], asked_[row[c : c + 65536]]) for c in range(0, len(row), 65536))])
            best = np.lexsort((head, -score, row))
            best = best[_place(row[best]) < most]
            row, head, score = row[best], head[best], score[best]
            which, at = _spread(member_at[head], member_size[head])
            row, at, score = row[which], member[at], score[which]
            mine = np.array([r * len(v) + p for r in range(len(part)) for p in number[own[a + r].as_py()]], np.int64)
            other = ~np.isin(row * len(v) + at, mine) & np.isfinite(score)
            row, at, score = row[other], at[other], score[other]
            best = np.lexsort((at, -score, row))
            best = best[_place(row[best]) < k]
            out.append(pa.table({"query_id": own.take(pa.array(row[best] + a)), "vec_id": ids.take(pa.array(at[best])), "score": pa.array(score[best])}))
        return pa.concat_tables(out)

    near = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(find, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """Index all usable vectors and search for those that the condition `queries` (on vec_id) picks."""
    rows = cut(usable(vectors, id_col, vector_col), "vectors")
    index, shards = build_index(rows)
    return search(index, shards, rows.where(queries), k=k, beam=beam)
