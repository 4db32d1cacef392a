"""Graph operators against plain Python."""

import hashlib
import math
import random
import re
import subprocess
from collections import defaultdict, deque
from urllib.parse import urljoin

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftgraph import catalog
from weftgraph.functions import geometry, text
from weftgraph.operators import changes, community, edges, health, keyword, layout, rank, search, traverse
from weftgraph.sources import chunks, history


@pytest.fixture(scope="module")
def digraph(spark):
    r = random.Random(3)
    pairs = sorted({(r.randrange(60), r.randrange(60)) for _ in range(200)})
    rows = [(a, b, round(r.random(), 3)) for a, b in pairs if a != b]
    return rows, spark.createDataFrame(rows, "src long, dst long, confidence double")


def bfs(rows, start, depth):
    out = defaultdict(list)
    for a, b, _ in rows:
        out[a].append(b)
    dist, parent, queue = {start: 0}, {start: None}, deque([start])
    while queue:
        a = queue.popleft()
        if dist[a] == depth:
            continue
        for b in out[a]:
            if b not in dist:
                dist[b] = dist[a] + 1
                queue.append(b)
    for b in dist:
        if dist[b]:
            parent[b] = min(a for a, c, _ in rows if c == b and dist.get(a) == dist[b] - 1)
    return {b: (dist[b], parent[b]) for b in dist}


def test_frontier(spark, digraph):
    rows, df = digraph
    seeds = spark.createDataFrame([(0, 5), (1, 9)], "seed int, id long")
    got = traverse.frontier(seeds, df, 3).collect()
    for seed, start in ((0, 5), (1, 9)):
        assert {r.id: (r.depth, r.parent) for r in got if r.seed == seed} == bfs(rows, start, 3)


def test_trace(spark, digraph):
    rows, df = digraph
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    path = [r.id for r in traverse.trace(df, one(5), one(9)).orderBy("position").collect()]
    links = {(a, b) for a, b, _ in rows}
    assert path[0] in (5, 9) and all(p in links for p in zip(path, path[1:]))
    assert traverse.trace(df, one(5), one(5)).count() == 0


def test_pagerank(spark, digraph):
    rows, df = digraph
    n = 61  # one node without edges
    nodes = spark.range(n)
    out = defaultdict(set)
    for a, b, _ in rows:
        out[a].add(b)
    p = np.full(n, 1 / n)
    for _ in range(20):
        q = np.zeros(n)
        for a in range(n):
            if out[a]:
                for b in out[a]:
                    q[b] += p[a] / len(out[a])
            else:
                q += p[a] / n
        p = 0.15 / n + 0.85 * q
    got = {r.id: r.pagerank for r in rank.pagerank(nodes, df, iterations=20, tolerance=None).collect()}
    assert max(abs(got[i] - p[i]) for i in range(n)) < 1e-12
    focus = rank.pagerank(nodes, df, iterations=50, tolerance=1e-9, focus=spark.createDataFrame([(5,)], "id long"))
    assert abs(focus.agg(F.sum("pagerank")).head()[0] - 1) < 1e-9


def test_betweenness(spark):
    # a path a-b-c-d: b and c stand between
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    got = {r.id: r.betweenness for r in health.betweenness(df).collect()}
    assert got[0] == got[3] == 0 and math.isclose(got[1], 4 / 6) and math.isclose(got[2], 4 / 6)


def test_closure_and_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {tuple(r) for r in traverse.closure(df).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b}
    names = spark.createDataFrame([(i, f"n{i}") for i in range(1, 5)], "id long, name string")
    assert [tuple(r) for r in traverse.short_cycles(df, names, 6, 10).collect()] == [(3, "n1 > n2 > n3")]


def test_two_cliques(spark):
    rows = [(a, b, 1.0) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(0, 4, 0.1)]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = {r.id: r.community for r in community.detect(spark.range(8).withColumn("file", F.lit("f")), df).collect()}
    assert got == {i: 0 if i < 4 else 4 for i in range(8)}
    members = spark.createDataFrame(list(got.items()), "id long, community long")
    assert {r.community: r.cohesion for r in community.cohesion(members, df).collect()} == {0: round(6 / 6.1, 4), 4: round(6 / 6.1, 4)}
    moved = {r.id: r.community for r in community.detect(spark.range(8), df, method="moves").collect()}
    assert moved == got
    with pytest.raises(ValueError):
        community.detect(spark.range(8), df, method="moves", max_units=4)
    # files as units: two of them, with one weak link, are one community of all
    folded = community.detect(spark.range(8).withColumn("file", (F.col("id") / 4).cast("int")), df, unit="file")
    assert {r.community for r in folded.collect()} == {0}


def test_closure_of_a_long_path(spark):
    """100 steps: more than any fixed number of rounds would be set to."""
    df = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert traverse.closure(df).count() == 101 * 100 // 2


def test_shared_reach(spark):
    r = random.Random(3)
    walk = {(s, i) for s in range(150) for i in r.sample(range(400), r.randrange(1, 4))} | {(s, 999) for s in range(0, 150, 2)}
    got = {x.seed: x.shared for x in changes.shared_reach(spark.createDataFrame(list(walk), "seed long, id long")).collect()}
    by = defaultdict(set)
    for s, i in walk:
        by[i].add(s)
    assert got == {s: len(set().union(*(by[i] for t, i in walk if t == s)) - {s}) for s in range(150)}


def test_discs_have_cells_of_their_own():
    r = np.random.default_rng(1)
    at = layout.apart(np.vstack((r.normal(size=(300, 2)) * 3, np.zeros((50, 2)))), 2.0)
    assert len({tuple(x) for x in at}) == 350


def test_diff_by_hunk_lengths():
    """Changed lines that look like headers, files without git's header, a rename and a deletion."""
    text = """diff --git a/x b/x
--- a/x
+++ b/x
@@ -1 +1,3 @@
--- gone
+++ b/y
+@@ -1 +1 @@
+new
@@ -9,0 +12 @@ tail
+late
\\ No newline at end of file
diff --git a/old b/new
rename from old
rename to new
diff --git a/z b/z
deleted file mode 100644
--- a/z
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
"""
    got = [(f["path"], f["status"], f["ranges"], f["added"], f["removed"]) for f in history.parse_diff(text.replace("\\\\", "\\"))]
    assert got == [("x", "modified", [(1, 3), (12, 12)], 4, 1), ("new", "renamed", [], 0, 0), ("z", "deleted", [(1, 1)], 0, 2)]
    plain = "--- a/p\t2024\n+++ b/p\t2024\n@@ -1 +1 @@\n-a\n+b\n--- a/q\n+++ b/q\n@@ -3 +3 @@\n-a\n+b\n"
    assert [(f["path"], f["ranges"]) for f in history.parse_diff(plain)] == [("p", [(1, 1)]), ("q", [(3, 3)])]


def test_blame_and_log_of_a_repository(spark, tmp_path):
    repo = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for k, body in enumerate(("a\nb\nc\n", "a\nB\nc\n")):
        (tmp_path / "f.txt").write_text(body)
        run("add", "-A")
        run("commit", "-q", "-m", f"step {k}")
    lines = history.blame(spark, repo, ["f.txt"])
    own = history.blame_range(lines, "f.txt", 1, 2).orderBy("line").collect()
    assert [r.line for r in own] == [1, 2] and own[0].commit != own[1].commit and {r.author for r in own} == {"ann"}
    log = [r.subject for r in history.symbol_log(spark, repo, "f.txt", 2, 2).collect()]
    assert log == ["step 1", "step 0"] and history.symbol_log(spark, repo, "none", 1, 1).count() == 0
    heads = history.recent(history.commits(spark, repo), 1, "f.txt").collect()
    assert len(heads) == 1


def test_long_lines_are_kept(spark):
    body = "x = 1\n" * 300 + "y" * 20_000 + "\n" + "z = 2\n" * 10
    parts = chunks.body_chunks(body)
    assert sum(p[2].count("y") for p in parts) == 20_000 and max(len(p[2]) for p in parts) <= chunks.CHUNK_CAP


def test_similar_is_exact(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(200, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = defaultdict(list)
    for row in search.similar(df, k=3, threshold=-1.0, block_rows=64).collect():
        got[row.src].append((row.dst, row.score))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(200):
        assert {d for d, _ in got[i]} == set(np.argsort(-s[i])[:3])


def test_percentile_and_degrees(spark, digraph):
    rows, df = digraph
    got = {r.src: r.below for r in rank.percentile_below(df.select("src", "confidence").dropDuplicates(["src"]), "src", "confidence").collect()}
    assert 0 <= min(got.values()) and max(got.values()) < 1
    deg = {r.id: (r.fan_in, r.fan_out) for r in edges.degrees(df).collect()}
    assert all(deg[i] == (sum(b == i for _, b, _ in rows), sum(a == i for a, _, _ in rows)) for i in deg)


def test_morton_round_trip(spark):
    pts = spark.range(50).select((F.col("id") * 1311 % 65536).alias("x"), (F.col("id") * 7919 % 65536).alias("y"))
    for r in pts.withColumn("c", geometry.morton(F.col("x"), F.col("y"))).collect():
        x = sum((r.c >> 2 * i & 1) << i for i in range(16))
        y = sum((r.c >> 2 * i + 1 & 1) << i for i in range(16))
        assert (x, y) == (r.x, r.y)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("aB0_ .Zx", max_size=12), min_size=1, max_size=10))
def test_tokenize(spark, words):
    import re

    got = [r.t for r in spark.createDataFrame(list(enumerate(words)), "k int, w string").orderBy("k").select(text.tokenize(F.col("w")).alias("t")).collect()]
    assert got == [[p.lower() for p in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", w) if len(p) >= 2] for w in words]


def test_tables(spark, tmp_path):
    from weftgraph.sources.tables import GraphTables

    t = GraphTables(spark, str(tmp_path))
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    t.replace("node", nodes)
    t.replace("edge", spark.createDataFrame([("CALLS", 1, 2)], "rel string, src long, dst long"), "rel")
    t.append_edges(spark.createDataFrame([("CALLS", 2, 1), ("CALLS", 2, 9)], "rel string, src long, dst long"), nodes)
    assert t.read("edge").count() == 2
    t.update("node", "id", spark.createDataFrame([(2, "c")], "id long, name string"))
    t.delete("node", "id", spark.createDataFrame([(1,)], "id long"))
    assert [tuple(r) for r in t.read("node").collect()] == [(2, "c")]


def test_crawl(spark):
    from weftgraph.sources.web import crawl

    pages = spark.createDataFrame([("http://a/1", '<a href="/2">x</a><a href="http://b/9">y</a>'), ("http://a/2", '<a href="/3">x</a>'), ("http://a/3", "")], "url string, html string")
    kept, links = crawl(pages, pages.where("url = 'http://a/1'").select("url"), depth=1)
    assert {(r.url, r.depth) for r in kept.collect()} == {("http://a/1", 0), ("http://a/2", 1)}
    assert [tuple(r) for r in links.collect()] == [("http://a/1", "http://a/2")]


def test_html_text_of_all_pages(spark, tmp_path):
    rows = [(1, '<p\n class="x">one</p\n>two'), (2, "<b>plain</b> text"), (3, None), (4, "a<!-- x\ny -->b<script\nsrc='u'>z\n</script>c"), (5, "x <img\n\nsrc='u'\n>\ty")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))

    def want(html):
        out = html or ""
        for pattern in (r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
            out = re.sub(pattern, lambda m: "\n" * m.group().count("\n"), out)
        return re.sub(r"[ \t]+", " ", out).strip(" ")

    got = {r.page_id: (r.n_chars, r.hash) for r in catalog.queries()["html_text"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(want(h)), hashlib.sha1(want(h).encode()).hexdigest()) for i, h in rows}


def test_links_to_hosts_of_all_kinds(spark, tmp_path):
    a = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    rows = [(1, "http://a/d/1?q", a("/2", "/2#x", "http://b/9", "http://b/9#top", "3", "#top")), (2, "http://a/2", a("https://c/", "http://b/9", "/2")), (3, "http://b/9", a("http://a/2")), (4, "http://c/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    # urljoin differs for bare fragments and queries, which resolve() takes by directory
    links = defaultdict(set)
    for i, url, html in rows:
        for h in re.findall('href="([^"]*)"', html):
            folder = re.sub("[^/]*$", "", re.sub("[?#].*$", "", url))
            links[url.split("/")[2]].add((i, re.sub("#.*$", "", urljoin(url, h) if h.startswith(("/", "http")) else folder + h)))
    got = {r.src_host: (r.edges, r.targets) for r in catalog.queries()["links_to_hosts"](spark, str(tmp_path)).collect()}
    assert got == {h: (len(p), len({t for _, t in p})) for h, p in links.items()} == {"a": (7, 5), "b": (1, 1)}


def test_scan(spark, tmp_path):
    from weftgraph.sources.classify import scan

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"\0\1")
    (tmp_path / "src/c.txt").write_bytes(b"caf\xe9")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/d.py").write_text("")
    got = {r.path: (r.kind, r.text) for r in scan(spark, str(tmp_path), ["skip/"]).collect()}
    assert got == {"src/a.py": ("python", "x = 1\n"), "src/c.txt": ("text:text", "café")}


def test_keyword_index_follows_changes(spark, tmp_path):
    """After removals, changes and additions scores equal those of a scan of the live documents, compacted or not."""
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    text_of = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 40)))
    live = {k: text_of() for k in range(80)}
    frame = lambda rows: spark.createDataFrame([*rows.items()], "id long, text string")
    index = keyword.KeywordIndex(spark, str(tmp_path))
    index.build(frame(live))

    def same():
        want = {x.id: round(x.score, 9) for x in search.bm25(frame(live), "w1 w7 w7 w33 none", id_col="id", text_col="text").collect()}
        assert {x.id: round(x.score, 9) for x in index.search("w1 w7 w7 w33 none").collect()} == want

    same()
    gone = [k for k in live if k % 8 == 0]
    index.remove(frame({k: "" for k in gone}).select("id"))
    for k in gone:
        del live[k]
    changed = {k: text_of() for k in [3, 5, 0, 200, 201]}
    index.put(frame(changed))
    live |= changed
    same()
    changed = {k: text_of() for k in [3, 201]}
    index.put(frame(changed))
    live |= changed
    same()
    assert index.pending() > 0
    index.compact()
    assert index.pending() == 0
    same()
    assert index.search("nowhere").count() == 0


def test_search_by_kind_and_file_hits(spark):
    docs = spark.createDataFrame([(1, "parse line", "reads", "a"), (2, "parse", "line", "b"), (3, "other", "parse parse", "b")], "id long, name string, text string, kind string")
    assert [x.id for x in search.hybrid(docs, "parse", kind_col="kind", kinds=["a"]).collect()] == [1]
    assert {x.id for x in search.hybrid(docs, "parse").collect()} == {1, 2, 3}
    files = spark.createDataFrame([("f",), ("g",)], "file string")
    parts = spark.createDataFrame([("f", 1, 5, 0.5), ("f", 6, 9, 0.9), ("x", 1, 1, 1.0)], "file string, line_start int, line_end int, score double")
    words = spark.createDataFrame([("g", 2.0), ("f", 1.0), ("x", 9.0)], "file string, score double")
    got = [tuple(x) for x in search.file_hits(files, parts, words).collect()]
    assert got == [("f", round(0.9 + 8 / 61 + 8 / 62, 9), 6, 9), ("g", round(8 / 61, 9), None, None)]
