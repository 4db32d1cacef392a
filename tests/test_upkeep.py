"""Incremental passes against full ones, tiles, caches, scans and the other things that follow changes."""

import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import geometry
from weftgraph.operators import layout, views
from weftgraph.sources import links, tables, walk
from weftgraph.streaming import maintain
from weftgraph.streaming.feed import EVENTS, LiveTables


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_incremental_references_equal_a_full_pass(spark, tmp_path):
    """Edits that move, rename, add and drop definitions and imports; references of untouched files follow."""
    live = LiveTables(spark, str(tmp_path / "live"))
    live.start()
    now = {
        "a.py": "from b import helper\n\ndef run():\n    helper()\n    shared()\n    return only()\n",
        "b.py": "def helper():\n    return 1\n",
        "c.py": "def shared():\n    return 2\n",
        "d.py": "import c\n\ndef user():\n    shared()\n    c.shared()\n",
    }
    script = [
        now,
        {"b.py": "# moved\n\ndef helper():\n    return 1\n", "e.py": "def shared():\n    return 3\n\ndef only():\n    return 4\n"},
        {"c.py": None, "d.py": "import e\n\ndef user():\n    e.shared()\n    shared()\n"},
    ]
    for at, batch in enumerate(script):
        live.apply(spark.createDataFrame([(p, "python", t, at) for p, t in batch.items()], EVENTS))
        now = {**now, **batch}
    full = spark.createDataFrame([(p, "python", t) for p, t in now.items() if t is not None], "path string, kind string, text string")
    want = live._rows(full)
    assert rows_of(live.read("symbol")) == rows_of(want["symbol"])
    edges = live._edges(want["raw_edge"], want["symbol"], full)
    assert rows_of(live.read("edge")) == rows_of(edges) and edges.count() > 4
    # a small graph is always ranked anew, and the state is cleared
    assert live.refresh_ranks() and live.read("state").count() == 0
    assert abs(live.read("rank").agg(F.sum("pagerank")).head()[0] - 1) < 1e-9


def test_drift_and_carrying(spark):
    state = spark.createDataFrame([(3,), (3,)], "changed long")
    assert maintain.drift(state, 100, 60_000) and not maintain.drift(state, 1000, 60_000) and maintain.drift(state.limit(0), 10, 10)
    base = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, v double")
    pending = spark.createDataFrame([(2, 9.0), (3, 3.0)], "id long, v double")
    assert {tuple(r) for r in maintain.with_pending(base, pending).collect()} == {(1, 0.1), (2, 9.0), (3, 3.0)}
    files = spark.createDataFrame([("a", 5.0, None), ("b", None, None)], "f string, ax double, ay double")
    x, y = maintain.place_new(F.col("f"), 100.0, F.col("ax"), F.col("ay"))
    got = {r.f: (r.x, r.y) for r in files.select("f", x.alias("x"), y.alias("y")).collect()}
    assert abs(got["a"][0] - 5.0) <= 40.0 and abs(got["b"][0] ** 2 + got["b"][1] ** 2 - 1e4) < 1e-6


def test_scope_of_a_change(spark):
    sym = lambda *r: spark.createDataFrame(list(r), "name string, file string")
    raw = spark.createDataFrame([("u.py", "CALLS", "Do_it"), ("v.py", "CALLS", "other"), ("w.py", "CALLS", "gone")], "path string, rel string, name string")
    imp = "path string, rel string, module string, name string, alias string, line int, file string"
    before = spark.createDataFrame([("x.py", "IMPORTS", "m", "m", None, 1, None), ("y.py", "IMPORTS", "x", "x", None, 1, "x.py")], imp)
    after = spark.createDataFrame([("x.py", "IMPORTS", "m", "m", None, 1, "m.py"), ("y.py", "IMPORTS", "x", "x", None, 1, "x.py")], imp)
    changed = spark.createDataFrame([("m.py",)], "path string")
    got = maintain.to_resolve(changed, sym(("gone", "m.py")), sym(("doit", "m.py"), ("other", "n.py")), raw, before, after)
    assert {r.path for r in got.collect()} == {"m.py", "u.py", "w.py", "x.py", "y.py"}
    assert maintain.to_resolve(changed.limit(0), sym(), sym(), raw, before, before).count() == 0


def test_quiet_and_cancel(spark):
    quiet, ran = maintain.Quiet(3.0), []
    assert not quiet.due(100.0)
    quiet.changed(1.0)
    assert not quiet.run(lambda: ran.append(1), 2.0) and quiet.run(lambda: quiet.changed(5.0), 4.5)
    assert not quiet.due(7.0) and quiet.run(lambda: ran.append(2), 8.0) and not quiet.due(99.0) and ran == [2]
    one = maintain.Pass(spark, "pass-1")
    assert one.phase("count", lambda: spark.range(3).count()) == 3
    one.cancel()
    with pytest.raises(maintain.Cancelled):
        one.phase("next", lambda: None)
    assert one.events == [("start", "count"), ("end", "count")]


def test_progress_events(spark, tmp_path):
    seen = maintain.Progress()
    spark.streams.addListener(seen)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"v": 1}\n')
    q = spark.readStream.schema("v int").json(str(tmp_path / "in")).writeStream.queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).format("noop").start()
    q.processAllAvailable()
    q.stop()
    q.awaitTermination(10)
    for _ in range(50):
        if any(e[0] == "progress" and e[2] == 1 for e in seen.events):
            break
        import time

        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert ("started", "feed", 0) in seen.events and ("progress", "feed", 1) in seen.events


def test_tile_store_follows_patches(spark, tmp_path):
    """After patches the store holds what a fresh one would, and emptied tiles stay readable."""
    place = lambda rows: layout.with_codes(spark.createDataFrame(rows, "id long, x double, y double"), 0.0, 100.0)
    now = {k: (k, float(k % 10 * 10), float(k // 10 * 10)) for k in range(100)}
    store = layout.TileStore(spark, str(tmp_path / "tiles"))
    store.save(place([*now.values()]))
    alone = 99  # the only one of its tile goes elsewhere
    changed = [(alone, 1.0, 1.0), (5, 50.0, 50.0), (200, 33.0, 3.0)]
    store.patch(place(changed), spark.createDataFrame([(7,), (8,)], "id long"))
    now |= {k: (k, x, y) for k, x, y in changed}
    del now[7], now[8]
    key = lambda df: sorted((r.id, r.x, r.y, r.code) for r in df.collect())
    assert key(store.read()) == key(place([*now.values()]))
    store.patch(place([(alone, 99.0, 99.0)]), spark.createDataFrame([], "id long"))
    now[alone] = (alone, 99.0, 99.0)
    assert key(store.read()) == key(place([*now.values()]))
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 95, 0.9), (95, 96, 0.9), (2, 1, 0.1)], "src long, dst long, confidence double")
    inside, found, ghosts = layout.tile(store.read(), edges, 1, 0, 0, 0.5)
    assert {(r.src, r.dst) for r in found.collect()} == {(1, 2), (1, 95)} and [r.id for r in ghosts.collect()] == [95]
    assert layout.pick_lod({"sym": store.read(), "file": store.read().limit(3)}, 0, 0, 0, 50) == "file"
    heavy = spark.range(3000).select(F.lit(1).cast("long").alias("src"), F.lit(2).cast("long").alias("dst"), F.lit(None).cast("double").alias("confidence"), F.col("id").cast("double").alias("weight"))
    assert layout.tile(store.read().where("id = 1"), heavy, 0, 0, 0, aggregated=True)[1].agg(F.min("weight")).head()[0] == 1000.0


def test_parse_cache(spark, tmp_path):
    cache = tables.ParseCache(spark, str(tmp_path / "cache"), 4)
    files = lambda *r: spark.createDataFrame(list(r), "path string, hash string")
    hit, todo = cache.lookup(files(("a", "1")))
    assert hit is None and todo.count() == 1
    cache.store(spark.createDataFrame([(f"f{k}", "1", f"r{k}") for k in range(20)], "path string, hash string, result string"))
    hit, todo = cache.lookup(files(("f1", "1"), ("f2", "2"), ("new", "1")))
    assert [r.result for r in hit.collect()] == ["r1"] and {r.path for r in todo.collect()} == {"f2", "new"}
    cache.store(spark.createDataFrame([("f2", "2", "changed")], "path string, hash string, result string"), spark.createDataFrame([(f"f{k}",) for k in range(20) if k != 2], "path string"))
    hit, todo = cache.lookup(files(("f1", "1"), ("f2", "2")))
    assert [r.result for r in hit.collect()] == ["changed"] and [r.path for r in todo.collect()] == ["f1"]


def test_vectors_and_relations(spark, tmp_path):
    store = tables.GraphTables(spark, str(tmp_path))
    store.replace("vec", spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "id long, ehash string, embedding array<double>"))
    store.append_vectors("vec", spark.createDataFrame([(2, "c", [9.0]), (3, "d", [3.0]), (3, "d", [3.0])], "id long, ehash string, embedding array<double>"))
    assert {(r.id, r.embedding[0]) for r in store.read("vec").collect()} == {(1, 1.0), (2, 9.0), (3, 3.0)}
    store.replace("edge", spark.createDataFrame([("CALLS", 1, 2), ("TESTS", 1, 2)], "rel string, src long, dst long"), "rel")
    store.drop_relation("TESTS")
    assert [r.rel for r in store.read("edge").collect()] == ["CALLS"]
    store.drop_relation("CALLS")
    assert store.read("edge").count() == 0


def test_scans_and_ignores(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in (("src/a.py", "x = 1\n"), ("src/b.bin", "?"), ("node_modules/c.js", "y"), ("package.json", "{}"), ("src/big.py", "z" * 1_600_000)):
        (tmp_path / name).write_text(body)
    paths = spark.createDataFrame([("package.json",), ("src/a.py",)], "path string")
    found = [r.ecosystem for r in walk.ecosystems(paths).collect()]
    assert found == ["node"]
    ignore = walk.ignore_list(found, "# mine\n\nsrc/gen/\n*.log\n")
    assert ignore[0] == ".git/" and "node_modules/" in ignore and ignore[-1] == "src/gen/" and len(ignore) == len(set(ignore))
    now = walk.stats(spark, str(tmp_path), ignore)
    assert {r.path for r in now.collect()} == {"src/a.py", "package.json"}
    known = spark.createDataFrame([("src/a.py",), ("old/x.py",), ("old/y.py",), ("lost.py",)], "path string")
    events = spark.createDataFrame([("src/a.py",), ("old/",), ("never.py",)], "path string")
    assert {tuple(r) for r in walk.classify_events(events, now, known).collect()} == {("src/a.py", "present"), ("old/x.py", "gone"), ("old/y.py", "gone")}
    gone = spark.createDataFrame([("src/z.py", None), ("src/z.unknown", None), ("src/big.py", 2_000_000)], "path string, size long")
    assert [r.path for r in walk.relevant(gone, ignore).collect()] == ["src/z.py"]


def test_link_registry(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    old = spark.createDataFrame([("u", "t", "f", at(1)), ("v", None, None, None)], links.FIELDS)
    new = spark.createDataFrame([("u", None, "g", at(9)), ("u", "x", "h", at(5)), ("w", "n", None, at(2))], links.FIELDS)
    got = {r.url: (r.title, r.saved) for r in links.upsert(old, new).collect()}
    assert got == {"u": ("t", "g"), "v": (None, None), "w": ("n", None)}
    assert {r.url for r in links.stale(links.upsert(old, new), F.lit(at(10)), 3.0).collect()} == {"v", "w"}
    assert links.remove(old, spark.createDataFrame([("u",)], "url string")).count() == 1


def test_payload_and_redaction(spark):
    symbols = spark.createDataFrame([(1, "a", "f.py", "Function", False), (2, "b", "g.py", "Class", True)], "id long, name string, file string, label string, is_test boolean")
    ranks = spark.createDataFrame([(1, 0.5)], "id long, pagerank double")
    members = spark.createDataFrame([(1, 7)], "id long, community long")
    edges = spark.createDataFrame([(1, 2, None), (2, 1, 0.4)], "src long, dst long, confidence double")
    out = views.node_payload(spark.createDataFrame([(1, 0), (2, 1), (2, 2)], "id long, depth int"), symbols, ranks, members, edges)
    assert {(r.id, r.depth, r.community, r.max_confidence) for r in out.collect()} == {(1, 0, 7, 1.0), (2, 1, None, 1.0)}
    files = spark.createDataFrame([("secret/a", "x"), ("b", "y"), ("secret/n", None)], "path string, text string")
    assert [r.t for r in files.select(walk.redacted(F.col("text"), F.col("path"), ["secret/"]).alias("t")).collect()] == ["[redacted by .cursorignore]", "y", None]
    assert walk.file_content(files, "../b").count() == 0
    assert geometry.GRID_BITS >= layout.STORE_ZOOM
