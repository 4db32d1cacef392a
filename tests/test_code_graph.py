"""A small repository of our own, parsed, resolved and queried end to end."""

import pytest
from pyspark.sql import functions as F

from weftgraph.plans.index import build
from weftgraph.sources import chunks, classify, code, frameworks, history, rules, scip

FILES = {
    "src/store.py": "class Base:\n    def save(self, row):\n        return None\n\n\nclass Store(Base):\n    def __init__(self):\n        self.rows = []\n\n    def save(self, row):\n        self._put(row)\n        return row\n\n    def _put(self, row):\n        self.rows = self.rows + [row]\n",
    "src/text.py": "import json\n\n\ndef tidy_name(name):\n    return name.strip()\n\n\ndef _check_value(v):\n    return bool(v)\n\n\ndef helper():\n    return json.dumps({})\n",
    "src/job.py": "from src.text import tidy_name\nfrom src.store import Store\n\n\ndef local_step(x):\n    return x\n\n\ndef run_job(store, name):\n    tidy_name(name)\n    store.save(name)\n    return local_step(name)\n",
    "src/other.py": "def caller_fn(v):\n    only_here(v)\n    check_value(v)\n    helper()\n\n\ndef helper():\n    return 2\n",
    "src/third.py": "def only_here(v):\n    return v\n\n\ndef lonely():\n    return helper()\n",
    "src/web.py": 'from fastapi import FastAPI\n\napp = FastAPI()\n\n\ndef doc():\n    """\n    @app.get("/fake")\n    """\n\n\n@app.get("/items/{item_id}")\ndef read_item(item_id):\n    return item_id\n\n\n@app.post("/items")\ndef create_item():\n    return None\n',
    "src/broken.py": "def (:\n",
    "tests/test_store.py": "from src.text import tidy_name\n\n\ndef test_tidy_name():\n    assert tidy_name(' a ') == 'a'\n",
    "web/app.ts": "import { x } from './lib'\nexport class Panel extends Widget {\n  draw(a) {\n    return new Pen(this.go(1));\n  }\n}\nexport function listUsers() { return x(); }\nrouter.get('/users', listUsers);\n",
    "docs/guide.txt": "First paragraph.\n\nSecond paragraph.\n",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, t) for p, t in FILES.items()]
    return spark.createDataFrame(rows, "path string, text string").withColumn("kind", classify.kind(F.col("path")))


@pytest.fixture(scope="module")
def graph(files):
    return build(files)


@pytest.fixture(scope="module")
def calls(graph):
    s = graph.symbol.select("id", "qname")
    e = graph.edge.where("rel IN ('CALLS', 'CALLS_CANDIDATE')").join(s.select(F.col("id").alias("src"), F.col("qname").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("qname").alias("b")), "dst")
    return {(r.rel, r.a.split("::", 1)[1], r.b): (r.method, r.confidence) for r in e.collect()}


def test_entities(graph):
    names = {r.qname for r in graph.symbol.select("qname").collect()}
    assert {"src/store.py::Store::save", "src/store.py::Base", "web/app.ts::Panel::draw", "src/web.py::read_item"} <= names
    assert [r.path for r in graph.errors.collect()] == ["src/broken.py"]


def test_cascade(calls):
    assert calls["CALLS", "run_job", "src/text.py::tidy_name"] == ("import_map", 0.95)
    assert calls["CALLS", "Store::save", "src/store.py::Store::_put"] == ("same_module", 0.90)
    assert calls["CALLS", "run_job", "src/job.py::local_step"] == ("same_module", 0.90)
    assert calls["CALLS", "caller_fn", "src/third.py::only_here"] == ("unique_global", 0.75)
    assert calls["CALLS", "caller_fn", "src/text.py::_check_value"][0] in ("fuzzy", "fuzzy_ranked")
    # two files define helper and lonely imports neither
    both = [v for k, v in calls.items() if k[0] == "CALLS_CANDIDATE" and k[1] == "lonely"]
    assert len(both) == 2 and all(c < 0.5 for _, c in both)
    assert not any(k[0] == "CALLS" and k[1] == "lonely" for k in calls)


def test_derived_edges(graph):
    s = {r.id: r.qname for r in graph.symbol.select("id", "qname").collect()}
    rel = lambda r: {(s.get(e.src), s.get(e.dst)) for e in graph.edge.where(F.col("rel") == r).collect()}
    assert ("src/store.py::Store", "src/store.py::Base") in rel("INHERITS")
    assert ("src/store.py::Store::save", "src/store.py::Base::save") in rel("OVERRIDES")
    assert ("tests/test_store.py::test_tidy_name", "src/text.py::tidy_name") in rel("TESTS")
    assert ("src/store.py::Store", "src/store.py::Store::save") in rel("CONTAINS")


def test_routes(graph):
    got = {(r.name, (r.handler or "").split("::")[-1], r.framework) for r in graph.route.collect()}
    assert got == {("GET /items/{item_id}", "read_item", "fastapi"), ("POST /items", "create_item", "fastapi"), ("GET /users", "listUsers", "express")}


PYTHON_ROUTES = '''
import aiohttp.web as web
from starlette.routing import Route

@app.route("/hello", methods=["GET", "post"])
async def hello(request):
    """@app.get("/fake")"""

# @app.get("/comment")
@bp.websocket("/live")
def live(ws): ...

@server.tool()
def add_numbers(a, b): ...

@server.resource("res://greeting")
def greeting(): ...

@server.prompt
def review(code): ...

app.add_url_rule("/rule", view_func=views.rule, methods=("PUT",))
app.add_api_route("/api", endpoint, methods=["PATCH"])
app.router.add_get(
    "/ping",
    handle_ping,
)
app.router.add_route("post", "/echo", handle_echo)
app.add_routes([web.post("/w", handle_w), web.view("/v", Viewer)])
routes = [Route("/star", endpoint=star, methods=["GET"])]
cache.get("/not/a/route")
'''
SCRIPT_ROUTES = """
const books = express.Router();
// app.get('/comment', no)
app.get('/users', auth, listUsers);
app.post("/users",
  auth,
  async (req, res) => { res.send(other(1, 2)); });
books.delete(`/b/:id`, handlers.remove)
app.route('/both').get(a.show).post(b.save)
cache.get('/users', x);
const text = "app.get('/inside', no)";
server.registerTool('sum', { a: 1 }, sumUp);
"""


def test_registrations_of_all_shapes():
    got = {(r[0], r[3], r[7]) for r in frameworks.python_routes("a.py", PYTHON_ROUTES)}
    assert got == {
        ("route", "GET,POST /hello", "hello"), ("route", "WEBSOCKET /live", "live"), ("tool", "add_numbers", "add_numbers"), ("resource", "res://greeting", "greeting"),
        ("prompt", "review", "review"), ("route", "PUT /rule", "rule"), ("route", "PATCH /api", "endpoint"), ("route", "GET /ping", "handle_ping"), ("route", "POST /echo", "handle_echo"),
        ("route", "POST /w", "handle_w"), ("route", "* /v", "Viewer"), ("route", "GET /star", "star"),
    }
    got = {(r[0], r[3], r[7]) for r in frameworks.javascript_routes("a.js", SCRIPT_ROUTES)}
    assert got == {("route", "GET /users", "listUsers"), ("route", "POST /users", None), ("route", "DELETE /b/:id", "remove"), ("route", "GET /both", "show"), ("route", "POST /both", "save"), ("tool", "sum", "sumUp")}
    assert frameworks.python_routes("a.py", "def (:") == [] and frameworks.javascript_routes("a.js", "app.get('/x'") == []


def test_ranks_sum_to_one(graph):
    assert abs(graph.symbol.agg(F.sum("pagerank")).head()[0] - 1) < 1e-9


def test_detect_changes(graph, spark):
    from weftgraph.operators.changes import detect_changes

    text = "diff --git a/src/text.py b/src/text.py\n--- a/src/text.py\n+++ b/src/text.py\n@@ -5 +5 @@\n-    return name\n+    return name.strip()\n"
    out = detect_changes(history.diff_ranges(spark, text), graph.symbol, graph.edge)
    assert [r.qname for r in out["changed"].collect()] == ["src/text.py::tidy_name"]
    assert {r.name for r in out["callers"].collect()} == {"run_job", "test_tidy_name"}
    assert {r.name for r in out["tests"].collect()} == {"test_tidy_name"}
    assert out["overall"].head().level in ("low", "medium", "high", "critical")


def test_rename_plan(graph, files):
    from weftgraph.operators.changes import rename_plan

    got = {(r.file, r.line): r.confidence for r in rename_plan(files, graph.symbol, graph.edge, "tidy_name").collect()}
    assert got["src/text.py", 4] == 1.0 and got["src/job.py", 10] == 1.0 and got["src/job.py", 1] == 0.6


def test_reports(graph):
    from weftgraph.operators import render

    ranks = graph.symbol.select("id", "pagerank")
    text = render.repo_map(graph.symbol, ranks, 200)
    assert render.tokens(text) <= 200 and "src/store.py:" in text
    assert "run_job" in render.context(graph.symbol, graph.edge, ranks, "tidy_name")
    assert graph.symbol.sparkSession is not None
    pages = {r.module: r.page for r in render.wiki_pages(graph.symbol, graph.edge).collect()}
    assert pages["tests"].endswith("Used by: none") and "Uses: src" in pages["tests"]


def test_layout_is_deterministic_and_apart(graph):
    from weftgraph.operators import layout

    clusters = graph.symbol.select("file", F.split("file", "/")[0].alias("cluster")).distinct()
    weights = graph.edge.sparkSession.createDataFrame([("src/job.py", "src/text.py", 1.0)], "a string, b string, weight double")
    first, second = ({r.id: (r.x, r.y) for r in layout.place(graph.symbol, clusters, weights).collect()} for _ in range(2))
    assert first == second and len(set(first.values())) == len(first)
    places = layout.place(graph.symbol, clusters, weights)
    coded = layout.with_codes(places, *layout.world_box(places)).persist()
    parts = [layout.tile(coded, graph.edge, 1, x, y)[0].count() for x in (0, 1) for y in (0, 1)]
    assert sum(parts) == len(first)


def test_read_only_sql(graph, spark):
    from weftgraph.plans.sql import NotReadOnly, read_only

    graph.views("g_")
    assert read_only(spark, "SELECT count(*) AS n FROM g_symbol").head().n == graph.symbol.count()
    for bad in ("DROP TABLE g_symbol", "CREATE TABLE t AS SELECT 1", "INSERT INTO g_symbol SELECT * FROM g_symbol", "SET spark.x = 1", "CACHE TABLE g_symbol", "ADD JAR x"):
        with pytest.raises(NotReadOnly):
            read_only(spark, bad)


def test_incremental_equals_full(spark, tmp_path):
    from weftgraph.streaming.feed import EVENTS, LiveTables

    live = LiveTables(spark, str(tmp_path / "live"))
    live.start()
    script = [[("a.py", "python", "def f():\n    return g()\n", 1), ("b.py", "python", "def g():\n    return 1\n", 1)], [("a.py", "python", "def f():\n    return 2\n", 2), ("c.txt", "text:text", "plain words", 2)], [("b.py", "python", None, 3), ("a.py", "python", "def f():\n    return 2\n", 3)]]
    now: dict = {}
    for batch in script:
        live.apply(spark.createDataFrame(batch, EVENTS))
        now.update({p: (k, t) for p, k, t, _ in batch})
    full = spark.createDataFrame([(p, k, t) for p, (k, t) in now.items() if t is not None], "path string, kind string, text string")
    for name, rows in live._rows(full).items():
        key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert key(live.read(name)) == key(rows)


def test_stream_follows_files(spark, tmp_path):
    from weftgraph.streaming.feed import LiveTables

    live = LiveTables(spark, str(tmp_path / "t"))
    live.start()
    (tmp_path / "in").mkdir()
    q = live.follow(str(tmp_path / "in"), str(tmp_path / "cp"), "100 milliseconds")
    (tmp_path / "in/1.json").write_text('{"path": "x.py", "kind": "python", "text": "def f(): pass", "at": 1}\n')
    q.processAllAvailable()
    q.stop()
    assert [r.name for r in live.read("entity").collect()] == ["f"]


def test_chunks_cover():
    text = "\n\n".join(f"paragraph {k} " + "word " * (k * 17 % 400) for k in range(30))
    parts = chunks.text_chunks(text)
    lines = text.split("\n")
    seen = {n for a, b, _ in parts for n in range(a, b + 1)}
    assert all(n in seen for n, line in enumerate(lines, 1) if line.strip())
    body = "\n".join(["def f():"] + [f"    x{k} = {k}" for k in range(200)])
    got = chunks.body_chunks(body, "python", 10)
    assert got[0][0] == 10 and got[-1][1] == 210 and all(len(t) <= 1500 for _, _, t in got)


def test_notebook(spark):
    nb = '{"cells": [{"cell_type": "code", "source": ["a = 1\\n", "b = 2"]}, {"cell_type": "markdown", "source": "# T"}]}'
    rows = chunks.notebook_cells(spark.createDataFrame([("n.ipynb", nb)], "path string, text string")).orderBy("cell").collect()
    assert [(r.cell_type, r.source, r.line_start) for r in rows] == [("code", "a = 1\nb = 2", 1), ("markdown", "# T", 3)]


def test_scip(spark):
    def ld(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    occ = lambda line, sym, roles: ld(2, ld(1, bytes([line, 0, 3])) + ld(2, sym) + bytes([3 << 3, roles]))
    doc = ld(1, b"a.py") + occ(0, b"pkg f().", 1) + occ(5, b"pkg f().", 0)
    df = scip.occurrences(spark.createDataFrame([(bytearray(ld(2, doc)),)], "content binary"))
    spans = spark.createDataFrame([(1, "a.py", 1, 3), (2, "a.py", 5, 8)], "id long, file string, line_start int, line_end int")
    assert [tuple(r) for r in scip.edges(df, spans).collect()] == [(2, 1, 6)]


def test_rules():
    loaded = rules.load({"a.mdc": "---\nglobs: src/**, *.md\nalwaysApply: false\n---\nbody", "AGENTS.md": "x", "b.mdc": "---\nglobs:\n  - '*.py'\n---\n"})
    assert [r["path"] for r in rules.rules_for(loaded, "src/a.py")] == ["AGENTS.md", "b.mdc", "a.mdc"]


def test_one_pattern_each():
    cases = {"go": ("func Run(x int) {\n}\n", "Run"), "rust": ("pub fn run() {\n}\n", "run"), "ruby": ("def run\nend\n", "run"), "java": ("public class A {\n  public int run(int x) {\n  }\n}\n", "run"), "c": ("int run(int x) {\n}\n", "run"), "markdown": ("# Title\n", "Title"), "lua": ("function run()\nend\n", "run"), "sql": ("create table t (a int)", "t"), "bash": ("run() {\n}\n", "run"), "kotlin": ("fun run() {\n}\n", "run"), "scala": ("def run(): Int = 1\n", "run"), "swift": ("func run() {\n}\n", "run"), "php": ("function run() {\n}\n", "run"), "elixir": ("def run do\nend\n", "run"), "perl": ("sub run {\n}\n", "run")}
    for language, (text, name) in cases.items():
        assert name in [e[2] for e in code.parse("x", language, text)[0]], language
