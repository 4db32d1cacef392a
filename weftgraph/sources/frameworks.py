"""Routes and tools that source files register with web and tool frameworks.

Python files are read as syntax trees, JavaScript and TypeScript files as
tokens, so what stands in comments or strings is no registration, and a call
may run over any number of lines.  Each framework's documented ways of
registering are told apart by the shape of the call:

* a decorator over a function (``@app.get("/x")``, ``@app.route(...)``, ``@server.tool()``);
* a call that takes a path and a handler (``add_url_rule``, ``add_api_route``,
  ``router.add_get``, ``web.post``, ``Route``), or a method before both
  (``router.add_route("GET", "/x", h)``);
* in JavaScript a call on an application or router object, also chained after
  ``route("/x")``; its handler is the last argument.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftgraph.sources.code import by_pieces, python_pieces, whole

#: HTTP methods as names of registering functions.
VERBS = ["get", "post", "put", "delete", "patch", "head", "options", "trace"]
#: What registers a tool, a resource or a prompt.
TOOLS = ["tool", "resource", "prompt"]
#: Frameworks by the package that a file imports.
FRAMEWORKS = ["fastapi", "flask", "aiohttp", "starlette", "django"]
FOUND = "kind string, method string, path string, name string, framework string, file string, line int, handler string, at int"


def _text(node) -> str | None:
    """The value of a string literal; an f-string keeps its fields in braces."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else "{" + ast.unparse(v.value) + "}" for v in node.values)
    return None


def _tail(node) -> str | None:
    """The last name of a plain or dotted reference; the function of a wrapping call such as View.as_view()."""
    if isinstance(node, ast.Call):
        inner = node.func.value if isinstance(node.func, ast.Attribute) else node.func
        return _tail(inner)
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


class _Call:
    """A call's positional and named arguments."""

    def __init__(self, node: ast.Call):
        self.args, self.named = node.args, {k.arg: k.value for k in node.keywords if k.arg}

    def string(self, at: int, *names: str) -> str | None:
        found = [_text(self.named[n]) for n in names if n in self.named]
        return found[0] if found else _text(self.args[at]) if at < len(self.args) else None

    def handler(self, at: int, *names: str) -> str | None:
        found = [_tail(self.named[n]) for n in names if n in self.named]
        return found[0] if found else _tail(self.args[at]) if at < len(self.args) else None

    def methods(self) -> str | None:
        node = self.named.get("methods")
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return ",".join(t.upper() for t in map(_text, node.elts) if t)
        return None


def _python_framework(tree: ast.AST) -> tuple[int, str] | None:
    """(depth, name) of the first framework that is imported, those of outer blocks first."""
    level, depth = [tree], 0
    while level:
        for node in level:
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            for name in names:
                if name.split(".")[0] in FRAMEWORKS:
                    return depth, name.split(".")[0]
        level, depth = [c for node in level for c in ast.iter_child_nodes(node)], depth + 1
    return None


def _decorated(dec) -> tuple[str, str, str] | None:
    """(kind, method, path) of a decorator, if it registers something."""
    call = _Call(dec) if isinstance(dec, ast.Call) else None
    ref = dec.func if isinstance(dec, ast.Call) else dec
    if not isinstance(ref, ast.Attribute):
        return None
    if ref.attr in TOOLS:
        return ref.attr, "", (call.string(0, "name", "uri") if call else None) or ""
    path = call.string(0, "path", "rule") if call else None
    if path is None:
        return None
    if ref.attr in VERBS:
        return "route", ref.attr.upper(), path
    if ref.attr in ("websocket", "websocket_route"):
        return "route", "WEBSOCKET", path
    if ref.attr in ("route", "api_route"):
        return "route", call.methods() or "GET", path
    if ref.attr == "view":
        return "route", "*", path
    return None


def _called(node: ast.Call) -> tuple[str, str, str | None] | None:
    """(method, path, handler) of a call that registers a route."""
    name, call = _tail(node.func) if not isinstance(node.func, ast.Call) else None, _Call(node)
    attribute = isinstance(node.func, ast.Attribute)
    owner = _tail(node.func.value) if attribute else None
    if attribute and name == "add_url_rule":
        return (call.methods() or "GET", p, call.handler(2, "view_func")) if (p := call.string(0, "rule")) else None
    if attribute and name in ("add_api_route", "add_route", "add_view", "add_api_websocket_route", "add_websocket_route") or owner == "web" and name in ("route", "view"):
        first, second = call.string(0, "path"), call.string(1)
        if name in ("add_route", "route") and first and second is not None:
            return first.upper(), second, call.handler(2, "handler")
        if not first:
            return None
        method = "WEBSOCKET" if "websocket" in name else "*" if name in ("add_view", "view") else call.methods() or "GET"
        return method, first, call.handler(1, "endpoint", "route", "handler")
    verb = name.removeprefix("add_") if name else ""
    if attribute and verb in VERBS and (name.startswith("add_") or owner == "web"):
        return (verb.upper(), p, call.handler(1, "handler")) if (p := call.string(0, "path")) else None
    if name in ("Route", "WebSocketRoute"):
        return ("WEBSOCKET" if name == "WebSocketRoute" else call.methods() or "GET", p, call.handler(1, "endpoint")) if (p := call.string(0, "path")) is not None else None
    return None


def python_routes(file: str, source: str) -> list[tuple]:
    """Rows of FOUND; at: the line that the handler's definition is at, or the registration's."""
    for pieces in (python_pieces, whole):
        try:
            parts = [(_python_framework(tree), _piece_routes(file, tree, base)) for tree, _, base in pieces(source)]
        except (SyntaxError, ValueError, RecursionError):
            continue
        framework = min((f for f, _ in parts if f), key=lambda f: f[0], default=(0, "python"))[1]
        return sorted((_filled(r, framework) for _, rows in parts for r in rows), key=lambda r: (r[6], r[3]))
    return []


def _filled(row: tuple, framework: str) -> tuple:
    return (*row[:4], framework, *row[5:])


def _piece_routes(file: str, tree: ast.AST, base: int) -> list[tuple]:
    """Rows of FOUND of some statements, without the framework, which the whole file tells."""
    framework, out = None, []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for dec in node.decorator_list:
                if got := _decorated(dec):
                    kind, method, path = got
                    name = f"{method} {path}" if kind == "route" else path or node.name
                    out.append((kind, method, path, name, framework, file, dec.lineno + base, node.name, node.lineno + base))
        elif isinstance(node, ast.Call) and (got := _called(node)):
            method, path, handler = got
            out.append(("route", method, path, f"{method} {path}", framework, file, node.lineno + base, handler, node.lineno + base))
    return out


#: One token of JavaScript: a comment, a string, a name, or any other character.
_TOKEN = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<other>\S)""", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _arguments(tokens: list[tuple[str, str, int]], at: int) -> tuple[list[list[tuple[str, str, int]]], int]:
    """The arguments of the call whose bracket is tokens[at], and the index after its end."""
    out: list[list] = [[]]
    depth = 0
    for k in range(at, len(tokens)):
        kind, value, _ = tokens[k]
        if kind == "other" and value in _PAIRS:
            depth += 1
            if depth == 1:
                continue
        elif kind == "other" and value in ")]}":
            depth -= 1
            if not depth:
                return [a for a in out if a], k + 1
        if depth == 1 and kind == "other" and value == ",":
            out.append([])
        else:
            out[-1].append(tokens[k])
    return [a for a in out if a], len(tokens)


def _plain(argument: list[tuple[str, str, int]]) -> str | None:
    """The last name of an argument that is a plain or dotted reference and nothing else."""
    names, dots = argument[::2], argument[1::2]
    plain = len(argument) % 2 and all(k == "name" for k, _, _ in names) and all(v == "." for _, v, _ in dots)
    return names[-1][1] if plain else None


def javascript_routes(file: str, source: str) -> list[tuple]:
    tokens = [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(source) if m.lastgroup != "comment"]
    #: Objects that routes are put on: what is made by express(), Router() and the like, and the usual names.
    holders = {"app", "router", "server", "api"}
    for k in range(len(tokens) - 3):
        if tokens[k][0] == "name" and tokens[k + 1][1] == "=" and tokens[k + 2][0] == "name":
            made = [t[1] for t in tokens[k + 2 : k + 6]]
            if made[0] in ("express", "Router", "fastify", "Fastify") or made[:3] == ["express", ".", "Router"]:
                holders.add(tokens[k][1])
    framework, out = "express", []
    line = lambda at: source.count("\n", 0, at) + 1
    k = 0
    while k + 3 < len(tokens):
        (kind, owner, at), dot, (vkind, verb, _), bracket = tokens[k : k + 4]
        if kind != "name" or dot[1] != "." or vkind != "name" or bracket[1] != "(":
            k += 1
            continue
        arguments, end = _arguments(tokens, k + 3)
        first = arguments[0] if arguments else []
        path = first[0][1][1:-1] if len(first) == 1 and first[0][0] == "string" else None
        low = verb.removeprefix("register").lower()
        if path is not None and owner in holders and (verb in VERBS or verb == "all") and path.startswith("/") and len(arguments) > 1:
            out.append(("route", verb.upper(), path, f"{verb.upper()} {path}", framework, file, line(at), _plain(arguments[-1]), line(at)))
        elif path is not None and owner in holders and verb == "route" and path.startswith("/"):
            # the methods of a route object are chained behind it
            while end + 2 < len(tokens) and tokens[end][1] == "." and tokens[end + 2][1] == "(" and (tokens[end + 1][1] in VERBS or tokens[end + 1][1] == "all"):
                method, where = tokens[end + 1][1].upper(), tokens[end + 1][2]
                chained, end = _arguments(tokens, end + 2)
                if chained:
                    out.append(("route", method, path, f"{method} {path}", framework, file, line(where), _plain(chained[-1]), line(where)))
        elif path and low in TOOLS and len(arguments) > 1:
            out.append((low, "", path, path, framework, file, line(at), _plain(arguments[-1]), line(at)))
        k += 1
    return sorted(out, key=lambda r: (r[6], r[3]))


def _with_framework(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Rows of a file's pieces with its framework, which is known when all are read: the first import of the outermost block, by the marks that pieces leave."""
    out, first = [], (1 << 30, "python")
    for batch in batches:
        marks = batch.filter(pc.equal(batch["kind"], "import"))
        first = min([first, *zip(marks["at"].to_pylist(), marks["framework"].to_pylist())], key=lambda x: x[0])
    at = FOUND.split(", ").index("framework string")
    for batch in batches:
        rows = batch.filter(pc.not_equal(batch["kind"], "import"))
        out.append(rows.set_column(at, rows.schema.field(at), pa.array([first[1]] * len(rows), pa.string())))
    return out


def registrations(files: DataFrame) -> DataFrame:
    """Rows of FOUND for files (path, kind, text); handler is a bare name, or null where it is inline."""

    def piece(path: str, tree: ast.AST, text: str, base: int) -> list[tuple]:
        first = _python_framework(tree)
        mark = [("import", None, None, None, first[1], path, None, None, first[0])] if first else []
        return mark + _piece_routes(path, tree, base)

    def other(path: str, kind: str, text: str) -> list[tuple]:
        return python_routes(path, text) if kind == "python" else javascript_routes(path, text)

    own = files.where("kind IN ('python', 'javascript', 'typescript', 'tsx')").select("path", "kind", "text")
    return by_pieces(own, FOUND, piece, other, _with_framework)


def detect(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, kind, name, method, path, framework, file, line, handler): routes and tools; handler is a qualified name, or null (inline, or defined elsewhere).

    Of several definitions of the handler's name in a file the one nearest to
    the registration counts, then the first.
    """
    found = registrations(files).withColumn("id", F.xxhash64(F.lit("Route"), "file", "line", "name")).dropDuplicates(["id"])
    defs = entities.where("kind IN ('function', 'method', 'class') AND error IS NULL").select(F.col("path").alias("file"), F.col("name").alias("handler"), "qname", "line_start")
    hit = found.join(defs, ["file", "handler"]).groupBy("id").agg(F.min(F.struct(F.abs(F.col("line_start") - F.col("at")), "line_start", "qname")).getField("qname").alias("qname"))
    return found.join(hit, "id", "left").select("id", "kind", "name", "method", "path", "framework", "file", "line", F.col("qname").alias("handler"))
