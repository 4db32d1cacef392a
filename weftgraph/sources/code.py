"""Source files to entities, raw edges and chunks.

Python is parsed by its own grammar (ast); other languages by a table of line
patterns for definitions, calls, construction, inheritance and imports.  A file
whose language has no patterns, or does not parse, gives its text chunks alone.
Each file is a row, so a pass over any number of files is one Arrow-batched map.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BODY = 8000
#: Characters of a Python file that are parsed at a time at the least, and rows that are held as objects.
PIECE, HELD = 1 << 16, 4096
ENTITIES = "path string, kind string, name string, qname string, line_start int, line_end int, signature string, doc string, body string, is_test boolean, error string"
RAW = "path string, rel string, src string, name string, line int, recv string, attr boolean, module string, alias string"

_NAME = r"[A-Za-z_$][\w$]*"
#: Definition, construction, inheritance and import patterns of the other languages, by family.
_C_LIKE = {"function": rf"^\s*(?:[\w:<>,*&\[\]~]+\s+)+\*?({_NAME})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:throws[\w\s,.]+)?\{{", "class": rf"^\s*(?:[\w]+\s+)*(?:class|struct|enum|record)\s+({_NAME})", "interface": rf"^\s*(?:\w+\s+)*interface\s+({_NAME})", "new": rf"\bnew\s+({_NAME})", "inherits": rf"\b(?:class|interface)\s+{_NAME}[^{{]*?(?:extends|implements|:)\s*(?:public\s+)?({_NAME})", "import": r"^\s*(?:import|using|#\s*include)\s+(?:static\s+)?[<\"]?([\w./*]+)"}
PATTERNS: dict[str, dict[str, str]] = {
    "javascript": {
        "function": rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_NAME})|^\s*(?:export\s+)?(?:const|let|var)\s+({_NAME})\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|{_NAME}\s*=>)",
        "method": rf"^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)({_NAME})\s*\([^)]*\)\s*(?::[^{{]+)?\{{",
        "class": rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_NAME})",
        "interface": rf"^\s*(?:export\s+)?interface\s+({_NAME})",
        "new": rf"\bnew\s+({_NAME})",
        "inherits": rf"\bclass\s+{_NAME}\s+extends\s+({_NAME})",
        "import": r"""^\s*(?:import|export)\b.*?from\s*['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)""",
    },
    "java": _C_LIKE,
    "go": {"function": rf"^func\s+({_NAME})\s*\(", "method": rf"^func\s+\([^)]*\)\s*({_NAME})\s*\(", "class": rf"^type\s+({_NAME})\s+(?:struct|interface)", "import": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$'},
    "rust": {"function": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+({_NAME})", "class": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+({_NAME})", "interface": rf"^\s*(?:pub\s+)?trait\s+({_NAME})"},
    "c": {"function": rf"^(?:[\w*]+\s+)+\*?({_NAME})\s*\([^;]*\)\s*\{{"},
    "ruby": {"method": r"^\s*def\s+(?:self\.)?([\w?!]+)", "class": r"^\s*(?:class|module)\s+([A-Z]\w*)"},
    "php": {"function": r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)", "class": r"^\s*(?:abstract\s+|final\s+)?(?:class|trait|interface)\s+(\w+)"},
    "bash": {"function": r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{?"},
    "lua": {"function": r"^\s*(?:local\s+)?function\s+([\w.:]+)", "import": r"require\s*\(?\s*['\"]([^'\"]+)"},
    "kotlin": {"function": rf"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?({_NAME})", "class": rf"^\s*(?:\w+\s+)*(?:class|object|interface)\s+({_NAME})", "import": r"^import\s+([\w.]+)"},
    "scala": {"function": rf"^\s*(?:\w+\s+)*def\s+({_NAME})", "class": rf"^\s*(?:\w+\s+)*(?:class|object)\s+({_NAME})", "interface": rf"^\s*(?:\w+\s+)*trait\s+({_NAME})", "import": r"^import\s+([\w.]+)"},
    "swift": {"function": rf"^\s*(?:\w+\s+)*func\s+({_NAME})", "class": rf"^\s*(?:\w+\s+)*(?:class|struct|enum)\s+({_NAME})", "interface": rf"^\s*(?:\w+\s+)*protocol\s+({_NAME})", "import": r"^import\s+([\w.]+)"},
    "elixir": {"function": r"^\s*defp?\s+([\w?!]+)", "class": r"^\s*defmodule\s+([\w.]+)"},
    "perl": {"function": r"^\s*sub\s+(\w+)", "class": r"^\s*package\s+([\w:]+)", "import": r"^\s*use\s+([\w:]+)"},
    "julia": {"function": r"^\s*function\s+([\w.!]+)", "class": r"^\s*(?:mutable\s+)?struct\s+(\w+)", "import": r"^\s*(?:using|import)\s+([\w.]+)"},
    "haskell": {"function": r"^([a-z][\w']*)\s*::", "class": r"^(?:data|newtype|class)\s+(?:.*=>\s*)?([A-Z]\w*)", "import": r"^import\s+(?:qualified\s+)?([\w.]+)"},
    "powershell": {"function": r"(?i)^\s*function\s+([\w-]+)", "class": r"(?i)^\s*class\s+(\w+)"},
    "sql": {"function": r"(?i)create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)", "class": r"(?i)create\s+(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.]+)"},
    "markdown": {"section": r"^#{1,6}\s+(.+?)\s*#*$"},
    "css": {"class": r"^\s*([.#][\w-]+)[^{;]*\{", "variable": r"^\s*(--[\w-]+)\s*:"},
    "toml": {"class": r"^\s*\[+([\w.\"-]+)\]+", "variable": r"^([\w-]+)\s*="},
    "make": {"function": r"^([\w.-]+)\s*:(?!=)", "variable": r"^([\w-]+)\s*[:?+]?="},
    "hcl": {"class": r'^\s*(?:resource|module|data|variable|output)\s+"([^"]+)"'},
    "zig": {"function": rf"^\s*(?:pub\s+)?fn\s+({_NAME})", "class": rf"^\s*(?:pub\s+)?const\s+({_NAME})\s*=\s*(?:extern\s+)?(?:struct|enum|union)"},
    "nix": {"variable": r"^\s*([\w-]+)\s*=\s*[^=]"},
    "fortran": {"function": r"(?i)^\s*(?:recursive\s+)?(?:subroutine|function)\s+(\w+)", "class": r"(?i)^\s*(?:module|program)\s+(\w+)", "import": r"(?i)^\s*use\s+(\w+)"},
    "verilog": {"class": r"^\s*(?:module|interface|package)\s+(\w+)", "function": r"^\s*(?:function|task)\s+(?:automatic\s+)?(?:\w+\s+)?(\w+)"},
    "vhdl": {"class": r"(?i)^\s*(?:entity|package)\s+(\w+)\s+is", "function": r"(?i)^\s*(?:function|procedure)\s+(\w+)", "import": r"(?i)^\s*use\s+([\w.]+)"},
    "dart": {"class": rf"^\s*(?:abstract\s+)?(?:class|enum|mixin)\s+({_NAME})", "function": rf"^\s*(?:[\w<>?]+\s+)({_NAME})\s*\([^;]*\)\s*(?:async\s*)?\{{", "inherits": rf"class\s+{_NAME}\s+extends\s+({_NAME})", "import": r"^import\s+'([^']+)'"},
    "groovy": _C_LIKE,
    "ocaml": {"function": r"^\s*let\s+(?:rec\s+)?(\w+)", "class": r"^\s*(?:type|module)\s+(\w+)", "import": r"^open\s+([\w.]+)"},
}
PATTERNS |= {"typescript": PATTERNS["javascript"], "svelte": PATTERNS["javascript"], "cpp": _C_LIKE, "c_sharp": _C_LIKE, "objc": PATTERNS["c"], "ocaml_interface": PATTERNS["ocaml"]}
_CALL = re.compile(rf"(?:({_NAME}(?:\.{_NAME})*)\.)?({_NAME})\s*\(")
_NOT_CALLS = {"if", "for", "while", "switch", "return", "catch", "function", "sizeof", "new", "class", "def", "fn", "func", "elif", "match", "await", "super", "and", "or", "not", "in", "print"}


def is_test(name: str, path: str) -> bool:
    return name.startswith("test_") or bool(re.match(r"test[A-Z]", name)) or any(x in path for x in ("/test", "/tests/", "_test."))


def _entity(path, kind, name, qname, a, b, signature, doc, lines, error=None, base=0):
    return (path, kind, name, qname, a + base, b + base, signature, doc, "\n".join(lines[a - 1 : b])[:BODY], is_test(name, path), error)


#: A line that a statement of the module may begin at, and that continues none.
_START = re.compile(r"^(?!(?:else|elif|except|finally)\b)[A-Za-z_@]", re.M)


def _next_start(source: str, at: int) -> int:
    while m := _START.search(source, at):
        if source[source.rfind("\n", 0, m.start() - 1) + 1 : m.start()][:1] != "@":
            return m.start()
        at = m.end()
    return len(source)


def _ends(source: str) -> str:
    """Line ends that the parser counts, as ends that split lines here too."""
    return re.sub(r"\r(?!\n)", "\n", source)


def python_pieces(source: str) -> Iterator[tuple[ast.Module, str, int]]:
    """(tree, text, lines before it) of a file, some statements at a time: a tree is a hundred times its text.

    What parses by itself and is followed by no else, elif, except or finally is
    whole statements; what does not is taken together with what follows.  If the
    rest never parses, a SyntaxError tells that the file has to be parsed whole.
    """
    source = _ends(source)
    at = line = 0
    while at < len(source):
        need = PIECE
        while True:
            end = _next_start(source, at + need)
            text = source[at:end]
            try:
                tree = ast.parse(text)
                break
            except (SyntaxError, ValueError):
                if end == len(source):
                    raise
                need = 2 * len(text)
        yield tree, text, line
        at, line = end, line + text.count("\n")


def whole(source: str) -> Iterator[tuple[ast.Module, str, int]]:
    """As python_pieces, in one piece; raises the error of the file."""
    source = _ends(source)
    yield ast.parse(source), source, 0


def parse_python(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Functions, classes, module variables; calls, inheritance, decorators and imports.

    Relative imports are not recorded and construction counts as a call, as the
    data model asks.
    """
    try:
        parts = [_piece(path, *p) for p in python_pieces(source)]
    except (SyntaxError, ValueError):
        parts = [_piece(path, *p) for p in whole(source)]
    return [e for part in parts for e in part[0]], [r for part in parts for r in part[1]]


def _piece(path: str, tree: ast.Module, source: str, before: int) -> tuple[list[tuple], list[tuple]]:
    lines = source.split("\n")
    entities: list[tuple] = []
    raw: list[tuple] = []

    def dotted(node) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            head = dotted(node.value)
            return f"{head}.{node.attr}" if head else ""
        return ""

    def visit(node, scope: list[str], owner: str):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                inner = [*scope, child.name]
                qname = "::".join([path, *inner])
                first = min([child.lineno, *(x.lineno for x in child.decorator_list)]) + before
                signature = " ".join(" ".join(lines[child.lineno - 1 : child.body[0].lineno - 1] or [lines[child.lineno - 1]]).split())[:240]
                entities.append(_entity(path, "class" if cls else "function", child.name, qname, child.lineno, child.end_lineno, signature, ast.get_docstring(child), lines, base=before))
                for dec in child.decorator_list:
                    name = dotted(dec.func if isinstance(dec, ast.Call) else dec)
                    if name:
                        raw.append((path, "DECORATED_BY", qname, name.rsplit(".", 1)[-1], first, name.rpartition(".")[0] or None, "." in name, None, None))
                if cls:
                    for base in child.bases:
                        name = dotted(base)
                        if name:
                            raw.append((path, "INHERITS", qname, name.rsplit(".", 1)[-1], child.lineno + before, None, False, None, None))
                visit(child, inner, qname)
                continue
            if isinstance(child, ast.Import):
                for a in child.names:
                    raw.append((path, "IMPORTS", owner, a.name, child.lineno + before, None, False, a.name, a.asname))
            elif isinstance(child, ast.ImportFrom) and not child.level:
                for a in child.names:
                    raw.append((path, "IMPORTS_SYMBOL", owner, a.name, child.lineno + before, None, False, child.module, a.asname))
            elif isinstance(child, ast.Assign) and not scope:
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        entities.append(_entity(path, "variable", t.id, f"{path}::{t.id}", child.lineno, child.end_lineno, None, None, lines, base=before))
            elif isinstance(child, ast.Call):
                name = dotted(child.func)
                if name or isinstance(child.func, ast.Attribute):
                    tail = name.rsplit(".", 1)[-1] if name else child.func.attr
                    raw.append((path, "CALLS", owner, tail, child.lineno + before, name.rpartition(".")[0][:80] or None, isinstance(child.func, ast.Attribute), None, None))
            visit(child, scope, owner)

    visit(tree, [], path)
    return entities, raw


def parse_lines(path: str, language: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Entities and raw edges by line patterns; a block ends where its braces, or its indentation, do."""
    rules = {k: re.compile(v) for k, v in PATTERNS[language].items()}
    lines = source.split("\n")
    found: list[list] = []
    for n, line in enumerate(lines, 1):
        for kind in ("class", "interface", "function", "method", "section", "variable"):
            m = rules[kind].search(line) if kind in rules else None
            name = next((g for g in m.groups() if g), None) if m else None
            if name and name not in _NOT_CALLS and not any(f[2] == n for f in found[-1:]):
                found.append([kind, name, n, _block_end(lines, n)])
                break
    entities, raw = [], []
    spans: list[tuple[str, str, int, int]] = []
    for kind, name, a, b in found:
        outer = [s for s in spans if s[0] in ("class", "interface") and s[2] < a and b <= s[3]]
        qname = f"{outer[-1][1] if outer else path}::{name}"
        spans.append((kind, qname, a, b))
        entities.append(_entity(path, "class" if kind == "interface" else kind, name, qname, a, b, " ".join(lines[a - 1].split())[:240], None, lines))
    for n, line in enumerate(lines, 1):
        around = [s for s in spans if s[0] in ("function", "method") and s[2] <= n <= s[3]]
        owner = min(around, key=lambda s: s[3] - s[2])[1] if around else path
        built = set()
        for rel, rule in (("INSTANTIATES", "new"), ("INHERITS", "inherits"), ("IMPORTS", "import")):
            for m in rules[rule].finditer(line) if rule in rules else ():
                name = next((g for g in m.groups() if g), None)
                if name:
                    built.add(name)
                    src = next((s[1] for s in spans if s[2] == n), owner) if rel == "INHERITS" else owner
                    raw.append((path, rel, src, name, n, None, False, name if rel == "IMPORTS" else None, None))
        if language not in ("markdown", "css", "toml"):
            starts = {s[1].rsplit("::", 1)[-1] for s in spans if s[2] == n}
            for m in _CALL.finditer(line):
                if m[2] not in _NOT_CALLS and m[2] not in built and m[2] not in starts:
                    raw.append((path, "CALLS", owner, m[2], n, (m[1] or "")[:80] or None, bool(m[1]), None, None))
    return entities, raw


def _block_end(lines: list[str], start: int) -> int:
    text = lines[start - 1]
    if "{" in text or (start < len(lines) and lines[start].strip().startswith("{")):
        depth = 0
        for n in range(start, len(lines) + 1):
            depth += lines[n - 1].count("{") - lines[n - 1].count("}")
            if depth <= 0 and "}" in lines[n - 1]:
                return n
        return len(lines)
    indent = len(text) - len(text.lstrip())
    end = start
    for n in range(start + 1, len(lines) + 1):
        s = lines[n - 1]
        if s.strip() and len(s) - len(s.lstrip()) <= indent:
            return n if re.match(r"\s*end\b", s) else end
        end = n if s.strip() else end
    return end


def parse(path: str, kind: str, source: str) -> tuple[list[tuple], list[tuple]]:
    try:
        if kind == "python":
            return parse_python(path, source)
        if kind in PATTERNS:
            return parse_lines(path, kind, source)
        return [], []
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "error", None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")], []


def by_pieces(files: DataFrame, schema: str, python, other, finish=None) -> DataFrame:
    """Rows of schema of files (path, kind, text): python(path, tree, text, lines before it) of a Python file's pieces, other(path, kind, text) of the rest.

    Texts are taken one at a time, and a file's rows wait in Arrow until it is
    known that all of it parses; a Python file that does not is left to other.
    finish is given the batches of a Python file, to return them complete.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def packed(parts: Iterator[list[tuple]]) -> list[pa.RecordBatch]:
        out, rows = [], []
        for more in parts:
            rows += more
            if len(rows) >= HELD:
                out.append(_batch(rows, arrow))
                rows = []
        return [*out, _batch(rows, arrow)] if rows else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, kind, text = (batch.column(c)[k].as_py() for c in range(3))
                text = text or ""
                try:
                    out = packed(python(path, *p) for p in python_pieces(text)) if kind == "python" else None
                    out = finish(out) if out is not None and finish else out
                except (SyntaxError, ValueError, RecursionError):
                    out = None
                yield from packed(iter([other(path, kind, text)])) if out is None else out

    return files.select("path", "kind", "text").mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def entities(files: DataFrame) -> DataFrame:
    """Entities of files (path, kind, text); a file that fails gives one row with its error."""
    return by_pieces(files, ENTITIES, lambda *p: _piece(*p)[0], lambda *f: parse(*f)[0])


def raw_edges(files: DataFrame) -> DataFrame:
    """Unresolved edges of files (path, kind, text)."""
    return by_pieces(files, RAW, lambda *p: _piece(*p)[1], lambda *f: parse(*f)[1])
