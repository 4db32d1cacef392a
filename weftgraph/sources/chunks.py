"""Chunks of bodies and of plain text, with exact line numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftgraph.functions.text import terms

#: Sizes in characters (bodies), and for text.
BODY_MIN, BODY_TARGET, BODY_OVERLAP, BODY_MAX = 1500, 700, 80, 1400
TEXT_TARGET, TEXT_MAX, TEXT_LINES = 1200, 2000, 60
CHUNK_CAP = 6000
#: Lines at which a body is best cut, by language.
SCOPES = {"python": r"^\s*(?:async\s+def|def|class|if|for|while|with|try|@)\b", "default": r"^\s*(?:(?:export|public|private|protected|static|async)\s+)*(?:function|class|func|fn|def|interface|struct|enum|impl|if|for|while|switch)\b"}


def body_chunks(body: str, language: str = "default", first_line: int = 1) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of a body's parts; one under the least size is one part.

    Parts end before a scope's line once they reach the target, and at the
    maximum in any case; each repeats the last characters of the one before it,
    by whole lines.  A line over CHUNK_CAP characters is parted within, so no text is lost.
    """
    lines = body.split("\n")
    if len(body) < BODY_MIN:
        return [(first_line, first_line + len(lines) - 1, body)] if body.strip() else []
    scope = re.compile(SCOPES.get(language, SCOPES["default"]))
    out, start, size = [], 0, 0
    for n, line in enumerate(lines):
        grows = size + len(line) + 1
        if n > start and ((size >= BODY_TARGET and scope.match(line)) or grows > BODY_MAX):
            out.append((start, n - 1))
            back, kept = n, 0
            while back > start + 1 and kept + len(lines[back - 1]) + 1 <= BODY_OVERLAP:
                back -= 1
                kept += len(lines[back]) + 1
            start, size = back, kept
        size += len(line) + 1
    out.append((start, len(lines) - 1))
    return [(first_line + a, first_line + b, part[k : k + CHUNK_CAP]) for a, b in out for part in ["\n".join(lines[a : b + 1])] for k in range(0, max(1, len(part)), CHUNK_CAP)]


def text_chunks(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text): whole paragraphs up to the target size; longer paragraphs by lines, longer lines by characters."""
    lines = text.split("\n")
    paragraphs: list[tuple[int, int]] = []
    start = None
    for n, line in enumerate([*lines, ""]):
        if line.strip() and start is None:
            start = n
        elif not line.strip() and start is not None:
            paragraphs.append((start, n - 1))
            start = None
    pieces: list[tuple[int, int, str]] = []
    for a, b in paragraphs:
        at = a
        while at <= b:
            end, size = at, len(lines[at])
            while end < b and size + 1 + len(lines[end + 1]) <= TEXT_MAX and end - at + 2 <= TEXT_LINES:
                end += 1
                size += 1 + len(lines[end])
            part = "\n".join(lines[at : end + 1])
            pieces += [(at, end, part[k : k + TEXT_MAX]) for k in range(0, len(part), TEXT_MAX)]
            at = end + 1
    out: list[tuple[int, int, str]] = []
    for a, b, part in pieces:
        if out and len(out[-1][2]) + 2 + len(part) <= TEXT_TARGET and b - out[-1][0] + 1 <= TEXT_LINES:
            first = out[-1][0]
            out[-1] = (first, b, "\n".join(lines[first : b + 1]))
        else:
            out.append((a, b, part))
    return [(a + 1, b + 1, part) for a, b, part in out]


def split(rows: DataFrame, key: str, text: str, *, bodies: bool = False, language: str | None = None, line: str | None = None) -> DataFrame:
    """(key, idx, line_start, line_end, body) of every row's chunks."""
    kind = rows.schema[key].dataType.simpleString()
    cols = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(language) if language else F.lit("default")).alias("language"), (F.col(line) if line else F.lit(1)).cast("int").alias("line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, lang, n in zip(pdf["key"], pdf["text"], pdf["language"], pdf["line"]):
                parts = body_chunks(t, lang, int(n)) if bodies else text_chunks(t)
                out += [(k, i, a, b, x) for i, (a, b, x) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["key", "idx", "line_start", "line_end", "body"])

    return cols.mapInPandas(run, f"key {kind}, idx int, line_start int, line_end int, body string").withColumnRenamed("key", key)


def of_graph(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(parent, idx, line_start, line_end, body, terms): chunks of long symbols, and of files that are text or have no symbols."""
    long = symbols.where(F.length("body") >= BODY_MIN)
    own = split(long, "id", "body", bodies=True, line="line_start").withColumnRenamed("id", "parent")
    bare = files.join(symbols.select(F.col("file").alias("path")).distinct(), "path", "left_anti").select(F.xxhash64(F.lit("File"), "path").alias("parent"), "text")
    return own.unionByName(split(bare, "parent", "text")).withColumn("terms", terms(F.col("body")))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """(path, cell, cell_type, source, line_start): cells of .ipynb files (path, text), at their lines in the joined text."""
    from pyspark.sql import Window

    shape = "cells array<struct<cell_type:string,source:string>>"
    flat = "cells array<struct<cell_type:string,source:array<string>>>"
    lists = F.transform(F.from_json("text", flat)["cells"], lambda c: F.struct(c["cell_type"].alias("cell_type"), F.array_join(c["source"], "").alias("source")))
    plain = F.from_json("text", shape)["cells"]
    cells = F.zip_with(lists, plain, lambda a, b: F.struct(b["cell_type"].alias("cell_type"), F.coalesce(F.nullif(a["source"], F.lit("")), F.when(~F.startswith(b["source"], F.lit("[")), b["source"]), F.lit("")).alias("source")))
    rows = notebooks.select("path", F.posexplode(cells).alias("cell", "c")).select("path", "cell", "c.cell_type", "c.source")
    lines = F.length("source") - F.length(F.replace("source", F.lit("\n"), F.lit(""))) + 1
    before = F.sum(lines).over(Window.partitionBy("path").orderBy("cell")) - lines
    return rows.withColumn("line_start", (before + 1).cast("int"))
