"""Exact references from SCIP indexes: the wire format read as rows, and edges from occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

DEFINITION = 1


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers and length-delimited parts."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < n:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire}")


def _packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(value)
            value = shift = 0
    return out


def occurrences_of(index: bytes) -> Iterator[tuple[str, int, str, int]]:
    """(path, line from 0, symbol, roles) of an index; local symbols are left out."""
    for number, doc in fields(index):
        if number != 2:
            continue
        path, found = "", []
        for n, v in fields(doc):
            if n == 1:
                path = v.decode()
            elif n == 2:
                line, symbol, roles = 0, "", 0
                for k, x in fields(v):
                    if k == 1:
                        line = (_packed(x) if isinstance(x, bytes) else [x])[0]
                    elif k == 2:
                        symbol = x.decode()
                    elif k == 3:
                        roles = x
                found.append((line, symbol, roles))
        yield from ((path, line, s, r) for line, s, r in found if s and not s.startswith("local "))


def occurrences(files: DataFrame) -> DataFrame:
    """(path, line, symbol, roles) of index files (content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(occurrences_of(bytes(content)), columns=["path", "line", "symbol", "roles"])

    return files.select("content").mapInPandas(run, "path string, line int, symbol string, roles int")


def edges(occ: DataFrame, spans: DataFrame) -> DataFrame:
    """(src, dst, line): from the function around a reference to the function that the symbol defines.

    A definition is matched to a function that starts on its line, else on the
    one before or after; spans: (id, file, line_start, line_end).
    """
    from weftgraph.operators.edges import enclosing

    defs = occ.where(F.col("roles").bitwiseAND(DEFINITION) != 0).select("path", "symbol", (F.col("line") + 1).alias("at"))
    near = defs.join(spans.select("id", F.col("file").alias("path"), "line_start"), "path").where("line_start IN (at, at - 1, at + 1)")
    rank = F.when(F.col("line_start") == F.col("at"), 0).when(F.col("line_start") == F.col("at") - 1, 1).otherwise(2)
    target = near.groupBy("symbol").agg(F.min(F.struct(rank.alias("r"), "id")).getField("id").alias("dst"))
    refs = occ.where(F.col("roles").bitwiseAND(DEFINITION) == 0).select(F.struct("path", "line", "symbol").alias("point"), F.col("path").alias("file"), (F.col("line") + 1).alias("line"))
    src = enclosing(refs, spans).select("point", F.col("id").alias("src"))
    pairs = src.join(target, src.point.symbol == target.symbol).where("src <> dst")
    return pairs.groupBy("src", "dst").agg((F.min("point.line") + 1).alias("line"))
