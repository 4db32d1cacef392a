"""Change risk: five factors of a symbol, levels, and the whole of a change."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEVELS = [(75, "critical"), (50, "high"), (25, "medium"), (0, "low")]


def level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for least, name in LEVELS[1:-1]:
        out = out.when(score >= least, name)
    return out.otherwise(LEVELS[-1][1])


def factors(percentile: Column, callers: Column, routes: Column, entries: Column, tests: Column, lines: Column) -> dict[str, Column]:
    """Centrality 25, blast radius 25, entry points 20, test gap 20 (8 with one test), size 10."""
    return {
        "centrality": 25.0 * percentile,
        "blast": F.least(F.lit(25.0), 5.0 * F.log2(1.0 + callers)),
        "entry": F.least(F.lit(20.0), 7.0 * routes + 3.0 * entries),
        "test_gap": F.when(tests == 0, 20.0).when(tests == 1, 8.0).otherwise(0.0),
        "size": F.least(F.lit(10.0), lines / 5.0),
    }


def symbol_score(**parts: Column) -> Column:
    total = F.lit(0.0)
    for c in factors(**parts).values():
        total = total + c
    return F.least(F.lit(100.0), F.round(F.round(total, 6), 1))


def overall(score: str) -> Column:
    """Aggregate: the greatest score and a tenth of the others, 100 at most."""
    return F.least(F.lit(100.0), F.round(F.max(score) + 0.1 * (F.sum(score) - F.max(score)), 1))
