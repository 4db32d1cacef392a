"""Grid, tile and layout arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

GRID_BITS = 16
#: Spacing of a spiral, and the golden angle.
SPACING, GOLDEN = 10.0, math.pi * (3.0 - math.sqrt(5.0))


def quantise(value: Column, low: float, high: float) -> Column:
    """A coordinate on the grid of 65536 cells."""
    cell = F.floor((value - low) / (high - low) * (1 << GRID_BITS))
    return F.least(F.greatest(cell, F.lit(0)), F.lit((1 << GRID_BITS) - 1)).cast("long")


def spread(v: Column) -> Column:
    """Bits of a 16-bit number moved to the even places."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    return spread(x.cast("long")).bitwiseOR(F.shiftleft(spread(y.cast("long")), 1))


def tile_range(zoom: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    """[low, high) of the codes in a quadtree tile."""
    shift = (F.lit(2) * (F.lit(GRID_BITS) - zoom)).cast("int")
    code = morton(tx, ty)
    one = F.expr("shiftleft(1L, 0)")
    size = F.pow(F.lit(2.0), shift).cast("long") * one
    return code * size, (code + 1) * size


def spiral(index: Column, spacing: float = SPACING) -> tuple[Column, Column]:
    """The place of the index-th point on a golden-angle spiral."""
    r, a = spacing * F.sqrt(index.cast("double")), index * F.lit(GOLDEN)
    return r * F.cos(a), r * F.sin(a)


def hash01(text: Column) -> Column:
    """A path's place in [0, 1] by the first eight digits of its digest."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0
