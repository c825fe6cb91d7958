"""Column expressions over x, y, z."""

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudmill.schema import XYZ


def squared_distance(point) -> Column:
    """(x-a)^2 + (y-b)^2 + (z-c)^2 to a fixed point."""
    return reduce(
        lambda total, term: total + term,
        ((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(XYZ, _floats(point))),
    )


def distance(point) -> Column:
    return F.sqrt(squared_distance(point))


def at_point(point) -> Column:
    """Exact coordinate match, one conjunct per axis so all three reach the scan."""
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in zip(XYZ, _floats(point))))


def has_coordinates() -> Column:
    """True where no coordinate is NULL or NaN."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in XYZ))


def within_box(point, radius: float) -> Column:
    """Axis-aligned box around a ball: lets parquet skip row groups by min/max."""
    half = float(radius)
    return reduce(
        lambda a, b: a & b,
        (F.col(c).between(F.lit(v - half), F.lit(v + half)) for c, v in zip(XYZ, _floats(point))),
    )


def morton_code(cells, bits: int) -> Column:
    """Interleave three `bits`-wide bigint columns; the first axis takes the lowest bit."""
    if not 1 <= bits <= 21:
        raise ValueError("bits must be in 1..21: three axes share one bigint")
    spread = [_spread_bits(c) for c in cells]
    return (
        spread[0].bitwiseOR(F.shiftleft(spread[1], 1)).bitwiseOR(F.shiftleft(spread[2], 2))
    )


def _spread_bits(cell: Column) -> Column:
    """Put two zero bits between neighbouring bits, halving the group size each step."""
    out = cell.cast("bigint")
    group = 32
    while group > 1:
        half = group // 2
        out = out.bitwiseOR(F.shiftleft(out, group)).bitwiseAND(F.lit(_spread_mask(half)))
        group = half
    return out


def _spread_mask(group: int) -> int:
    """Bit runs of length `group`, one run every 3*group bits, for 21 source bits."""
    return sum(1 << (3 * group * (i // group) + i % group) for i in range(21))


def _floats(point):
    values = tuple(float(v) for v in point)
    if len(values) != 3 or any(math.isnan(v) for v in values):
        raise ValueError("a point is three numbers (x, y, z)")
    return values
