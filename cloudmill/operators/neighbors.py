"""k-nearest-neighbour and radius queries around one point of the cloud."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudmill.functions.geometry import (
    at_point,
    distance,
    has_coordinates,
    squared_distance,
    within_box,
)
from cloudmill.operators.ordering import ordering_columns, take_smallest
from cloudmill.schema import RGB

# 16-bit colours of the query point, its neighbours and the rest.
RED = (255 * 255, 0, 0)
GREEN = (34 * 255, 139 * 255, 34 * 255)
BLUE = (0, 0, 255 * 255)
WHITESMOKE = (245 * 255, 245 * 255, 245 * 255)

# Times k rows that may be kept for the last pass, without a closer look.
ENOUGH = 4

_DIST = "__pt_distance"
_SHELL = "__pt_shell"
_FARTHEST = "__pt_farthest"
_ROLE = "__pt_role"


def knn(df: DataFrame, point, k: int, *, dedupe: bool = True, require_target: bool = True) -> DataFrame:
    """The `k` rows nearest to `point`, without the rows at `point` itself.

    Ties go to the least row by (x, y, z, remaining columns). With `dedupe`, equal
    rows count once.
    """
    return _nearest(df, point, k, dedupe, require_target).drop(_DIST)


def knn_color(df: DataFrame, point, k: int, *, require_target: bool = True) -> DataFrame:
    """Every row of `df`, with red/green/blue set by its role in a k-NN search.

    `k` counts distinct rows; copies of a neighbour share its colour.
    """
    order = ordering_columns(df)
    rank = F.struct(squared_distance(point).alias(_DIST), *order)
    nearest = _nearest(df, point, k, True, require_target)
    farthest = nearest.agg(F.max(F.struct(_DIST, *order)).alias("rank")).scalar()
    # The plain distance test settles nearly every row; the full key only breaks ties.
    is_neighbour = (
        has_coordinates()
        & (squared_distance(point) <= F.col(f"{_FARTHEST}.{_DIST}"))
        & (rank <= F.col(_FARTHEST))
    )
    bounded = df.withColumn(_FARTHEST, farthest)
    return _paint(bounded, F.when(at_point(point), F.lit(0)).when(is_neighbour, F.lit(1)), (RED, GREEN)).drop(
        _FARTHEST
    )


def ball_query(
    df: DataFrame, point, radius: float, *, dedupe: bool = True, require_target: bool = True
) -> DataFrame:
    """Rows strictly closer than `radius` to `point`, without the rows at `point`."""
    if require_target:
        _require_target(df, point)
    inside = df.filter(within_box(point, radius) & has_coordinates() & ~at_point(point)).filter(
        distance(point) < F.lit(float(radius))
    )
    return inside.dropDuplicates() if dedupe else inside


def ball_query_color(
    df: DataFrame,
    point,
    radius: float,
    *,
    require_target: bool = True,
    reference_compat: bool = False,
) -> DataFrame:
    """Every row of `df`, with red/green/blue set by its role in a radius query.

    With `reference_compat`, rows at exactly `radius` and rows without coordinates
    are left out and equal rows inside the ball appear once.
    """
    if require_target:
        _require_target(df, point)
    inside = has_coordinates() & (distance(point) < F.lit(float(radius)))
    role = F.when(at_point(point), F.lit(0)).when(inside, F.lit(1))
    if not reference_compat:
        return _paint(df, role, (RED, BLUE))
    # NaN sorts above every number, so a NaN distance counts as outside here.
    outside = distance(point) > F.lit(float(radius))
    once = df.filter(inside & ~at_point(point)).dropDuplicates()
    return _paint(df.filter(at_point(point) | outside).unionByName(once), role, (RED, BLUE))


def _nearest(df: DataFrame, point, k: int, dedupe: bool, require_target: bool) -> DataFrame:
    """Top k with the distance column kept.

    De-duplicating a whole cloud would shuffle all of it. Instead a first pass over
    x, y, z groups distances into thin shells. Rows in different shells differ, so
    the k nearest non-empty shells hold at least k distinct rows, and nothing beyond
    them can be among the k nearest. The same pass tells whether the target exists.

    Where these shells hold far more than k rows, the nearest of them that hold a few times
    k rows are looked at again: rows at different distances differ too, so the k-th distance
    is as far as any of the k nearest can lie.

    One number comes out, so that the box around the answer is made of literals and the
    last pass can skip row groups.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    is_target = F.coalesce(at_point(point), F.lit(False))
    shells = (
        df.filter(has_coordinates())
        .withColumn(_DIST, squared_distance(point))
        .groupBy(F.when(~is_target, _shell(F.col(_DIST), k)).alias(_SHELL))
        .agg(F.max(_DIST).alias("reach"), F.count("*").alias("rows"))
        # The target's own group is NULL and sorts first.
        .orderBy(F.col(_SHELL).asc_nulls_first())
        .limit(k + 1)
        .toArrow()
    )
    has_target = len(shells) > 0 and not shells[_SHELL][0].is_valid
    if require_target and not has_target:
        raise ValueError(f"no row of the point cloud lies at {tuple(point)}")
    shells = shells.slice(int(has_target), k)
    reach = _reach(df, point, k, shells["reach"].to_numpy(), shells["rows"].to_numpy())
    near = _within(df, point, reach)
    if dedupe:
        near = near.dropDuplicates()
    return take_smallest(near, k, [F.col(_DIST), *ordering_columns(df)])


def _reach(df: DataFrame, point, k: int, reaches: np.ndarray, rows: np.ndarray) -> float:
    """A squared distance that the k nearest distinct rows do not exceed."""
    if not len(reaches):
        return 0.0
    ends, wanted, last = rows.cumsum(), ENOUGH * k, len(rows) - 1
    while ends[-1] > wanted:
        at = min(int(np.searchsorted(ends, wanted)), last)
        nearest = _within(df, point, float(reaches[at])).select(_DIST).distinct().orderBy(_DIST).limit(k)
        found = nearest.agg(F.count(_DIST).alias("n"), F.max(_DIST).alias("reach")).first()
        if found["n"] == k:
            return found["reach"]
        if at == last:
            break
        wanted *= ENOUGH  # copies: look further
    return float(reaches[-1])


def _within(df: DataFrame, point, reach: float) -> DataFrame:
    """The rows up to a squared distance, without those at the point."""
    # Slack for the rounding of sqrt and for squares too small to represent: the box may
    # be loose but must not lose a row.
    half = math.sqrt(max(reach, 1e-300)) * (1 + 1e-12)
    return (
        df.filter(within_box(point, half) & has_coordinates() & ~at_point(point))
        .withColumn(_DIST, squared_distance(point))
        .filter(F.col(_DIST) <= F.lit(reach))
    )


def _shell(squared: Column, k: int) -> Column:
    """Logarithmic distance bucket, finer for larger k so that k buckets can fill up."""
    per_doubling = 1 << min(16, max(8, math.ceil(math.log2(k)) + 1))
    clamped = F.least(F.greatest(squared, F.lit(1e-300)), F.lit(1e300))
    return F.floor(F.log2(clamped) * F.lit(float(per_doubling)))


def _paint(df: DataFrame, role: Column, colors) -> DataFrame:
    """Set red/green/blue in the type the frame already uses for them."""
    painted = {}
    for i, channel in enumerate(RGB):
        kind = df.schema[channel].dataType if channel in df.columns else T.DoubleType()
        shade = F.lit(WHITESMOKE[i])
        for code, color in enumerate(colors):
            shade = F.when(F.col(_ROLE) == code, F.lit(color[i])).otherwise(shade)
        painted[channel] = shade.cast(kind)
    return df.withColumn(_ROLE, role).withColumns(painted).drop(_ROLE)


def _require_target(df: DataFrame, point) -> None:
    if df.filter(at_point(point)).isEmpty():
        raise ValueError(f"no row of the point cloud lies at {tuple(point)}")

