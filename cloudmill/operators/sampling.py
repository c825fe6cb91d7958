"""Uniform, random and voxel-grid down-sampling."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudmill.functions.draws import hash_draw
from cloudmill.functions.geometry import has_coordinates
from cloudmill.operators.grouping import least_row_per_group
from cloudmill.operators.ordering import (
    INDEX,
    STORED,
    ordering_columns,
    with_global_index,
    with_stored_index,
)
from cloudmill.operators.selection import SHIFT, n_smallest_draws, rows_around_ranks
from cloudmill.schema import XYZ

_BOX = "__pt_box"
_CELL = tuple(f"__pt_cell_{c}" for c in XYZ)


def uniform_sample(df: DataFrame, n: int, *, mode: str = "exact", order_by=None) -> DataFrame:
    """Evenly spaced rows of the cloud, ordered by `order_by` and then all columns.

    "exact" returns n rows. "stride" keeps every round(N/n)-th row, so its size is
    only near n. With n at or above the row count the cloud is returned unchanged.

    Histograms of the leading order column tell which of its slabs hold a wanted rank; only
    their rows are sorted. More samples make finer histograms, whatever n.

    `order_by=STORED` takes rows as they lie in the parquet files read by `df`, without
    any shuffle; after a z-order write these samples are also spread evenly in space.
    """
    _check_size(n)
    if mode not in ("exact", "stride"):
        raise ValueError("mode is 'exact' or 'stride'")
    i = F.col(INDEX)
    if order_by == STORED:
        ranked, total = with_stored_index(df)
        if n >= total:
            return df
    else:
        order = ordering_columns(df, order_by or XYZ)
        lead = order[0].cast("double") if _is_number(df, order_by or XYZ) else None
        total, lo, hi = _extent(df, lead)
        if n >= total:
            return df
        if lo is not None and lo < hi < math.inf and lo > -math.inf:
            pool = rows_around_ranks(df, lead, lo, hi, n, *_ranks_below(n, total, mode))
        else:
            pool = df.withColumn(SHIFT, F.lit(0).cast("bigint"))
        ranked, _ = with_global_index(pool, order)
        i = F.col(INDEX) + F.col(SHIFT)
    _, below = _ranks_below(n, total, mode)
    return ranked.filter(below(i + 1) > below(i)).drop(INDEX, SHIFT)


def _ranks_below(n: int, total: int, mode: str):
    """How many sampled ranks are less than a rank: for a number, and for a column."""
    if mode == "exact":
        return lambda i: i * n // total, lambda i: _bucket(i, n, total)
    stride = _stride(n, total)
    return lambda i: -(-i // stride), lambda i: _whole_div(i + F.lit(stride - 1), F.lit(stride))


def _extent(df: DataFrame, lead: Column | None) -> tuple:
    """Row count and range of the leading order column."""
    if lead is None:
        return df.count(), None, None
    known = F.when(~F.isnan(lead), lead)
    return tuple(df.agg(F.count("*"), F.min(known), F.max(known)).first())


def _stride(n: int, total: int) -> int:
    """total / n, rounded half up."""
    return math.floor(total / n + 0.5)


def _is_number(df: DataFrame, order_by) -> bool:
    lead = next((c for c in order_by if c in df.columns), df.columns[0])
    return isinstance(df.schema[lead].dataType, T.DoubleType | T.FloatType)


def random_sample(
    df: DataFrame, n: int, *, seed: int = 0, key=None, draw: Column | None = None
) -> DataFrame:
    """Exactly n rows without replacement; all rows when there are no more than n.

    A row's chance is drawn from (seed, key); `key` defaults to all columns, so equal
    rows share a draw unless a unique key is given. `draw` replaces the generator by
    a bigint column in [0, 2^60); rows without a draw come last.

    Counts of the draws by digits find the n-th least; a filter gives the rows, which are
    neither sorted nor moved.
    """
    _check_size(n)
    if draw is None:
        draw = hash_draw(seed, [F.col(k) for k in key] if key else ordering_columns(df))
    return n_smallest_draws(df, F.coalesce(draw, F.lit(1 << 60)), n, ordering_columns(df))


def voxel_sample(df: DataFrame, cells: float, *, order_by=None) -> DataFrame:
    """One row per occupied cell of a grid with `cells` cells along each axis.

    The row kept is the least of its cell by `order_by` and then all columns. Rows
    without coordinates are dropped; an axis without extent has a single cell.
    """
    if not cells > 0:
        raise ValueError("cells must be positive")
    placed = df.filter(has_coordinates())
    box = placed.agg(
        F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in XYZ]).alias(
            "box"
        )
    ).scalar()

    def cell(c: str) -> Column:
        lo, hi = F.col(f"{_BOX}.{c}.lo"), F.col(f"{_BOX}.{c}.hi")
        edge = (hi - lo) / F.lit(float(cells))
        return F.when(edge > 0, F.floor((F.col(c) - lo) / edge)).otherwise(F.lit(0)).cast("bigint")

    gridded = placed.withColumn(_BOX, box).withColumns(dict(zip(_CELL, map(cell, XYZ))))
    # The greatest coordinate of an axis falls into one more cell than asked for.
    most = (math.ceil(cells) + 1) ** 3
    order = ordering_columns(df, order_by or XYZ)
    return least_row_per_group(gridded, _CELL, order, at_most=most).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def _bucket(i: Column, n: int, total: int) -> Column:
    """floor(i * n / total) on whole numbers, in decimals where 64 bits are too few."""
    if (total + 1) * n < 1 << 63:
        return _whole_div(i * F.lit(n), F.lit(total))
    return _whole_div(i.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)"), F.lit(total))


def _whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _check_size(n: int) -> None:
    if n < 1:
        raise ValueError("the sample size must be at least 1")
