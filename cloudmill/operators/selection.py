"""Rows at given ranks and the n least rows, by counting instead of sorting everything."""

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudmill.operators.ordering import INDEX, with_global_index
from cloudmill.session import scratch_path

# Parts of one histogram. Counted inside each task first, so few beside a task's rows.
SLABS = 1 << 16
# Parts that one sample's share of the rows is cut into.
FINENESS = 64

# Histograms of histograms: more only save sorting, never change a result.
LEVELS = 4

# Added to a rank among the rows kept, it gives the rank among all.
SHIFT = "__pt_shift"

_SLAB, _ID, _PART, _ROWS, _BEFORE = (f"__pt_{c}" for c in ("slab", "id", "part", "rows", "before"))
_START, _LO, _HI, _PARTS = _CUT = tuple(f"__pt_{c}" for c in ("start", "lo", "hi", "parts"))

# Parts of one histogram of draws.
BINS = 4096
_MOST = 1 << 60


def rows_around_ranks(
    df: DataFrame,
    lead: Column,
    lo: float,
    hi: float,
    samples: int,
    below: Callable[[int], int],
    below_column: Callable[[Column], Column],
) -> DataFrame:
    """The rows whose slab of the leading order column holds a wanted rank, with `SHIFT`.

    `below` tells how many of the `samples` wanted ranks are less than a rank. Slabs follow
    the order, so counting rows per slab gives the ranks that each one covers. A slab with
    far more rows than its wanted ranks need is cut into parts, the finer the more ranks it
    holds, and counted again, and so on: only the first histogram reaches the driver. What
    no histogram can part, such as copies of one value, is kept whole.
    """
    spark = df.sparkSession
    slabs = min(SLABS, FINENESS * samples)
    placed = df.withColumn(_SLAB, _step(lead, F.lit(lo), F.lit(hi), F.lit(slabs)))
    known = F.when(~F.isnan(lead), lead)
    counts = [F.count("*").alias(_ROWS), F.min(known).alias(_LO), F.max(known).alias(_HI)]
    sizes = placed.groupBy(_SLAB).agg(*counts).orderBy(_SLAB).toArrow()  # SLABS + 2 rows at most
    rows = sizes[_ROWS].to_numpy()
    starts = rows.cumsum() - rows
    ranks = [below(int(i)) for i in [*starts, rows.sum()]]
    wanted = np.diff(np.array(ranks, dtype=object)).astype(np.int64)
    kept = np.flatnonzero(wanted)
    lows, highs = (np.array(sizes[c].to_pylist(), dtype=float)[kept] for c in (_LO, _HI))
    rows, starts, wanted = rows[kept], starts[kept], wanted[kept]
    fine = (rows > FINENESS * wanted) & (lows < highs)
    table = {
        _SLAB: pa.array(sizes[_SLAB].to_numpy()[kept], pa.int32()),
        _ID: pa.array(kept, pa.int64()),
        _START: starts,
        _LO: pa.array(lows, from_pandas=True),
        _HI: pa.array(highs, from_pandas=True),
        _PARTS: pa.array(np.where(fine, np.minimum(FINENESS * wanted, SLABS), 1), pa.int32()),
        SHIFT: starts - (rows.cumsum() - rows),
    }
    inside = placed.join(F.broadcast(spark.createDataFrame(pa.table(table))), _SLAB)
    if not fine.any():
        return inside.drop(_SLAB, _ID, *_CUT)

    inside = inside.drop(SHIFT)
    part = F.when(F.col(_PARTS) > 1, _step(lead, F.col(_LO), F.col(_HI), F.col(_PARTS)))
    running = Window.partitionBy(_ID).orderBy(_PART)  # SLABS rows at most
    end = F.sum(_ROWS).over(running) + F.col(_START)
    holds = below_column(F.col(_BEFORE) + F.col(_ROWS)) - below_column(F.col(_BEFORE))
    fine = (F.col(_ROWS) > FINENESS * holds) & (F.col(_LO) < F.col(_HI))
    parts = F.when(fine, F.least(FINENESS * holds, F.lit(SLABS))).otherwise(F.lit(1)).cast("int")
    for level in range(LEVELS):
        inside = inside.withColumn(_PART, F.coalesce(part, F.lit(0)))
        path = scratch_path(spark, "rank-histogram")
        (
            inside.groupBy(_SLAB, _ID, _START, _PART)
            .agg(*counts)
            .withColumn(_BEFORE, end - F.col(_ROWS))
            .filter(holds > 0)
            .withColumns({_START: F.col(_BEFORE), _PARTS: parts})
            .withColumn(f"{_ID}_next", F.monotonically_increasing_id())
            .write.parquet(path)
        )
        histogram = spark.read.parquet(path)
        last = level == LEVELS - 1 or histogram.filter(F.col(_PARTS) > 1).isEmpty()
        if last:
            histogram = _with_shift(histogram)
        found = histogram.select(_ID, _PART, *([SHIFT] if last else [f"{_ID}_next", *_CUT]))
        inside = inside.drop(*_CUT).join(found, [_ID, _PART]).drop(_ID, _PART)
        if last:
            return inside.drop(_SLAB)
        inside = inside.withColumnRenamed(f"{_ID}_next", _ID)


def _with_shift(histogram: DataFrame) -> DataFrame:
    """Rows kept before each part: those of earlier slabs, then those within its slab."""
    sums = histogram.groupBy(_SLAB).agg(F.sum(_ROWS).alias(_ROWS)).orderBy(_SLAB).toArrow()
    rows = sums[_ROWS].to_numpy()
    before = pa.table({_SLAB: sums[_SLAB], _BEFORE: rows.cumsum() - rows})
    earlier = F.broadcast(histogram.sparkSession.createDataFrame(before))
    running = F.sum(_ROWS).over(Window.partitionBy(_SLAB).orderBy(_START))
    kept = F.col(_BEFORE) + running - F.col(_ROWS)
    return histogram.drop(_BEFORE).join(earlier, _SLAB).withColumn(SHIFT, F.col(_START) - kept)


def _step(value: Column, lo: Column, hi: Column, steps: Column) -> Column:
    """Number of the even step that holds a value; NULL below all steps, NaN above."""
    at = F.floor((value - lo) / (hi - lo) * steps.cast("double"))
    return (
        F.when(value.isNull(), F.lit(-1))
        .when(F.isnan(value), steps)
        .otherwise(F.least(at, steps - 1))
        .cast("int")
    )


def n_smallest_draws(df: DataFrame, draw: Column, n: int, order: list[Column]) -> DataFrame:
    """The `n` rows with the least draws (bigint in [0, 2^60]), ties by `order`.

    Draws are counted in even bins, first around where uniform draws would put the n-th
    least, then within the bin that holds it, until all rows of that bin are wanted: for
    uniform draws nearly always at once, for others after a few counts. One filter then gives
    the rows, which are neither sorted nor moved. Only rows that share the n-th draw are ranked.
    """
    total = df.count()
    if n >= total:
        return df
    spread = 6 * math.isqrt(n) + 10
    bottom, top = 0, _MOST + 1  # the n-th least draw is from `bottom` on and below `top`
    lo = max(n - spread, 0) * _MOST // total
    hi = min((n + spread) * _MOST // total, top)
    while True:
        width = -(-(hi - lo) // BINS)
        within = F.call_function("div", draw - F.lit(lo), F.lit(width)).cast("int")
        place = F.when(draw < F.lit(lo), -1).when(draw >= F.lit(hi), BINS).otherwise(within)
        counts = df.groupBy(place.alias("bin")).agg(F.count("*").alias("rows")).orderBy("bin").toArrow()
        ends = counts["rows"].to_numpy().cumsum()
        at = int(np.searchsorted(ends, n))
        found = counts["bin"][at].as_py()
        if found == -1:
            lo, hi = bottom, lo
        elif found == BINS:
            lo, hi = hi, top
        else:
            lo += found * width
            hi = min(lo + width, hi)
            if ends[at] == n:
                return df.filter(draw < F.lit(hi))
            if hi - lo == 1:
                break
        bottom, top = lo, hi
    ties, _ = with_global_index(df.filter(draw == F.lit(lo)), order)
    left = n - (int(ends[at - 1]) if at else 0)
    return df.filter(draw < F.lit(lo)).unionByName(ties.filter(F.col(INDEX) < left).drop(INDEX))
