"""Farthest-point sampling: greedy choice of the point farthest from all chosen ones."""

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cloudmill.functions.geometry import at_point, has_coordinates
from cloudmill.operators.grouping import least_row_per_group
from cloudmill.operators.ordering import ordering_columns, take_smallest
from cloudmill.operators.sampling import voxel_sample
from cloudmill.schema import XYZ
from cloudmill.session import scratch_path

# Each axis is cut at so many even steps and as many quantiles, by the size of the sample:
# from 17**3 to 41**3 cells.
LEAST_CUTS, MOST_CUTS = 8, 20
# Chosen points sent to the tasks in one job: some tens of megabytes.
CENTRES_AT_ONCE = 500_000

_CELL = "__pt_cell"
_CENTRES = "__pt_centres"
_NEARNESS = "__pt_nearness"
_COPIES = "__pt_copies"


def farthest_point_sample(
    df: DataFrame,
    n: int,
    *,
    start=None,
    method: str = "exact",
    cells: int = 32,
    reference_compat: bool = False,
) -> DataFrame:
    """n rows, each the farthest from those chosen before it; ties go to the least row.

    The first row is the least by (x, y, z, remaining columns), or the one at `start`.
    `reference_compat` leaves it out, for n-1 rows. Rows without coordinates are never
    chosen. With n at or above the row count the cloud is returned unchanged.

    "exact" repeats the greedy choice over the whole cloud. "coreset" chooses among the
    least row of each occupied cell of a grid with `cells` cells along each axis: every
    row lies within a cell's diagonal of one of them, and the choice does not depend on
    how rows are spread. `cells` bounds the core-set at (cells + 1)^3 rows; with fewer
    than n occupied cells the least rows left complete the sample.
    """
    if n < 1:
        raise ValueError("the sample size must be at least 1")
    if method not in ("exact", "coreset"):
        raise ValueError("method is 'exact' or 'coreset'")
    if n >= df.count():
        return df
    pool = df.filter(has_coordinates())
    places = pool.select(*XYZ)
    if method == "coreset":
        places = _core_set(places, cells, start)
    chosen = _rows_at(pool, _choose(places, n, start))
    chosen += _least_left(pool, chosen, n)
    return df.sparkSession.createDataFrame(chosen[1:] if reference_compat else chosen, df.schema)


def _choose(places: DataFrame, n: int, start) -> list[tuple]:
    """Greedy choice of coordinates, with one Spark job for many rounds.

    Rows at the same coordinates are as far from all others, so x, y, z are all that is
    needed; they are written once, without copies and in the order of the cells that space
    is cut into. A job reads the cells asked for and returns each one's farthest place and
    its distance. Choosing a place only changes cells that come closer to it than their own
    farthest place: others stay exact, so rounds go on without a job until the best cell is
    one that changed. Then all changed cells are evaluated again, each against only those
    chosen places that can be the nearest somewhere in the cell. Nothing but the chosen
    places and one place per cell reaches the driver, and no job depends on the result of
    an earlier one being kept.
    """
    cuts = min(MOST_CUTS, max(LEAST_CUTS, math.ceil(n ** (1 / 3))))
    quantiles = [(i + 1) / (cuts + 1) for i in range(cuts)]
    wanted = F.lit(True) if start is None else at_point(start)
    summary = places.agg(
        *[F.min(c).alias(f"lo_{c}") for c in XYZ],
        *[F.max(c).alias(f"hi_{c}") for c in XYZ],
        *[F.percentile_approx(c, quantiles, 200).alias(f"q_{c}") for c in XYZ],
        F.min(F.when(wanted, F.struct(*XYZ))).alias("seed"),
    ).first()
    if summary["seed"] is None:
        if start is not None:
            raise ValueError(f"no row of the point cloud lies at {tuple(start)}")
        return []
    borders = [_cuts(summary[f"lo_{c}"], summary[f"hi_{c}"], summary[f"q_{c}"], cuts) for c in XYZ]
    path = scratch_path(places.sparkSession, "places")
    celled = places.distinct().withColumn(_CELL, _cell_number(borders))
    celled.sortWithinPartitions(_CELL).write.parquet(path)
    celled = places.sparkSession.read.parquet(path)
    cells = _Cells(
        celled.groupBy(_CELL)
        .agg(*[F.min(c).alias(f"lo_{c}") for c in XYZ], *[F.max(c).alias(f"hi_{c}") for c in XYZ])
        .collect()
    )

    chosen = [tuple(summary["seed"])]
    cells.add_centre(chosen[0])
    while len(chosen) < n:
        while (best := cells.farthest()) is None:
            for row in _evaluate(celled, cells.stale_centres(), (2 * cuts + 1) ** 3):
                cells.refresh(row)
        distance, place = best
        if distance == 0:
            break
        chosen.append(place)
        cells.add_centre(place)
    return chosen


def _rows_at(pool: DataFrame, places: list[tuple]) -> list[Row]:
    """The least row at each of the chosen places, in the order of the choice."""
    if not places:
        return []
    at = [f"{_CELL}_{c}" for c in XYZ]
    table = pa.table({c: pa.array([p[i] for p in places], pa.float64()) for i, c in enumerate(at)})
    lists = F.broadcast(pool.sparkSession.createDataFrame(table))  # the sample itself
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(a) for c, a in zip(XYZ, at)))
    near = pool.join(lists, same, "left_semi")
    found = near.groupBy(*[(F.col(c) + F.lit(0.0)).alias(a) for c, a in zip(XYZ, at)])
    rows = found.agg(F.min(F.struct(*ordering_columns(pool))).alias(_CELL)).select(f"{_CELL}.*").collect()
    least = {tuple(row[c] for c in XYZ): row for row in rows}
    return [Row(*pool.columns)(*[least[p][c] for c in pool.columns]) for p in places]


def _least_left(pool: DataFrame, chosen: list[Row], n: int) -> list[Row]:
    """Complete a sample once every row left coincides with a chosen one: least rows first.

    Copies are counted, never listed, and n groups hold enough of them: each has at
    least one, and no more are used up than rows chosen.
    """
    if len(chosen) >= n:
        return []
    groups = pool.groupBy(*pool.columns).agg(F.count("*").alias(_COPIES))
    used = Counter(map(_sort_key, chosen))
    filled: list[Row] = []
    for group in take_smallest(groups, n, ordering_columns(pool)).collect():
        row = Row(*pool.columns)(*[group[c] for c in pool.columns])
        left = group[_COPIES] - used[_sort_key(row)]
        filled += [row] * min(left, n - len(chosen) - len(filled))
    return filled


def _evaluate(celled: DataFrame, centres: list[tuple], most: int) -> list[Row]:
    """The farthest place of each given cell, measured to that cell's centres."""
    # One row per cell, with CENTRES_AT_ONCE points in all.
    ids = [cell for cell, _ in centres]
    table = pa.table(
        {
            _CELL: pa.array(ids, pa.int32()),
            _CENTRES: pa.array(
                [[dict(zip(XYZ, p)) for p in points] for _, points in centres],
                pa.list_(pa.struct([(c, pa.float64()) for c in XYZ])),
            ),
        }
    )
    lists = F.broadcast(celled.sparkSession.createDataFrame(table))

    def squared(centre: Column) -> Column:
        dx, dy, dz = (F.col(c) - centre.getField(c) for c in XYZ)
        return dx * dx + dy * dy + dz * dz

    scored = (
        celled.filter(F.col(_CELL).between(min(ids), max(ids)))
        .join(lists, _CELL)
        .withColumn(_NEARNESS, -F.array_min(F.transform(_CENTRES, squared)))
    )
    order = [F.col(c) for c in (_NEARNESS, *XYZ, _CELL)]
    return least_row_per_group(scored, [_CELL], order, at_most=most).collect()


class _Cells:
    """Driver-side summary of the cells: tight boxes, farthest rows, nearby centres."""

    def __init__(self, boxes: list[Row]):
        boxes.sort(key=lambda r: r[_CELL])
        self.ids = [r[_CELL] for r in boxes]
        self.at = {cell: i for i, cell in enumerate(self.ids)}
        self.lo = np.array([[r[f"lo_{c}"] for c in XYZ] for r in boxes])
        self.hi = np.array([[r[f"hi_{c}"] for c in XYZ] for r in boxes])
        # Upper bound of the distance of a cell's rows; exact where not stale.
        self.bound = np.full(len(boxes), math.inf)
        self.stale = np.ones(len(boxes), dtype=bool)
        self.places: list[tuple | None] = [None] * len(boxes)
        self.centres: list[list[tuple]] = [[] for _ in boxes]
        # Least over all centres of the distance to a cell's far corner.
        self.reach = np.full(len(boxes), math.inf)

    def add_centre(self, place: tuple) -> None:
        point = np.array(place, dtype=float)
        # Rounding is monotone, so these bound the distances Spark computes.
        near = _sum_squares(np.maximum(np.maximum(self.lo - point, point - self.hi), 0.0))
        far = _sum_squares(np.maximum(np.abs(self.lo - point), np.abs(self.hi - point)))
        touched = near < self.bound
        self.reach = np.minimum(self.reach, far)
        self.bound = np.where(touched, np.minimum(self.bound, far), self.bound)
        self.stale |= touched
        centre = tuple(point.tolist())
        for i in np.flatnonzero(touched):
            self.centres[i].append((near[i], centre))

    def farthest(self) -> tuple[float, tuple] | None:
        """Best exact cell, or None if a stale cell might hold a place as good."""
        exact = ~self.stale
        if not exact.any():
            return None
        best = self.bound[exact].max()
        if self.stale.any() and self.bound[self.stale].max() >= best:
            return None
        tied = np.flatnonzero(exact & (self.bound == best))
        return best, min(self.places[i] for i in tied)

    def stale_centres(self) -> list[tuple]:
        """Stale cells with the centres that can matter there, most promising cells first.

        What does not fit into one broadcast is left for the next job.
        """
        stale = np.flatnonzero(self.stale)
        out, size = [], 0
        for i in stale[np.argsort(-self.bound[stale], kind="stable")]:
            # A centre whose nearest corner lies beyond another's far corner never wins.
            kept = [c for c in self.centres[i] if c[0] <= self.reach[i]]
            self.centres[i] = kept
            size += len(kept)
            if out and size > CENTRES_AT_ONCE:
                break
            out.append((self.ids[i], [centre for _, centre in kept]))
        return out

    def refresh(self, row: Row) -> None:
        i = self.at[row[_CELL]]
        self.bound[i] = -row[_NEARNESS]
        self.stale[i] = False
        self.places[i] = tuple(row[c] for c in XYZ)


def _core_set(places: DataFrame, cells: int, start) -> DataFrame:
    """The least place of each grid cell, and the one at `start`."""
    core = voxel_sample(places, cells)
    return core if start is None else core.unionByName(places.filter(at_point(start)).distinct())


def _cuts(lo: float, hi: float, quantiles: list[float], cuts: int) -> list[float]:
    """Cell borders inside (lo, hi]: even steps follow space, quantiles follow density."""
    even = [lo + (hi - lo) * (i + 1) / (cuts + 1) for i in range(cuts)]
    return sorted({v for v in even + list(quantiles) if lo < v <= hi})


def _cell_number(cuts: list[list[float]]) -> Column:
    number = F.lit(0)
    for axis, borders in zip(XYZ, cuts):
        number = number * F.lit(len(borders) + 1) + _slab(F.col(axis), borders, 0)
    return number


def _slab(v: Column, borders: list[float], first: int) -> Column:
    """Number of borders at or below v, by bisection."""
    if not borders:
        return F.lit(first)
    mid = len(borders) // 2
    return F.when(v < F.lit(borders[mid]), _slab(v, borders[:mid], first)).otherwise(
        _slab(v, borders[mid + 1 :], first + mid + 1)
    )


def _sum_squares(d: np.ndarray) -> np.ndarray:
    squares = d * d
    return (squares[:, 0] + squares[:, 1]) + squares[:, 2]


def _sort_key(row: Row) -> tuple:
    """Spark's ascending order: NULL first, NaN last."""
    lead = [row[c] for c in XYZ] + [row[c] for c in row.__fields__ if c not in XYZ]
    return tuple(
        (0, 0) if v is None else (2, 0) if isinstance(v, float) and math.isnan(v) else (1, v)
        for v in lead
    )
