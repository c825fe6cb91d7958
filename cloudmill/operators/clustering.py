"""Z-order layout, so that box predicates skip most row groups of a written table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudmill.functions.geometry import morton_code
from cloudmill.operators.ordering import ordering_columns
from cloudmill.schema import XYZ

MORTON = "__pt_morton"
_EXTENT = "__pt_extent"
_STEP = tuple(f"__pt_step_{c}" for c in XYZ)
_TIE = "__pt_tie"


def add_morton(df: DataFrame, bits: int = 20, name: str = MORTON) -> DataFrame:
    """Add the z-order key: each axis scaled to [0, 2^bits), bits interleaved.

    NULL where a coordinate is NULL or NaN.
    """
    extent = df.agg(
        F.struct(
            *[
                F.struct(F.min(_known(c)).alias("lo"), F.max(_known(c)).alias("hi")).alias(c)
                for c in XYZ
            ]
        ).alias("extent")
    ).scalar()

    def step(c: str) -> Column:
        lo, hi = F.col(f"{_EXTENT}.{c}.lo"), F.col(f"{_EXTENT}.{c}.hi")
        last = (1 << bits) - 1
        scaled = F.floor((_known(c) - lo) / (hi - lo) * F.lit(float(1 << bits)))
        return F.when(hi > lo, F.least(scaled, F.lit(last))).when(_known(c).isNotNull(), F.lit(0))

    return (
        df.withColumn(_EXTENT, extent)
        .withColumns({s: step(c).cast("bigint") for s, c in zip(_STEP, XYZ)})
        .withColumn(name, morton_code([F.col(s) for s in _STEP], bits))
        .drop(_EXTENT, *_STEP)
    )


def cluster_zorder(
    df: DataFrame, bits: int = 20, partitions: int | None = None, *, within=(), in_files: bool = False
) -> DataFrame:
    """Range-partition by z-order key (below the columns `within`) and sort each part.

    Copies of one location may exceed a partition, so a tie-breaker lets the range
    bounds fall between them. It numbers rows after a local sort, hence by content:
    a retried task assigns the same values. With `in_files`, `df` is a plain scan of files,
    which gives its rows in the same order each time: they are numbered without the sort.
    """
    keys = [*within, MORTON]
    keyed = add_morton(df, bits)
    if not in_files:
        keyed = keyed.sortWithinPartitions(*keys, *ordering_columns(df))
    keyed = keyed.withColumn(_TIE, F.monotonically_increasing_id())
    bounds = [*keys, _TIE]
    spread = (
        keyed.repartitionByRange(partitions, *bounds)
        if partitions
        else keyed.repartitionByRange(*bounds)
    )
    return spread.sortWithinPartitions(*keys).drop(MORTON, _TIE)


def _known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))
