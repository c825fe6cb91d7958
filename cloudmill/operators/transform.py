"""Normalisation and augmentation: one output row per input row, no shuffle of points."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudmill.functions.draws import hash_normals
from cloudmill.operators.ordering import ordering_columns
from cloudmill.schema import XYZ

_STATS = "__pt_stats"


def normalize(df: DataFrame, cols=XYZ) -> DataFrame:
    """Replace each column by (v - mean) / sample standard deviation.

    All statistics come from one aggregate, used as a scalar subquery. NULL and NaN
    are left out of them and stay as they are; a column that does not vary becomes 0.
    """
    stats = df.agg(
        F.struct(
            *[
                F.struct(
                    F.avg(_known(c)).alias("mean"), F.stddev_samp(_known(c)).alias("sd")
                ).alias(c)
                for c in cols
            ]
        ).alias("stats")
    ).scalar()

    def scaled(c: str) -> Column:
        mean, sd = F.col(f"{_STATS}.{c}.mean"), F.col(f"{_STATS}.{c}.sd")
        varies = F.coalesce(sd, F.lit(0.0)) > 0
        return (
            F.when(F.col(c).isNull() | F.isnan(c), F.col(c))
            .when(varies, (F.col(c) - mean) / sd)
            .otherwise(F.lit(0.0))
        )

    return df.withColumn(_STATS, stats).withColumns({c: scaled(c) for c in cols}).drop(_STATS)


def rotate_z(df: DataFrame, angle: float, *, reference_compat: bool = False) -> DataFrame:
    """Rotate about the z axis by `angle` radians: x' = x cos + y sin, y' = -x sin + y cos.

    `reference_compat` uses each coordinate alone: x' = x (cos + sin), y' = y (cos - sin).
    """
    cos, sin = F.lit(math.cos(angle)), F.lit(math.sin(angle))
    x, y = F.col("x"), F.col("y")
    if reference_compat:
        return df.withColumns({"x": x * cos + x * sin, "y": y * cos - y * sin})
    # Both read the old coordinates; chained withColumn calls would feed x' into y'.
    return df.withColumns({"x": x * cos + y * sin, "y": y * cos - x * sin})


def jitter(
    df: DataFrame,
    sigma: float,
    clip: float,
    *,
    seed: int = 0,
    key=None,
    normals: list[Column] | None = None,
) -> DataFrame:
    """Add Gaussian noise N(0, sigma) to x, y, z, never moving one by more than `clip`.

    Noise is drawn from (seed, key); `key` defaults to all columns, so equal rows
    move together unless a unique key is given. `normals` replaces the generator by
    three columns of standard normals.
    """
    if clip < 0:
        raise ValueError("clip must not be negative")
    if normals is None:
        normals = hash_normals(seed, [F.col(k) for k in key] if key else ordering_columns(df))
    limit = F.lit(float(clip))
    return df.withColumns(
        {
            c: F.least(
                F.greatest(F.col(c) + noise * F.lit(float(sigma)), F.col(c) - limit),
                F.col(c) + limit,
            )
            for c, noise in zip(XYZ, normals)
        }
    )


def _known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))
