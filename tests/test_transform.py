import math

import pytest
from helpers import rows
from pyspark.sql import functions as F

from cloudmill import cluster_zorder, jitter, normalize, rotate_z
from cloudmill.operators.clustering import add_morton

NAN = float("nan")


def test_normalized_axes_have_mean_zero_and_deviation_one(cloud):
    out = normalize(cloud)
    stats = out.agg(*[f(c) for c in "xyz" for f in (F.avg, F.stddev_samp)]).first()
    assert list(stats) == pytest.approx([0, 1] * 3, abs=1e-9)
    assert out.columns == cloud.columns


def test_normalize_flat_axis_single_row_and_missing_values(xyz):
    assert rows(normalize(xyz([(1, 2, 3)]))) == [(0, 0, 0)]
    out = rows(normalize(xyz([(1, 5, None), (3, 5, NAN), (None, 5, 2)])))
    half = math.sqrt(0.5)
    assert [r[1] for r in out] == [0, 0, 0]
    assert [r[0] for r in out] == [None, pytest.approx(-half), pytest.approx(half)]
    assert sorted((r[2] for r in out), key=str) == [0, "NaN", None]


def test_rotation(xyz):
    df = xyz([(1, 0, 5)])
    assert rotate_z(df, math.pi / 2).first()[:] == pytest.approx((0, -1, 5))
    assert rotate_z(df, 2 * math.pi).first()[:] == pytest.approx((1, 0, 5))
    assert rotate_z(df, -math.pi / 2).first()[:] == pytest.approx((0, 1, 5))


def test_rotation_keeps_the_radius(cloud):
    square = (F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("r2")
    before = rows(cloud.select(F.round(square, 6)))
    assert rows(rotate_z(cloud, 0.7).select(F.round(square, 6))) == before


def test_rotation_literal_formula(xyz):
    c, s = math.cos(0.3), math.sin(0.3)
    out = rotate_z(xyz([(2, 3, 4)]), 0.3, reference_compat=True).first()
    assert out[:] == pytest.approx((2 * (c + s), 3 * (c - s), 4))


def test_jitter_never_moves_past_clip(cloud):
    moved = jitter(cloud.withColumns({f"{c}0": F.col(c) for c in "xyz"}), 0.05, 0.02)
    for c in "xyz":
        assert moved.filter(F.abs(F.col(c) - F.col(f"{c}0")) > 0.02 + 1e-12).count() == 0
        assert moved.filter(F.col(c) != F.col(f"{c}0")).count() > 5000


def test_jitter_noise_is_normal_and_seeded(spark):
    df = spark.range(40_000).selectExpr("id", "0D as x", "0D as y", "0D as z")
    out = jitter(df, 2.0, 100.0, seed=5, key=["id"])
    stats = out.agg(
        *[f(c) for c in "xyz" for f in (F.avg, F.stddev_samp)],
        F.corr("x", "y"),
        F.corr("y", "z"),
        F.corr("x", "z"),
    ).first()
    assert list(stats[:6]) == pytest.approx([0, 2] * 3, abs=0.06)
    assert list(stats[6:]) == pytest.approx([0, 0, 0], abs=0.03)
    assert rows(out.repartition(7)) == rows(jitter(df.repartition(3), 2.0, 100.0, seed=5, key=["id"]))
    other = jitter(df, 2.0, 100.0, seed=6, key=["id"])
    both = out.alias("a").join(other.alias("b"), "id")
    assert abs(both.agg(F.corr("a.x", "b.x")).first()[0]) < 0.03


def test_jitter_keeps_missing_values(xyz):
    out = jitter(xyz([(None, NAN, 1)]), 0.01, 0.05).first()
    assert out["x"] is None and math.isnan(out["y"])
    with pytest.raises(ValueError):
        jitter(xyz([(1, 1, 1)]), 1.0, -1.0)


def _interleave(cells, bits):
    return sum(((cells[a] >> b) & 1) << (3 * b + a) for b in range(bits) for a in range(3))


@pytest.mark.parametrize("bits", [1, 5, 20, 21])
def test_morton_equals_bit_loop(xyz, bits):
    top = float((1 << bits) - 1)
    data = [(0, 0, 0), (top, top, top)] + [
        (float(i * 7919 % (top + 1)), float(i * 104729 % (top + 1)), float(i * i % (top + 1)))
        for i in range(60)
    ]
    out = add_morton(xyz(data), bits, "m").collect()
    size = 1 << bits
    for r in out:
        cells = [min(size - 1, math.floor(v / top * size)) for v in (r.x, r.y, r.z)]
        assert r.m == _interleave(cells, bits)


def test_zorder_keeps_rows_and_clusters_them(cloud):
    out = cluster_zorder(cloud, partitions=8)
    assert rows(out.select("point_id")) == rows(cloud.select("point_id"))
    assert out.columns == cloud.columns
    spread = [(F.max(c) - F.min(c)).alias(c) for c in "xyz"]
    whole = math.prod(cloud.agg(*spread).first())
    parts = out.groupBy(F.spark_partition_id()).agg(*spread).select(*"xyz").collect()
    assert sum(math.prod(p) for p in parts) / len(parts) < 0.4 * whole


def test_zorder_splits_copies_of_one_point(spark):
    df = spark.range(20_000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 1D ELSE id / 1000D END AS x", "1D AS y", "1D AS z"
    )
    sizes = [
        r["count"]
        for r in cluster_zorder(df, partitions=8).groupBy(F.spark_partition_id()).count().collect()
    ]
    assert sum(sizes) == 20_000
    assert max(sizes) < 2 * 20_000 / 8


def test_zorder_flat_axis_and_missing_coordinates(xyz):
    out = add_morton(xyz([(1, 1, 1), (1, 1, 1), (None, 1, 1)]), 20, "m")
    assert rows(out.select("m")) == [(None,), (0,), (0,)]
