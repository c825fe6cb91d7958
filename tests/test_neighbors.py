import math

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from cloudmill import ball_query, ball_query_color, knn, knn_color
from cloudmill.operators import neighbors

NAN = float("nan")


def test_ties_go_to_least_row(xyz):
    df = xyz([(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)])
    assert rows(knn(df, (0, 0, 0), 2)) == [(-1, 0, 0), (0, -1, 0)]


def test_knn_leaves_out_all_rows_at_the_target_and_copies(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 1), (0.0, 0.0, 0.0, 2), (1.0, 0.0, 0.0, 3), (1.0, 0.0, 0.0, 3), (2.0, 0.0, 0.0, 4)],
        "x double, y double, z double, intensity int",
    )
    assert rows(knn(df, (0, 0, 0), 2).select("intensity")) == [(3,), (4,)]
    assert rows(knn(df, (0, 0, 0), 2, dedupe=False).select("intensity")) == [(3,), (3,)]


def test_knn_ignores_missing_coordinates(xyz):
    df = xyz([(0, 0, 0), (None, 0, 0), (0, NAN, 0), (5, 0, 0)])
    assert rows(knn(df, (0, 0, 0), 3)) == [(5, 0, 0)]


def test_knn_with_more_neighbours_than_rows(xyz):
    df = xyz([(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    assert knn(df, (0, 0, 0), 50).count() == 2
    assert knn(xyz([(0, 0, 0)]), (0, 0, 0), 5).count() == 0


def test_knn_equals_brute_force_for_many_k(spark, xyz):
    import random

    rng = random.Random(7)
    data = [(rng.gauss(0, 1), rng.gauss(0, 5), float(rng.randint(0, 3))) for _ in range(400)]
    data += data[:100] + [(0.0, 0.0, 0.0)]
    df = xyz(data, 5)

    def key(p):
        return ((p[0] * p[0] + p[1] * p[1]) + p[2] * p[2], p)

    distinct = sorted(set(data) - {(0.0, 0.0, 0.0)}, key=key)
    for k in (1, 7, 99, 399, 400, 401):
        assert rows(knn(df, (0, 0, 0), k)) == sorted(distinct[:k])


def test_last_pass_keeps_near_k_rows(spark, monkeypatch):
    """Thousands of rows in each shell, and every row twice."""
    df = spark.range(40_000).selectExpr("1 + id / 1e9 AS x", "0D AS y", "0D AS z").unionByName(
        spark.range(20_000).selectExpr("1 + id / 1e9 AS x", "0D AS y", "0D AS z")
    )
    df = df.unionByName(spark.createDataFrame([(0.0, 0.0, 0.0)], df.schema)).cache()
    kept = []
    original = neighbors._within
    monkeypatch.setattr(neighbors, "_within", lambda *a: kept.append(original(*a)) or kept[-1])
    for k in (3, 3_000):
        got = knn(df, (0, 0, 0), k).agg(F.count("x").alias("n"), F.max("x").alias("x")).first()
        assert (got.n, got.x) == (k, 1 + (k - 1) / 1e9)
        assert kept[-1].count() == 2 * k


def test_knn_at_extreme_scales(xyz):
    tiny = [(0.0, 0.0, 0.0)] + [(i * 1e-170, 0.0, 0.0) for i in range(1, 6)]
    assert knn(xyz(tiny), (0, 0, 0), 3).count() == 3
    huge = [(0.0, 0.0, 0.0)] + [(i * 1e200, 0.0, 0.0) for i in range(1, 6)]
    assert knn(xyz(huge), (0, 0, 0), 3).count() == 3


def test_missing_target_is_an_error(xyz):
    df = xyz([(1, 1, 1)])
    for call in (
        lambda: knn(df, (0, 0, 0), 1),
        lambda: knn_color(df, (0, 0, 0), 1),
        lambda: ball_query(df, (0, 0, 0), 1),
        lambda: ball_query_color(df, (0, 0, 0), 1),
    ):
        with pytest.raises(ValueError, match="no row"):
            call()
    assert knn(df, (0, 0, 0), 1, require_target=False).count() == 1
    with pytest.raises(ValueError):
        knn(df, (1, 1, 1), 0)


def test_ball_is_open(xyz):
    df = xyz([(0, 0, 0), (3, 4, 0), (3, 3, 0)])
    assert rows(ball_query(df, (0, 0, 0), 5)) == [(3, 3, 0)]


def test_ball_color_roles(xyz):
    df = xyz([(0, 0, 0), (3, 4, 0), (3, 3, 0), (3, 3, 0), (9, 9, 9), (None, 0, 0), (NAN, 0, 0)])
    colors = ball_query_color(df, (0, 0, 0), 5)
    assert colors.count() == df.count()
    assert dict(colors.dtypes)["red"] == "double"
    assert rows(colors.filter("blue = 65025").select("x", "y", "z")) == [(3, 3, 0), (3, 3, 0)]
    assert rows(colors.filter("red = 65025").select("x", "y", "z")) == [(0, 0, 0)]
    assert colors.filter("red = 62475").count() == 4
    compat = ball_query_color(df, (0, 0, 0), 5, reference_compat=True)
    # Boundary and NULL rows vanish, copies inside merge, NaN is farther than any radius.
    assert rows(compat.select("x", "y", "z")) == [(0, 0, 0), (3, 3, 0), (9, 9, 9), ("NaN", 0, 0)]


def test_knn_color_counts_distinct_rows_and_colours_copies(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 7), (1.0, 0.0, 0.0, 7), (1.0, 0.0, 0.0, 7), (2.0, 0.0, 0.0, 7), (3.0, 0.0, 0.0, 7)],
        "x double, y double, z double, red int",
    )
    out = knn_color(df, (0, 0, 0), 2)
    assert dict(out.dtypes)["red"] == "int"
    assert rows(out.filter("green = 35445").select("x")) == [(1.0,), (1.0,), (2.0,)]
    assert rows(out.filter("red = 65025").select("x")) == [(0.0,)]
    assert out.count() == 5


def test_knn_color_without_neighbours(xyz):
    out = knn_color(xyz([(0, 0, 0), (None, 1, 1)]), (0, 0, 0), 3)
    assert rows(out.select("red")) == [(62475.0,), (65025.0,)]


def test_results_do_not_depend_on_partitioning(cloud):
    from cloudmill.plans.points import lowest_point

    target = lowest_point(cloud)
    results = [
        (rows(knn(df, target, 9)), rows(ball_query(df, target, 4.0)))
        for df in (cloud.repartition(n) for n in (1, 4, 16))
    ]
    assert results[0] == results[1] == results[2]


def test_box_reaches_the_scan(spark, cloud, tmp_path):
    path = str(tmp_path / "stored")
    cloud.write.parquet(path)
    stored = spark.read.parquet(path)
    text = plan(ball_query(stored, (1.0, 2.0, 3.0), 5.0, require_target=False))
    assert "GreaterThanOrEqual(x,-4.0)" in text and "LessThanOrEqual(z,8.0)" in text
    text = plan(knn(stored, (1.0, 2.0, 3.0), 5, require_target=False))
    assert "GreaterThanOrEqual(x," in text and "LessThanOrEqual(z," in text
    for query in (knn_color, ball_query_color):
        text = plan(query(stored, (1.0, 2.0, 3.0), 5, require_target=False))
        assert "Join" not in text and "CartesianProduct" not in text


def test_distances_match_math(xyz):
    out = ball_query(xyz([(0, 0, 0), (1, 2, 2)]), (0, 0, 0), math.nextafter(3.0, 4.0))
    assert out.count() == 1
    assert ball_query(xyz([(0, 0, 0), (1, 2, 2)]), (0, 0, 0), 3.0).count() == 0
