import math
import random

import numpy as np
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from cloudmill import farthest_point_sample, random_sample, uniform_sample, voxel_sample
from cloudmill.operators import farthest, grouping, ordering, sampling, selection

NAN = float("nan")


def test_uniform_sizes(xyz):
    df = xyz([(float(i), 0.0, 0.0) for i in range(10)], 4)
    for n in (1, 3, 7, 9):
        assert uniform_sample(df, n).count() == n
    assert uniform_sample(df, 10) is df and uniform_sample(df, 11) is df
    for bad in (0, -1):
        with pytest.raises(ValueError):
            uniform_sample(df, bad)
    with pytest.raises(ValueError):
        uniform_sample(df, 2, mode="other")


def test_uniform_is_evenly_spaced(xyz):
    df = xyz([(float(i), 0.0, 0.0) for i in range(100)], 7)
    assert rows(uniform_sample(df, 4).select("x")) == [(24.0,), (49.0,), (74.0,), (99.0,)]
    # round half up: 100 / 40 = 2.5 gives every third row
    assert uniform_sample(df, 40, mode="stride").count() == 34


@pytest.mark.parametrize("slabs, fineness", [(1 << 16, 64), (5, 2)])
@pytest.mark.parametrize("mode", ["exact", "stride"])
def test_uniform_takes_even_ranks_whatever_the_histograms(xyz, monkeypatch, mode, slabs, fineness):
    gauss = np.random.default_rng(2).standard_cauchy((700, 3))
    odd = xyz([*map(tuple, gauss), *[(None, 1, 1)] * 9, *[(NAN, 1, 1)] * 9, *[(0.5, 0, 0)] * 300], 5)
    flat = xyz([(1.0, float(i), 0.0) for i in range(50)])
    infinite = xyz([(math.inf, 0, 0), (-math.inf, 0, 0), *[(float(i), 0, 0) for i in range(30)]])
    monkeypatch.setattr(selection, "SLABS", slabs)
    monkeypatch.setattr(selection, "FINENESS", fineness)
    for df, n in [(odd, 17), (odd, 400), (flat, 7), (infinite, 5)]:
        everything = rows(df)
        total = len(everything)
        if mode == "exact":
            want = [r for i, r in enumerate(everything) if (i + 1) * n // total > i * n // total]
        else:
            want = everything[:: math.floor(total / n + 0.5)]
        assert rows(uniform_sample(df, n, mode=mode)) == want


def test_uniform_by_other_orders_and_finer_histograms(cloud, monkeypatch):
    cases = [(37, {}), (9, {"order_by": ["point_id"]}), (300, {"order_by": ["gpsTime"]})]
    want = [rows(uniform_sample(cloud, n, **o)) for n, o in cases]
    monkeypatch.setattr(selection, "SLABS", 7)
    monkeypatch.setattr(selection, "FINENESS", 3)
    assert want == [rows(uniform_sample(cloud, n, **o)) for n, o in cases]


def test_uniform_sorts_little_of_a_skewed_cloud(spark, monkeypatch):
    """Half of the rows lie in a thousandth of the range: the second histogram parts them."""
    df = spark.range(200_000).selectExpr(
        "IF(id % 2 = 0, id / 2e8, id / 2e3) AS x", "CAST(id AS double) AS y", "0D AS z"
    )
    ranked = []
    original = sampling.with_global_index
    monkeypatch.setattr(sampling, "with_global_index", lambda d, o: ranked.append(d.count()) or original(d, o))
    monkeypatch.setattr(selection, "SLABS", 200)
    assert uniform_sample(df, 100).count() == 100
    assert ranked[0] < 200_000 / 10


def test_uniform_with_products_beyond_64_bits(monkeypatch, xyz):
    df = xyz([(float(i), 0.0, 0.0) for i in range(9)])
    i = F.monotonically_increasing_id()
    big = sampling._bucket(F.lit(10**12 - 1) + i * 0, 10**11, 10**12)
    assert df.select(big.alias("b")).first()["b"] == (10**12 - 1) * 10**11 // 10**12


def test_uniform_in_stored_order(spark, tmp_path):
    """Positions follow the files, however they are split into tasks."""
    df = spark.range(1000).selectExpr("CAST(id AS double) AS x", "0D AS y", "0D AS z")
    path = str(tmp_path / "files")
    df.repartitionByRange(3, "x").sortWithinPartitions("x").write.parquet(path)
    stored = spark.read.parquet(path)
    sample = uniform_sample(stored.select("x", "y", "z"), 4, order_by=ordering.STORED)
    assert sample.columns == ["x", "y", "z"]
    assert rows(sample.select("x")) == [(249.0,), (499.0,), (749.0,), (999.0,)]
    assert uniform_sample(stored, 300, mode="stride", order_by=ordering.STORED).count() == 334
    assert uniform_sample(stored, 1000, order_by=ordering.STORED) is stored
    assert "Exchange hashpartitioning" not in plan(sample)
    with pytest.raises(ValueError, match="without filters"):
        uniform_sample(stored.filter("x <> 5"), 4, order_by=ordering.STORED)


@pytest.mark.parametrize("n", [5, 500, 3999])
def test_uniform_splits_equal_rows(spark, n):
    """A third of all rows are one point; no task may get all of them."""
    df = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1000D ELSE CAST(id AS double) END AS x", "0D AS y", "0D AS z"
    ).repartition(6)
    ranked, total = ordering.with_global_index(df, ordering.ordering_columns(df))
    assert total == 4000
    index = [r[0] for r in ranked.select(ordering.INDEX).orderBy(ordering.INDEX).collect()]
    assert index == list(range(4000))
    assert uniform_sample(df, n).count() == n
    copies = uniform_sample(df, n).filter("x = 1000").count()
    assert abs(copies - n / 3) <= 2


def test_ranked_partitions_are_balanced_with_equal_rows(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 > 0 THEN 1D ELSE CAST(id AS double) END AS x")
    written = []
    original = ordering.scratch_path
    monkeypatch.setattr(
        ordering, "scratch_path", lambda s, label: written.append(original(s, label)) or written[-1]
    )
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordering.take_smallest(df, 10, [F.col("x")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(written[0]).groupBy(ordering.PART).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) == 4
    assert max(sizes) < 1.5 * 30_000 / 4


def test_random_sizes_subset_and_seed(cloud):
    total = cloud.count()
    for n in (1, 100, total - 1):
        sample = random_sample(cloud, n, seed=3)
        assert sample.count() == n
        assert sample.exceptAll(cloud).count() == 0
    assert random_sample(cloud, total) is cloud
    assert random_sample(cloud, total + 1) is cloud
    one, two = random_sample(cloud, 100, seed=1), random_sample(cloud, 100, seed=2)
    assert rows(one) != rows(two)
    assert rows(one) == rows(random_sample(cloud.repartition(11), 100, seed=1))
    with pytest.raises(ValueError):
        random_sample(cloud, 0)


def test_random_is_uniform(spark):
    df = spark.range(20_000).selectExpr("id", "0D AS x", "0D AS y", "0D AS z")
    got = random_sample(df, 10_000, seed=9, key=["id"]).agg(F.avg("id"), F.count_distinct("id")).first()
    assert got[1] == 10_000
    assert abs(got[0] - 10_000) < 200


@pytest.mark.parametrize("bins", [4096, 1 << 20])
def test_random_takes_the_least_draws(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    rng = random.Random(3)
    draws = [rng.randrange(1 << 60) for _ in range(300)] + [7] * 50 + [None] * 60 + [0, (1 << 60) - 1]
    data = [(float(i % 17), 0.0, 0.0, d) for i, d in enumerate(draws)]
    df = spark.createDataFrame(data, "x double, y double, z double, draw bigint").repartition(5)
    order = sorted(data, key=lambda r: (1 << 60 if r[3] is None else r[3], r[0]))
    for n in (1, 30, 52, 200, 380):
        got = rows(random_sample(df, n, draw=F.col("draw")))
        assert got == sorted(order[:n], key=lambda r: (r[0], r[3] is not None, r[3] or 0)), n


def test_random_neither_sorts_nor_moves_rows(cloud):
    text = plan(random_sample(cloud, 500, seed=4))
    assert "Exchange" not in text and "Sort" not in text


def test_random_with_shared_draws_still_returns_n(xyz):
    df = xyz([(1.0, 1.0, 1.0)] * 500 + [(float(i), 0.0, 0.0) for i in range(500)], 6)
    for n in (3, 400, 700, 999):
        assert random_sample(df, n, seed=n).count() == n


def test_voxel_flat_axis_missing_and_extra_cell(xyz):
    df = xyz([(0, 0, 5), (0.4, 0, 5), (1, 0, 5), (2, 0, 5), (None, 0, 5), (NAN, 0, 5)])
    # cells of width 1 on x: [0,1), [1,2) and the maximum's own cell
    assert rows(voxel_sample(df, 2)) == [(0, 0, 5), (1, 0, 5), (2, 0, 5)]
    assert rows(voxel_sample(xyz([(7, 7, 7)]), 100)) == [(7, 7, 7)]
    with pytest.raises(ValueError):
        voxel_sample(df, 0)


def test_voxel_order_and_other_columns(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 9, "a"), (0.1, 0.0, 0.0, 1, "b"), (1.0, 0.0, 0.0, 5, "c")],
        "x double, y double, z double, id int, name string",
    )
    assert rows(voxel_sample(df, 2).select("name")) == [("a",), ("c",)]
    by_id = voxel_sample(df, 2, order_by=["id"])
    assert by_id.columns == df.columns
    assert rows(by_id.select("name")) == [("b",), ("c",)]


def test_voxel_with_cells_beyond_a_broadcast(cloud, xyz, monkeypatch):
    odd = xyz([(1.0, 2.0, 3.0)] * 9 + [(1.0, 2.0, -0.0), (1.0, 2.0, 0.0), (9.0, 9.0, 9.0)])
    with_nulls = cloud.withColumn("intensity", F.when(F.col("intensity") > 99, F.col("intensity")))
    cases = [(cloud, 10, None), (cloud, 2.5, None), (odd, 3, None), (with_nulls, 4, ["intensity"]), (cloud, 4, ["point_id"])]
    want = [rows(voxel_sample(df, c, order_by=o)) for df, c, o in cases]
    text = plan(voxel_sample(cloud, 10))
    assert "LeftSemi" in text and "BroadcastHashJoin" in text
    monkeypatch.setattr(grouping, "BROADCAST_GROUPS", 0)
    assert want == [rows(voxel_sample(df, c, order_by=o)) for df, c, o in cases]
    assert "Join" not in plan(voxel_sample(cloud, 10))


def test_samples_do_not_depend_on_partitioning(cloud):
    results = [
        (
            rows(uniform_sample(df, 50)),
            rows(random_sample(df, 50)),
            rows(voxel_sample(df, 4)),
            rows(farthest_point_sample(df, 6)),
        )
        for df in (cloud.repartition(n) for n in (1, 4, 16))
    ]
    assert results[0] == results[1] == results[2]


def _greedy(data, n):
    """Plain farthest-point loop; ties go to the least point."""
    data = sorted(data)
    left = np.array(data, dtype=float)
    nearest = np.full(len(left), math.inf)
    chosen, at = [data[0]], 0
    taken = {0}
    while len(chosen) < n:
        d = left - left[at]
        nearest = np.minimum(nearest, (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2])
        masked = nearest.copy()
        masked[list(taken)] = -1.0
        at = int(masked.argmax())
        taken.add(at)
        chosen.append(data[at])
    return sorted(chosen)


@pytest.mark.parametrize(
    "kind", ["uniform", "lattice", "two_clusters", "line", "copies"]
)
def test_farthest_equals_plain_loop(xyz, kind):
    rng = np.random.default_rng(11)
    data = {
        "uniform": rng.uniform(-1, 1, (300, 3)),
        "lattice": np.array([(a, b, c) for a in range(5) for b in range(5) for c in range(5)]),
        "two_clusters": np.concatenate([rng.normal(0, 0.001, (200, 3)), rng.normal(100, 1, (50, 3))]),
        "line": np.array([(i, 2 * i, 0) for i in range(120)]),
        "copies": np.repeat(rng.uniform(0, 1, (20, 3)), 15, axis=0),
    }[kind]
    data = [tuple(map(float, p)) for p in data]
    df = xyz(data, 3)
    for n in (1, 21):
        assert rows(farthest_point_sample(df, n)) == _greedy(data, n)


def test_farthest_needs_fewer_jobs_than_samples(xyz, monkeypatch):
    rng = np.random.default_rng(3)
    df = xyz([tuple(map(float, p)) for p in rng.uniform(0, 1, (800, 3))]).cache()
    jobs = []
    original = farthest._evaluate
    monkeypatch.setattr(farthest, "_evaluate", lambda *a: jobs.append(1) or original(*a))
    assert farthest_point_sample(df, 120).count() == 120
    assert len(jobs) < 40


def test_farthest_with_small_broadcasts(xyz, monkeypatch):
    data = [tuple(map(float, p)) for p in np.random.default_rng(8).uniform(0, 1, (200, 3))]
    monkeypatch.setattr(farthest, "CENTRES_AT_ONCE", 60)
    assert rows(farthest_point_sample(xyz(data), 12)) == _greedy(data, 12)


def test_farthest_sizes_start_and_compat(xyz):
    data = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (10.0, 0.0, 0.0), (4.0, 0.0, 0.0)]
    df = xyz(data)
    assert farthest_point_sample(df, 4) is df
    assert rows(farthest_point_sample(df, 2)) == [(0, 0, 0), (10, 0, 0)]
    assert rows(farthest_point_sample(df, 2, reference_compat=True)) == [(10, 0, 0)]
    assert farthest_point_sample(df, 1, reference_compat=True).count() == 0
    assert rows(farthest_point_sample(df, 2, start=(4, 0, 0))) == [(4, 0, 0), (10, 0, 0)]
    with pytest.raises(ValueError, match="no row"):
        farthest_point_sample(df, 2, start=(5, 0, 0))
    with pytest.raises(ValueError):
        farthest_point_sample(df, 0)


def test_farthest_completes_with_copies(xyz):
    data = [(1.0, 0.0, 0.0)] * 300 + [(2.0, 0.0, 0.0)] * 2 + [(3.0, 0.0, 0.0)]
    got = rows(farthest_point_sample(xyz(data, 4), 50))
    assert got == [(1, 0, 0)] * 48 + [(2, 0, 0), (3, 0, 0)]


def test_farthest_skips_missing_coordinates(xyz):
    df = xyz([(0, 0, 0), (1, 0, 0), (None, 0, 0), (NAN, 0, 0)])
    assert rows(farthest_point_sample(df, 3)) == [(0, 0, 0), (1, 0, 0)]


def test_coreset_does_not_depend_on_partitioning(xyz):
    rng = np.random.default_rng(6)
    df = xyz([tuple(map(float, p)) for p in rng.uniform(0, 1, (2000, 3))], 4)
    got = [
        rows(farthest_point_sample(df.repartition(k), 16, method="coreset", cells=6)) for k in (1, 7)
    ]
    assert got[0] == got[1] and len(set(got[0])) == 16


def test_coreset_start_and_fewer_cells_than_rows(xyz):
    df = xyz([(float(i), 0.0, 0.0) for i in range(100)], 4)
    got = rows(farthest_point_sample(df, 3, method="coreset", cells=4, start=(42, 0, 0)))
    assert (42, 0, 0) in got and len(got) == 3
    assert len(set(rows(farthest_point_sample(df, 20, method="coreset", cells=2)))) == 20


def test_random_sample_takes_rows_without_a_draw_last(xyz):
    df = xyz([(float(i), 0.0, 0.0) for i in range(6)], 2)
    draw = F.when(F.col("x") < 3, F.col("x").cast("bigint"))
    assert sorted(rows(random_sample(df, 2, draw=draw))) == [(0, 0, 0), (1, 0, 0)]
    got = rows(random_sample(df, 4, draw=draw))
    assert sorted(got)[:3] == [(0, 0, 0), (1, 0, 0), (2, 0, 0)] and len(got) == 4


def test_coreset_sizes(xyz):
    rng = np.random.default_rng(5)
    df = xyz([tuple(map(float, p)) for p in rng.uniform(0, 1, (500, 3))], 4)
    sample = farthest_point_sample(df, 25, method="coreset")
    assert sample.distinct().count() == 25
    assert sample.exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        farthest_point_sample(df, 2, method="other")
