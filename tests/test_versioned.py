import time
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from cloudmill import PointTable, list_tables, run_pipeline
from cloudmill.plans import versions
from cloudmill.plans.versions import utc

SCHEMA = "x double, y double, z double, year int, tag string"


@pytest.fixture
def make(spark, tmp_path):
    def build(partition_by=("year",), name="t", **options):
        schema = spark.createDataFrame([], SCHEMA).schema
        return PointTable.create(
            spark, str(tmp_path / name), schema, partition_by=partition_by, **options
        )

    return build


@pytest.fixture
def batch(spark):
    def build(*triples):
        data = [(float(x), 0.0, 0.0, year, tag) for x, year, tag in triples]
        return spark.createDataFrame(data, SCHEMA)

    return build


def ids(df):
    return sorted(r["x"] for r in df.select("x").collect())


def test_empty_table(make):
    table = make()
    assert table.read().count() == 0 and table.read().columns == ["x", "y", "z", "tag", "year"]
    assert table.current_snapshot() is None
    assert table.history().count() == table.snapshots().count() == table.partitions().count() == 0


def test_unknown_table_and_wrong_schema(spark, make, batch, tmp_path):
    with pytest.raises(ValueError, match="no point table"):
        PointTable(spark, str(tmp_path / "missing"))
    table = make()
    with pytest.raises(ValueError, match="do not match"):
        table.append(batch((1, 2000, "a")).drop("tag"))
    with pytest.raises(ValueError):
        table.read(3)
    with pytest.raises(ValueError):
        make(partition_by=["nope"], name="u")


def test_commits_replay_like_a_fold(make, batch, spark):
    """Every operation against a plain list, and every version read back."""
    table = make()
    state, versions = [], {}

    def step(operation, new_state):
        nonlocal state
        snapshot = operation()
        state = new_state
        versions[snapshot] = list(state)

    a = [(1, 2000, "a"), (2, 2000, "b"), (3, 2001, "a"), (4, None, "n")]
    step(lambda: table.append(batch(*a)), a)
    b = [(5, 2001, "b"), (6, 2002, None)]
    step(lambda: table.append(batch(*b)), state + b)
    step(lambda: table.delete_where("tag = 'a'"), [r for r in state if r[2] != "a"])
    c = [(7, 2000, "c"), (8, None, "m")]
    step(
        lambda: table.overwrite_partitions(batch(*c)),
        [r for r in state if r[1] not in (2000, None)] + c,
    )
    step(lambda: table.delete_where(F.col("year") == 2001), [r for r in state if r[1] != 2001])
    step(lambda: table.delete_where("x > 100"), state)
    d = [(9, 2001, "d"), (9, 2001, "d")]
    step(lambda: table.append(batch(*d)), state + d)
    step(lambda: table.overwrite_partitions(batch()), state)
    assert ids(table.read()) == sorted(float(r[0]) for r in state)
    for snapshot, want in versions.items():
        assert ids(table.read(snapshot)) == sorted(float(r[0]) for r in want)
    assert [r.operation for r in table.snapshots().collect()] == [
        "append", "append", "delete", "overwrite", "delete", "delete", "append", "overwrite",
    ]


def test_delete_touches_only_matching_files(make, batch):
    table = make()
    table.append(batch(*[(i, 2000 + i % 4, "a") for i in range(40)]))
    before = {r["file"] for r in table._live_files(table._timeline(), 1).collect()}
    table.delete_where("year = 2001")
    after = {r["file"] for r in table._live_files(table._timeline(), 2).collect()}
    # Nothing rewritten: the partition's files are dropped, the others stay.
    assert after < before
    table.delete_where("x = 2")
    last = {r["file"] for r in table._live_files(table._timeline(), 3).collect()}
    assert len(after - last) == 1 and len(last - after) == 1
    assert ids(table.read()) == [float(i) for i in range(40) if i % 4 != 1 and i != 2]
    with pytest.raises(Exception):
        table.delete_where("no_such_column = 1")


def test_points_that_need_no_gathering_are_not_shuffled(make, batch, monkeypatch):
    table, plans = make(), []
    arranged = PointTable._arranged

    def recorded(self, *args):
        out = arranged(self, *args)
        plans.append("Rebalance" in out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(PointTable, "_arranged", recorded)
    points = batch(*[(i, 2000 + i % 2, "a") for i in range(8)])
    table.append(points)
    table.append(points.filter("year = 2000").repartition(3), gather=False)
    table.overwrite_partitions(points.filter("year = 2001"), gather=False)
    table.delete_where("x = 2")  # rewrites files, partition by partition
    assert plans == [True, False, False, False]
    assert ids(table.read()) == [0.0, 0.0, 1.0, 3.0, 4.0, 4.0, 5.0, 6.0, 6.0, 7.0]
    assert ids(table.read(2)) == sorted(ids(points) + [0.0, 2.0, 4.0, 6.0])


def test_survey_table_copies_its_points_once(spark, cloud, tmp_path, monkeypatch):
    """No staged copy beside the table, whose files hold each commit's points once."""
    monkeypatch.setattr(versions, "scratch_path", lambda spark, label: str(tmp_path / label))
    path = versions._build(spark, cloud)
    assert [p.name for p in tmp_path.iterdir()] == ["surveys"]
    assert PointTable(spark, path).read(7).count() == cloud.count()


def test_points_that_need_no_gathering_are_not_sorted(spark, make, batch, monkeypatch):
    """Sorts by partition spill; a task has several partitions' files open instead."""
    name, open_files = "spark.sql.maxConcurrentOutputFileWriters", []
    writer = type(spark.range(1).write)
    parquet = writer.parquet

    def watched(self, path, *args, **kwargs):
        if "/data/" in path:
            open_files.append(spark.conf.get(name, None))
        return parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", watched)
    table = make()
    years = [None, *range(2000, 2020)]  # more than a task has files open for
    points = [(i, years[i % len(years)], "a") for i in range(100)]
    table.append(batch(*points).coalesce(1), gather=False)
    table.delete_where("x >= 60")
    table.append(batch((100, 2000, "a")))
    table.append(batch((101, 2000, "a")), zorder_bits=4, gather=False)
    assert open_files == ["8", "8", None, None] and spark.conf.get(name, None) is None
    want = [(float(i), y) for i, y, _ in points[:60]] + [(100.0, 2000), (101.0, 2000)]
    assert sorted((r.x, r.year) for r in table.read().collect()) == want


def test_delete_keeps_rows_where_the_condition_is_null(make, batch):
    table = make()
    table.append(batch((1, 2000, None), (2, 2000, "a"), (3, 2000, "b")))
    table.delete_where("tag = 'a'")
    assert ids(table.read()) == [1.0, 3.0]


def test_unpartitioned_table(make, batch):
    table = make(partition_by=())
    table.append(batch((1, 2000, "a"), (2, 2001, "b")))
    table.append(batch((3, 2002, "c")))
    assert table.partitions().columns == ["record_count", "file_count"]
    assert table.partitions().first()["record_count"] == 3
    table.delete_where("x = 1")
    assert ids(table.read()) == [2.0, 3.0]
    table.overwrite_partitions(batch((9, 2000, "z")))
    assert ids(table.read()) == [9.0]
    assert ids(table.read(2)) == [1.0, 2.0, 3.0]


def test_odd_partition_values(make, batch):
    odd = ["a b", "c:d/e", "100%", "x=1+2", "ü{}[]*?", "", None]
    table = make(partition_by=("tag",))
    table.append(batch(*[(i, 2000, v) for i, v in enumerate(odd)]))
    table.delete_where("x = 2")
    table.append(batch((9, 2000, "a b")))
    assert ids(table.read()) == [0.0, 1.0, 3.0, 4.0, 5.0, 6.0, 9.0]
    assert ids(table.read().filter("tag = 'c:d/e'")) == [1.0]
    table.overwrite_partitions(batch((20, 2000, "x=1+2"), (21, 2000, None)))
    assert ids(table.read().filter("tag = 'x=1+2'")) == [20.0]
    assert 21.0 in ids(table.read()) and 6.0 not in ids(table.read())


def test_partition_counts(make, batch):
    table = make()
    table.append(batch(*[(i, 2000, "a") for i in range(5)], (9, 2001, "b")))
    table.append(batch((10, 2000, "a")))
    got = {
        r["partition"]["year"]: (r["record_count"], r["file_count"], r["spec_id"])
        for r in table.partitions().collect()
    }
    assert got[2000][0] == 6 and got[2000][1] >= 2 and got[2001][0] == 1
    on_disk = list(Path(table.path).glob("data/*/year=2000/*.parquet"))
    assert got[2000][1] == len(on_disk)


def test_times_without_a_zone_are_in_the_session_zone(spark, make, batch, monkeypatch):
    table = make()
    table.append(batch((1, 2000, "a")), at=utc(2002))
    table.append(batch((2, 2000, "a")), at=datetime(2003, 6, 1, 5, tzinfo=timezone.utc))
    before = spark.conf.get("spark.sql.session.timeZone")
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        for zone, seen in (("UTC", 1), ("America/New_York", 2)):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert table.snapshot_at("2003-06-01 03:00:00") == seen
            assert table.snapshot_at(datetime(2003, 6, 1, 3)) == seen
            assert table.snapshot_at("2003-06-01T03:00:00Z") == 1
            assert table.snapshot_at(datetime(2003, 6, 1, 5, tzinfo=timezone.utc)) == 2
            assert table.snapshot_at(1054443600000) == 2
            assert table.snapshot_at(1054443599999) == 1
        with pytest.raises(ValueError, match="not a time"):
            table.snapshot_at("yesterday morning")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        monkeypatch.undo()
        time.tzset()


def test_time_travel_rollback_and_expiry(make, batch):
    table = make()
    for i in range(1, 6):
        table.append(batch((i, 2000, "a")), at=utc(2010 + i))
    assert ids(table.read(as_of=utc(2013, 6))) == [1.0, 2.0, 3.0]
    assert ids(table.read(as_of=utc(2013))) == [1.0, 2.0, 3.0]
    millis = int(utc(2012, 6).timestamp() * 1000)
    assert table.snapshot_at(millis) == table.snapshot_at(str(millis)) == 2
    assert table.snapshot_at("2012-06-01 00:00:00") == table.snapshot_at("2012-06-01T00:00:00+00:00")
    with pytest.raises(ValueError, match="no snapshot"):
        table.read(as_of=utc(2009))
    with pytest.raises(ValueError):
        table.read(1, as_of=utc(2013))
    assert ids(table.read_appends(2, 4)) == [3.0, 4.0]
    assert ids(table.read_appends(3)) == [4.0, 5.0]
    with pytest.raises(ValueError, match="not an ancestor"):
        table.read_appends(4, 2)

    table.rollback_to(2, at=utc(2020))
    table.append(batch((60, 2001, "b")), at=utc(2021))
    assert ids(table.read()) == [1.0, 2.0, 60.0]
    moves = [(r.snapshot_id, r.parent_id, r.is_current_ancestor) for r in table.history().collect()]
    assert moves == [
        (1, None, True), (2, 1, True), (3, 2, False), (4, 3, False), (5, 4, False), (2, 1, True), (6, 2, True),
    ]
    with pytest.raises(ValueError, match="not an ancestor"):
        table.rollback_to(4)
    assert ids(table.read(as_of=utc(2020, 6))) == [1.0, 2.0]
    assert ids(table.read(as_of=utc(2019))) == [1.0, 2.0, 3.0, 4.0, 5.0]

    # Strictly before, and along the current line only.
    table.rollback_to_time(utc(2021), at=utc(2022))
    assert table.current_snapshot() == 2
    with pytest.raises(ValueError, match="before"):
        table.rollback_to_time(utc(2011))

    assert table.expire_snapshots(utc(2014), at=utc(2023)) == [1, 3]
    assert [r.snapshot_id for r in table.snapshots().collect()] == [2, 4, 5, 6]
    for gone in (1, 3, 77):
        with pytest.raises(ValueError, match="expired"):
            table.read(gone)
    assert ids(table.read()) == [1.0, 2.0]
    assert table.expire_snapshots(utc(2090), at=utc(2024)) == [4, 5, 6]
    assert table.unreachable_files().count() > 0
    assert table.expire_snapshots(utc(2090), delete_files=True) == []
    assert ids(table.read()) == [1.0, 2.0]
    assert len(list(Path(table.path).glob("data/*/*/*.parquet"))) == 2


def test_incremental_read_skips_other_operations(make, batch):
    table = make()
    table.append(batch((1, 2000, "a")))
    table.append(batch((2, 2000, "a"), (3, 2001, "a")))
    table.overwrite_partitions(batch((4, 2000, "b")))
    table.delete_where("x = 3")
    table.append(batch((5, 2002, "c")))
    assert ids(table.read_appends(1)) == [2.0, 3.0, 5.0]
    assert ids(table.read_appends(2, 4)) == []


def test_unfinished_commits_are_invisible(make, batch):
    table = make()
    table.append(batch((1, 2000, "a")))
    # Points and file log written, but the writer died before its event.
    table._write(batch((2, 2000, "a")), table._new_key())
    assert ids(table.read()) == [1.0]
    table.append(batch((3, 2000, "a")))
    assert ids(table.read()) == [1.0, 3.0]
    assert table.partitions().first()["record_count"] == 2


def test_reads_are_plain_scans_with_pushdown(make, batch):
    table = make()
    table.append(batch(*[(i, 2000 + i % 3, "a") for i in range(30)]))
    table.delete_where("x = 4")
    text = plan(table.read().filter("x < 5 AND year = 2001").select("x"))
    assert "Join" not in text and "Exchange" not in text
    assert "PushedFilters: [IsNotNull(x), LessThan(x,5.0)]" in text
    assert "ReadSchema: struct<x:double>" in text
    assert "year" in text.split("PartitionFilters")[1].split("\n")[0]


def test_zordered_table(make, batch):
    table = make(name="z", zorder_bits=10)
    table.append(batch(*[(i, 2000 + i % 2, "a") for i in range(25)]))
    table.append(batch(*[(i, 2000 + i % 2, "a") for i in range(25, 50)]), zorder_bits=5)
    table.delete_where("x < 10")
    assert ids(table.read()) == [float(i) for i in range(10, 50)]


def test_insight_export_and_table_list(spark, make, batch, tmp_path):
    table = make()
    table.append(batch((1, 2000, "a")), at=datetime.now(timezone.utc) - timedelta(days=1))
    table.export_insights(str(tmp_path / "out"))
    for name, width in (("history", 4), ("snapshots", 4), ("partitions", 4)):
        exported = spark.read.csv(str(tmp_path / "out" / name))
        assert exported.count() == 1 and len(exported.columns) == width
    assert list_tables(spark).columns == ["tableName"]


def test_pipeline_modes(spark, make, batch, tmp_path):
    table = make()
    for i in range(1, 5):
        table.append(batch((i, 2000, "a"), (i + 10, 2000, "a")), at=utc(2010 + i))
    run = lambda **k: run_pipeline(spark, table.path, **k)
    assert run().count() == 8
    assert run(snapshot_id=2).count() == 4
    assert run(as_of=utc(2013, 2)).count() == 6
    assert run(appended_between=(1, 3)).count() == 4
    out = str(tmp_path / "csv")
    result = run(columns=["x", "y", "z"], operator="uniform_sampling", options={"n": 3}, output=out)
    assert result.columns == ["x", "y", "z"]
    assert rows(spark.read.schema("x double, y double, z double").csv(out)) == rows(result)
    for operator, options, count in (
        ("voxel_sampling", {"cells": 1}, 2),
        ("random_sampling", {"n": 5}, 5),
        ("farthest_point_sampling", {"n": 2}, 2),
        ("knn_search", {"point": (1, 0, 0), "k": 3}, 3),
        ("knn_search_with_color", {"point": (1, 0, 0), "k": 3}, 8),
        ("ball_query", {"point": (1, 0, 0), "radius": 2.5}, 2),
        ("ball_query_with_color", {"point": (1, 0, 0), "radius": 2.5}, 8),
        ("normalize", {}, 8),
        ("rotate", {"angle": 1.0}, 8),
        ("jitter", {"sigma": 0.01, "clip": 0.05}, 8),
    ):
        assert run(operator=operator, options=options).count() == count
    with pytest.raises(ValueError, match="unknown operator"):
        run(operator="nope")
    with pytest.raises(ValueError, match="only one"):
        run(snapshot_id=1, as_of=utc(2013))
