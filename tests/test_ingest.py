"""Folders of files to named tables."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from cloudmill import PointTable, drop_table, ingest_files, list_tables, read_delimited
from cloudmill.schema import ALL_COLUMNS, LAYOUTS


def line(width, first, quote=""):
    return ",".join(f"{quote}{first + i}{quote}" for i in range(width))


@pytest.fixture
def name(spark):
    drop_table(spark, "ingest_test")
    yield "ingest_test"
    drop_table(spark, "ingest_test")


def test_quoted_fields_in_mixed_layouts(spark, tmp_path):
    header = ",".join(f'"{c}"' for c in LAYOUTS[16])
    (tmp_path / "a.csv").write_text(f"{header}\n{line(16, 0, chr(34))}\n{line(15, 100)}\n")
    (tmp_path / "b.csv").write_text(f' "1.5" , 2 ,"",{line(10, 3)}\n')
    got = rows(read_delimited(spark, str(tmp_path)))
    plain = dict(zip(ALL_COLUMNS, map(float, range(16))))
    short = dict(zip(LAYOUTS[15], map(float, range(100, 115))))
    odd = dict(zip(LAYOUTS[13], [1.5, 2.0, None, *map(float, range(3, 13))]))
    assert got == [tuple(r.get(c) for c in ALL_COLUMNS) for r in (plain, odd, short)]


def test_lines_with_broken_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{line(16, 0)}\n"{line(16, 1)}\n"1,5",{line(14, 2)}\n{line(12, 0)}\n')
    kept = read_delimited(spark, str(tmp_path), corrupt_column="bad").select("x", "bad").collect()
    assert sum(r.bad is not None for r in kept) == 3 and sum(r.x == 0.0 and r.bad is None for r in kept) == 1
    with pytest.raises(Exception, match="quote is not closed|neither 13"):
        read_delimited(spark, str(tmp_path)).collect()


def test_first_append_creates_a_zordered_named_table(spark, tmp_path, name):
    for part, width in (("a", 16), ("b", 13)):
        (tmp_path / part).mkdir()
        (tmp_path / part / "points.csv").write_text("\n".join(line(width, 10 * i) for i in range(5)))
    where = str(tmp_path / "table")
    assert ingest_files(spark, str(tmp_path / "a"), name, location=where) == 1
    assert ingest_files(spark, str(tmp_path / "b"), name) == 2
    table = PointTable.named(spark, name)
    assert table.path == where and table.zorder_bits == 20
    assert [r.tableName for r in list_tables(spark).collect()].count(name) == 1
    assert table.read(1).count() == 5 and table.read().count() == 10
    assert table.read().filter("red IS NULL").count() == 5
    drop_table(spark, name)
    with pytest.raises(ValueError, match="no table"):
        PointTable.named(spark, name)
    assert PointTable(spark, where).read().count() == 10  # the files stay


def test_points_are_parsed_once(spark, tmp_path, name):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "points.csv").write_text("\n".join(line(16, 10 * i) for i in range(50)))
    parsed = spark.sparkContext.accumulator(0)

    def counted(x):
        parsed.add(1)
        return int(x) % 3

    derived = {"third": F.udf(counted, "int")(F.col("x"))}
    options = {"partition_by": ["third"], "derived": derived, "location": str(tmp_path / "table")}
    ingest_files(spark, str(tmp_path / "in"), name, **options)
    assert parsed.value == 50
    ingest_files(spark, str(tmp_path / "in"), name, mode="overwrite", derived=derived)
    assert parsed.value == 100
    got = PointTable.named(spark, name).read().select("x", "third").collect()
    assert sorted(map(tuple, got)) == [(10.0 * i, 10 * i % 3) for i in range(50)]


def test_overwrite_replaces_the_partitions_of_the_files(spark, tmp_path, name):
    for part, classes in (("a", (1, 1, 2, 3)), ("b", (2, 4)), ("none", ())):
        (tmp_path / part).mkdir()
        fields = [",".join(["0"] * 8 + [str(c)] + [part == "b" and "9" or "0"] * 7) for c in classes]
        (tmp_path / part / "points.csv").write_text("\n".join(fields))
    derived = {"class": F.col("classification").cast("int")}
    options = {"location": str(tmp_path / "table"), "partition_by": ["class"], "derived": derived}
    ingest_files(spark, str(tmp_path / "a"), name, **options)
    ingest_files(spark, str(tmp_path / "b"), name, mode="overwrite", derived=derived)
    want = [(1, 0.0), (1, 0.0), (2, 9.0), (3, 0.0), (4, 9.0)]
    assert rows(PointTable.named(spark, name).read().select("class", "red")) == want
    ingest_files(spark, str(tmp_path / "none"), name, mode="overwrite", derived=derived)
    assert rows(PointTable.named(spark, name).read().select("class", "red")) == want
    with pytest.raises(ValueError, match="mode"):
        ingest_files(spark, str(tmp_path / "a"), name, mode="replace")
    with pytest.raises(ValueError, match="already"):
        PointTable.create_named(spark, name, PointTable.named(spark, name).schema)
