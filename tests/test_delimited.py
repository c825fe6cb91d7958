import pytest
from helpers import rows

from cloudmill import read_delimited, read_xyz, write_csv, write_xyz
from cloudmill.schema import ALL_COLUMNS, LAYOUTS

HEADERS = {n: ",".join(c[0].upper() + c[1:] for c in names) for n, names in LAYOUTS.items()}


def line(width, start):
    return ",".join(str(start + i) for i in range(width))


def write(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_layouts_may_be_mixed_and_nested(spark, tmp_path):
    write(tmp_path, "a.csv", HEADERS[13], line(13, 100))
    write(tmp_path / "deep" / "er", "b.csv", HEADERS[16], line(16, 200), line(16, 300))
    write(tmp_path / "deep", "c.csv", '"' + HEADERS[15].replace(",", '","') + '"', line(15, 400))
    write(tmp_path, "ignored.txt", "no points here")
    df = read_delimited(spark, str(tmp_path))
    assert df.columns == list(ALL_COLUMNS)
    got = rows(df.select("x", "pointSourceId", "gpsTime", "red", "blue"))
    assert got == [
        (100.0, 111.0, 112.0, None, None),
        (200.0, 211.0, 212.0, 213.0, 215.0),
        (300.0, 311.0, 312.0, 313.0, 315.0),
        (400.0, 411.0, None, 412.0, 414.0),
    ]


def test_defaults_and_truncation(spark, tmp_path):
    write(tmp_path, "a.csv", HEADERS[13], "0.5,1.5,2.5,3.9,1,1,0,0,2,-3.7,0,7,1234.75")
    df = read_delimited(spark, str(tmp_path), default_rgb=0, whole_numbers=True)
    r = df.first()
    assert (r.x, r.intensity, r.scanAngleRank, r.gpsTime) == (0.5, 3.0, -3.0, 1234.75)
    assert (r.red, r.green, r.blue) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "lines",
    [
        (HEADERS[13], line(14, 0)),
        (HEADERS[13], line(12, 0)),
        (HEADERS[13], line(13, 0).replace("5", "five")),
        ("X,Y,Z,Intensity", line(16, 0)),
        # gpsTime before the rest would shift every column after it
        ("gpsTime," + HEADERS[15], line(16, 0)),
    ],
)
def test_malformed_files_fail(spark, tmp_path, lines):
    write(tmp_path, "a.csv", *lines)
    with pytest.raises(Exception, match="header|fields|CAST_INVALID_INPUT"):
        read_delimited(spark, str(tmp_path)).collect()


def test_width_is_checked_even_if_few_columns_are_read(spark, tmp_path):
    write(tmp_path, "a.csv", HEADERS[13], line(14, 0))
    with pytest.raises(Exception, match="fields"):
        read_delimited(spark, str(tmp_path)).select("x").collect()


def test_corrupt_lines_can_be_kept(spark, tmp_path):
    write(tmp_path, "a.csv", HEADERS[13], line(13, 0), line(14, 50), line(13, 100).replace("105", "?"))
    df = read_delimited(spark, str(tmp_path), corrupt_column="bad")
    assert rows(df.select("x", "returnNumber", "bad")) == [
        (None, None, line(14, 50)),
        (0.0, 4.0, None),
        (100.0, 104.0, line(13, 100).replace("105", "?")),
    ]


def test_headerless_files_and_empty_fields(spark, tmp_path):
    write(tmp_path, "a.csv", line(13, 0), "NaN,,2" + ",0" * 10, "")
    got = rows(read_delimited(spark, str(tmp_path)).select("x", "y", "z"))
    assert sorted(got, key=str) == [("NaN", None, 2.0), (0.0, 1.0, 2.0)]


def test_sinks(spark, cloud, tmp_path):
    csv, one, xyz = (str(tmp_path / n) for n in ("csv", "one", "xyz"))
    write_csv(cloud.select(*LAYOUTS[16]), csv, header=True)
    assert rows(read_delimited(spark, csv)) == rows(cloud.select(*LAYOUTS[16]))
    write_csv(cloud.repartition(4), one, single_file=True)
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1
    write_xyz(cloud, xyz)
    write_xyz(cloud, xyz)  # replaces
    assert rows(read_xyz(spark, xyz)) == rows(cloud.select("x", "y", "z"))
