"""Every operator as a query over the given tables, with the SQL that must agree with it."""

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.functions.draws import md5_draw, md5_normals
from cloudmill.operators.clustering import add_morton
from cloudmill.operators.farthest import farthest_point_sample
from cloudmill.operators.neighbors import ball_query, ball_query_color, knn, knn_color
from cloudmill.operators.ordering import STORED
from cloudmill.operators.sampling import random_sample, uniform_sample, voxel_sample
from cloudmill.operators.transform import jitter, normalize, rotate_z
from cloudmill.plans.pipeline import run_pipeline
from cloudmill.plans.points import (
    COLUMNS,
    DUCKDB_EMBEDDED,
    DUCKDB_POINTS,
    embedded_points,
    lowest_point,
    points,
)
from cloudmill.plans.versions import survey_table, utc
from cloudmill.schema import LAYOUTS, RGB, WHOLE_NUMBERS, XYZ
from cloudmill.session import scratch_path
from cloudmill.sources.delimited import read_delimited, read_xyz, write_csv, write_xyz
from cloudmill.sources.ingest import ingest_files
from cloudmill.sources.versioned import PointTable, drop_table, list_tables

K = 10
RADIUS = 5.0
CELLS = 10
SAMPLE = 1000
LARGE_SAMPLE, LARGE_DRAW = 68_400, 20_000
FARTHEST = 16
ANGLE = math.pi / 6
SIGMA, CLIP = 0.05, 0.08

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the DuckDB SQL for the same rows if there is any."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def on_points(body: str) -> str:
    return f"WITH points AS ({DUCKDB_POINTS}) {body}"


def at_target(body: str) -> str:
    """SQL over `p`: the points beside the least point (a, b, c) and their distance to it."""
    return f"""
WITH points AS ({DUCKDB_POINTS}),
     target AS (SELECT x AS a, y AS b, z AS c FROM points ORDER BY x, y, z LIMIT 1),
     p AS (SELECT points.*, (x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c) AS d2,
                  x = a AND y = b AND z = c AS is_target
           FROM points, target)
{body}"""


NAMES = ", ".join(COLUMNS)
ORDER = ", ".join(XYZ + tuple(c for c in COLUMNS if c not in XYZ))


# ---- neighbours


@query(
    "knn",
    at_target(
        f"""SELECT {NAMES} FROM (SELECT DISTINCT {NAMES}, d2 FROM p WHERE NOT is_target)
            ORDER BY d2, {ORDER} LIMIT {K}"""
    ),
)
def _knn(spark, sf_dir):
    cloud = points(spark, sf_dir)
    return knn(cloud, lowest_point(cloud), K)


def colored(target: str, near: str) -> str:
    """Colours by role; each argument lists red, green and blue."""
    rest = (62475, 62475, 62475)
    kept = ", ".join(c for c in COLUMNS if c not in RGB)
    shades = ", ".join(
        f"cast(CASE WHEN is_target THEN {t} WHEN near THEN {n} ELSE {r} END AS double) AS {c}"
        for c, t, n, r in zip(RGB, target.split(), near.split(), rest)
    )
    return f"SELECT {kept}, {shades} FROM roles"


@query(
    "knn_color",
    at_target(
        f""", ranked AS (SELECT {NAMES}, is_target,
                         dense_rank() OVER (PARTITION BY is_target ORDER BY d2, {ORDER}) AS r FROM p),
            roles AS (SELECT *, r <= {K} AS near FROM ranked) """
        + colored("65025 0 0", "8670 35445 8670")
    ),
)
def _knn_color(spark, sf_dir):
    cloud = points(spark, sf_dir)
    return knn_color(cloud, lowest_point(cloud), K)


@query(
    "ball",
    at_target(f"SELECT DISTINCT {NAMES} FROM p WHERE NOT is_target AND sqrt(d2) < {RADIUS}"),
)
def _ball(spark, sf_dir):
    cloud = points(spark, sf_dir)
    return ball_query(cloud, lowest_point(cloud), RADIUS)


@query(
    "ball_color",
    at_target(
        f", roles AS (SELECT *, sqrt(d2) < {RADIUS} AS near FROM p) "
        + colored("65025 0 0", "0 0 65025")
    ),
)
def _ball_color(spark, sf_dir):
    cloud = points(spark, sf_dir)
    return ball_query_color(cloud, lowest_point(cloud), RADIUS)


@query(
    "ball_color_compat",
    at_target(
        f""", roles AS (
            SELECT {NAMES}, is_target, false AS near FROM p WHERE is_target OR sqrt(d2) > {RADIUS}
            UNION ALL
            SELECT DISTINCT {NAMES}, is_target, true AS near FROM p
            WHERE NOT is_target AND sqrt(d2) < {RADIUS}) """
        + colored("65025 0 0", "0 0 65025")
    ),
)
def _ball_color_compat(spark, sf_dir):
    cloud = points(spark, sf_dir)
    return ball_query_color(cloud, lowest_point(cloud), RADIUS, reference_compat=True)


# ---- sampling

RANKED = f"""SELECT *, row_number() OVER (ORDER BY {ORDER}) - 1 AS i, count(*) OVER () AS total
             FROM points"""


@query(
    "uniform_exact",
    on_points(
        f"""SELECT {NAMES} FROM ({RANKED})
            WHERE (i + 1) * {SAMPLE} // total > i * {SAMPLE} // total"""
    ),
)
def _uniform_exact(spark, sf_dir):
    return uniform_sample(points(spark, sf_dir), SAMPLE)


@query(
    "uniform_exact_large",
    on_points(
        f"""SELECT {NAMES} FROM ({RANKED})
            WHERE (i + 1) * {LARGE_SAMPLE} // total > i * {LARGE_SAMPLE} // total"""
    ),
)
def _uniform_exact_large(spark, sf_dir):
    return uniform_sample(points(spark, sf_dir), LARGE_SAMPLE)


@query(
    "uniform_stride",
    on_points(
        f"""SELECT {NAMES} FROM ({RANKED})
            WHERE i % cast(floor(total / cast({SAMPLE} AS double) + 0.5) AS bigint) = 0"""
    ),
)
def _uniform_stride(spark, sf_dir):
    return uniform_sample(points(spark, sf_dir), SAMPLE, mode="stride")


@query(
    "uniform_stored",
    f"""WITH points AS ({DUCKDB_POINTS}),
             stored AS (SELECT *, row_number() OVER () - 1 AS i, count(*) OVER () AS total FROM points)
        SELECT {NAMES} FROM stored
        WHERE (i + 1) * {SAMPLE} // total > i * {SAMPLE} // total""",
)
def _uniform_stored(spark, sf_dir):
    return uniform_sample(points(spark, sf_dir), SAMPLE, order_by=STORED)


def drawn(n: int) -> str:
    return on_points(
        f"""SELECT {NAMES} FROM points
            ORDER BY cast('0x' || substr(md5('random:' || point_id), 1, 15) AS bigint), {ORDER}
            LIMIT {n}"""
    )


@query("random", drawn(SAMPLE))
def _random(spark, sf_dir):
    return random_sample(points(spark, sf_dir), SAMPLE, draw=md5_draw("random", F.col("point_id")))


@query("random_large", drawn(LARGE_DRAW))
def _random_large(spark, sf_dir):
    return random_sample(points(spark, sf_dir), LARGE_DRAW, draw=md5_draw("random", F.col("point_id")))


def voxels(source: str) -> str:
    cell = ", ".join(
        f"CASE WHEN hi_{c} > lo_{c} THEN floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / {CELLS})) ELSE 0 END"
        for c in XYZ
    )
    box = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in XYZ)
    return f"""SELECT {NAMES} FROM (
                 SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY {ORDER}) AS r
                 FROM {source}, (SELECT {box} FROM {source})) WHERE r = 1"""


@query("voxel", on_points(voxels("points")))
def _voxel(spark, sf_dir):
    return voxel_sample(points(spark, sf_dir), CELLS)


def farthest_sql(
    columns: str, order: str, n: int, skip_first: bool = False, cloud: str = DUCKDB_EMBEDDED
) -> str:
    """The greedy choice as one materialised step per sample."""

    def squared(seed: str) -> str:
        terms = [f"({c} - (SELECT {c} FROM {seed})) * ({c} - (SELECT {c} FROM {seed}))" for c in XYZ]
        return " + ".join(terms)

    steps = [
        f"s1 AS MATERIALIZED (SELECT * FROM cloud ORDER BY {order} LIMIT 1)",
        f"d1 AS MATERIALIZED (SELECT *, {squared('s1')} AS dist FROM cloud)",
    ]
    for i in range(2, n + 1):
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT * FROM d{i - 1} ORDER BY dist DESC, {order} LIMIT 1)"
        )
        steps.append(
            f"d{i} AS MATERIALIZED (SELECT * REPLACE (least(dist, {squared(f's{i}')}) AS dist) FROM d{i - 1})"
        )
    chosen = " UNION ALL ".join(
        f"SELECT {columns} FROM s{i}" for i in range(2 if skip_first else 1, n + 1)
    )
    return f"WITH cloud AS MATERIALIZED ({cloud}), {', '.join(steps)} {chosen}"


EMBEDDED = "x, y, z, classification, point_id"


@query("fps", farthest_sql(EMBEDDED, EMBEDDED, FARTHEST))
def _fps(spark, sf_dir):
    return farthest_point_sample(embedded_points(spark, sf_dir), FARTHEST)


@query("fps_compat", farthest_sql(EMBEDDED, EMBEDDED, FARTHEST, skip_first=True))
def _fps_compat(spark, sf_dir):
    return farthest_point_sample(embedded_points(spark, sf_dir), FARTHEST, reference_compat=True)


@query("fps_points", farthest_sql(NAMES, ORDER, FARTHEST, cloud=DUCKDB_POINTS))
def _fps_points(spark, sf_dir):
    return farthest_point_sample(points(spark, sf_dir), FARTHEST)


@query("fps_coreset", farthest_sql(NAMES, ORDER, FARTHEST, cloud=on_points(voxels("points"))))
def _fps_coreset(spark, sf_dir):
    return farthest_point_sample(points(spark, sf_dir), FARTHEST, method="coreset", cells=CELLS)


# ---- transforms


def rounded(df: DataFrame) -> DataFrame:
    return df.select("point_id", *[F.round(c, 6).alias(c) for c in XYZ])


def moved(**axes: str) -> str:
    """SQL for point_id and the rounded coordinates, some of them replaced."""
    return "point_id, " + ", ".join(f"round({axes.get(c, c)}, 6) AS {c}" for c in XYZ)


@query(
    "normalize",
    on_points(
        "SELECT "
        + moved(**{c: f"({c} - mean_{c}) / sd_{c}" for c in XYZ})
        + " FROM points, (SELECT "
        + ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS sd_{c}" for c in XYZ)
        + " FROM points)"
    ),
)
def _normalize(spark, sf_dir):
    return rounded(normalize(points(spark, sf_dir)))


@query(
    "rotate",
    on_points(
        "SELECT "
        + moved(
            x=f"x * cos({ANGLE!r}) + y * sin({ANGLE!r})", y=f"y * cos({ANGLE!r}) - x * sin({ANGLE!r})"
        )
        + " FROM points"
    ),
)
def _rotate(spark, sf_dir):
    return rounded(rotate_z(points(spark, sf_dir), ANGLE))


@query(
    "rotate_compat",
    on_points(
        "SELECT "
        + moved(
            x=f"x * cos({ANGLE!r}) + x * sin({ANGLE!r})", y=f"y * cos({ANGLE!r}) - y * sin({ANGLE!r})"
        )
        + " FROM points"
    ),
)
def _rotate_compat(spark, sf_dir):
    return rounded(rotate_z(points(spark, sf_dir), ANGLE, reference_compat=True))


def noisy() -> str:
    words = ", ".join(
        f"(cast('0x' || substr(h, {1 + 8 * i}, 8) AS bigint) + 0.5) / 4294967296.0 AS u{i}"
        for i in range(4)
    )
    normals = {
        "x": "sqrt(-2 * ln(u0)) * cos(2 * pi() * u1)",
        "y": "sqrt(-2 * ln(u0)) * sin(2 * pi() * u1)",
        "z": "sqrt(-2 * ln(u2)) * cos(2 * pi() * u3)",
    }
    clipped = {
        c: f"least(greatest({c} + {SIGMA} * {n}, {c} - {CLIP}), {c} + {CLIP})"
        for c, n in normals.items()
    }
    return (
        f"SELECT {moved(**clipped)} FROM (SELECT *, {words} FROM "
        "(SELECT *, md5('jitter:' || point_id) AS h FROM points))"
    )


@query("jitter", on_points(noisy()))
def _jitter(spark, sf_dir):
    normals = md5_normals("jitter", F.col("point_id"))
    return rounded(jitter(points(spark, sf_dir), SIGMA, CLIP, normals=normals))


# ---- z-order


def morton_sql(bits: int) -> str:
    def step(c: str) -> str:
        scaled = f"floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {float(1 << bits)})"
        return f"CASE WHEN hi_{c} > lo_{c} THEN least({scaled}, {(1 << bits) - 1}) ELSE 0 END"

    steps = ", ".join(f"cast({step(c)} AS hugeint) AS s{i}" for i, c in enumerate(XYZ))
    box = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in XYZ)
    terms = " + ".join(
        f"(((s{axis} >> {b}) & 1) << {3 * b + axis})" for b in range(bits) for axis in range(3)
    )
    return on_points(
        f"""SELECT point_id, x, y, z, cast({terms} AS bigint) AS morton
            FROM (SELECT *, {steps} FROM points, (SELECT {box} FROM points))"""
    )


@query("zorder_key", morton_sql(20))
def _zorder_key(spark, sf_dir):
    keyed = add_morton(points(spark, sf_dir), 20, "morton")
    return keyed.select("point_id", *XYZ, "morton")


@query(
    "zorder_ball",
    at_target(f"SELECT DISTINCT {NAMES} FROM p WHERE NOT is_target AND sqrt(d2) < {RADIUS}"),
)
def _zorder_ball(spark, sf_dir):
    """A radius query over a table written in z-order."""
    cloud = points(spark, sf_dir)
    path = scratch_path(spark, "zorder")
    table = PointTable.create(spark, path, cloud.schema, zorder_bits=20)
    table.append(cloud)
    stored = table.read()
    return ball_query(stored, lowest_point(stored), RADIUS)


# ---- delimited files


@query("csv_roundtrip", on_points(f"SELECT {', '.join(LAYOUTS[16])} FROM points"))
def _csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(points(spark, sf_dir).select(*LAYOUTS[16]), path, header=True)
    return read_delimited(spark, path)


@query(
    "csv_whole_numbers",
    on_points(
        "SELECT x, y, z, gpsTime, "
        + ", ".join(
            f"cast(0 AS double) AS {c}" if c in RGB else f"trunc({c} * 0.7) AS {c}"
            for c in WHOLE_NUMBERS
        )
        + " FROM points"
    ),
)
def _csv_whole_numbers(spark, sf_dir):
    """Files without colours; integer attributes written with fractions and cut on reading."""
    path = scratch_path(spark, "csv13")
    plain = [c for c in WHOLE_NUMBERS if c not in RGB]
    scaled = points(spark, sf_dir).withColumns({c: F.col(c) * F.lit(0.7) for c in plain})
    write_csv(scaled.select(*LAYOUTS[13]), path, header=True)
    cut = read_delimited(spark, path, default_rgb=0.0, whole_numbers=True)
    # Truncation gives -0.0 for small negative values; adding 0.0 gives one zero.
    return cut.select("x", "y", "z", "gpsTime", *[(F.col(c) + F.lit(0.0)).alias(c) for c in WHOLE_NUMBERS])


@query("xyz_roundtrip", on_points("SELECT x, y, z FROM points"))
def _xyz_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "xyz")
    write_xyz(points(spark, sf_dir), path)
    return read_xyz(spark, path)


# ---- files to named tables

FILED = ", ".join(LAYOUTS[16])


def new_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A name that the catalog does not hold any more, and an unused place."""
    drop_table(spark, name)
    return name, scratch_path(spark, name)


@query(
    "ingest_append",
    on_points(
        f"""SELECT {FILED} FROM points WHERE classification < 5 UNION ALL
            SELECT {FILED.replace('gpsTime', 'NULL AS gpsTime')} FROM points WHERE classification >= 5"""
    ),
)
def _ingest_append(spark, sf_dir):
    """Two folders of different layouts; the first creates the table, in z-order."""
    cloud, folder = points(spark, sf_dir), scratch_path(spark, "files")
    write_csv(cloud.filter("classification < 5").select(*LAYOUTS[16]), f"{folder}/a", header=True)
    write_csv(cloud.filter("classification >= 5").select(*LAYOUTS[15]), f"{folder}/b")
    name, place = new_table(spark, "cloudmill_appended")
    for part in ("a", "b"):
        ingest_files(spark, f"{folder}/{part}", name, location=place)
    return PointTable.named(spark, name).read()


@query(
    "ingest_overwrite",
    on_points(f"SELECT {FILED} FROM points WHERE classification NOT IN (3, 7) OR z >= 5"),
)
def _ingest_overwrite(spark, sf_dir):
    """A second folder replaces the two classes that it holds."""
    cloud, folder = points(spark, sf_dir).select(*LAYOUTS[16]), scratch_path(spark, "files")
    write_csv(cloud, f"{folder}/a", header=True)
    write_csv(cloud.filter("classification IN (3, 7) AND z >= 5"), f"{folder}/b", header=True)
    name, place = new_table(spark, "cloudmill_overwritten")
    ingest_files(spark, f"{folder}/a", name, location=place, partition_by=["classification"])
    ingest_files(spark, f"{folder}/b", name, mode="overwrite")
    return PointTable.named(spark, name).read().select(*LAYOUTS[16])


@query(
    "list_tables",
    on_points(
        """SELECT 'cloudmill_returns_' || cast(cast(edgeOfFlightLine AS int) AS varchar) AS "tableName",
                  count(*) AS points FROM points GROUP BY ALL"""
    ),
)
def _list_tables(spark, sf_dir):
    """Named tables, one for each value of a flag, with the points that each one holds."""
    cloud = points(spark, sf_dir)
    counts = []
    for edge in (0, 1):
        name, place = new_table(spark, f"cloudmill_returns_{edge}")
        table = PointTable.create_named(spark, name, cloud.schema, location=place)
        table.append(cloud.filter(F.col("edgeOfFlightLine") == edge))
        stored = PointTable.named(spark, name).read()
        counts.append(stored.agg(F.lit(name).alias("tableName"), F.count("*").alias("points")))
    return list_tables(spark).join(reduce(DataFrame.unionAll, counts), "tableName")


# ---- versioned table

SECOND_COPY = "SELECT {0} FROM points UNION ALL SELECT {0} FROM points WHERE survey_year = 1995 AND z >= 9"
OVERWRITTEN = "NOT (survey_year = 1998 AND classification = 7)"


def version(name: str, where: str):
    return query(name, on_points(f"SELECT {NAMES} FROM points WHERE {where}"))


@query("scan_xyz", on_points(SECOND_COPY.format("x, y, z")))
def _scan_xyz(spark, sf_dir):
    return survey_table(spark, sf_dir).read().select(*XYZ)


@version("append_rows", "true")
def _append_rows(spark, sf_dir):
    return survey_table(spark, sf_dir).read(7)


@version("overwrite_partitions", OVERWRITTEN)
def _overwrite_partitions(spark, sf_dir):
    return survey_table(spark, sf_dir).read(8)


@version("delete_where", f"{OVERWRITTEN} AND z >= 1")
def _delete_where(spark, sf_dir):
    return survey_table(spark, sf_dir).read(9)


@version("snapshot_read", "survey_year <= 2000")
def _snapshot_read(spark, sf_dir):
    return survey_table(spark, sf_dir).read(6)


@version("asof_read", "survey_year <= 1999")
def _asof_read(spark, sf_dir):
    return survey_table(spark, sf_dir).read(as_of=utc(2000, 6))


@version("incremental_read", "survey_year IN (2000, 2001)")
def _incremental_read(spark, sf_dir):
    return survey_table(spark, sf_dir).read_appends(5, 7)


@version("rollback_timestamp", OVERWRITTEN)
def _rollback_timestamp(spark, sf_dir):
    """As current after the first rollback, which undid the delete."""
    return survey_table(spark, sf_dir).read(as_of=utc(2004, 9))


@version("rollback_snapshot", "true")
def _rollback_snapshot(spark, sf_dir):
    """As current after the second rollback, which also undid the overwrite."""
    return survey_table(spark, sf_dir).read(as_of=utc(2005, 6))


def readable_rows() -> str:
    shown = {
        5: "survey_year <= 1999",
        6: "survey_year <= 2000",
        7: "true",
        8: OVERWRITTEN,
        9: f"{OVERWRITTEN} AND z >= 1",
    }
    parts = [
        f"SELECT cast({s} AS bigint) AS snapshot_id, count(*) AS points FROM points WHERE {w}"
        for s, w in shown.items()
    ]
    parts.append(
        f"SELECT cast(10 AS bigint), count(*) FROM ({SECOND_COPY.format('x')})"
    )
    return on_points(" UNION ALL ".join(parts))


@query("expire_snapshots", readable_rows())
def _expire_snapshots(spark, sf_dir):
    """Rows that each snapshot left by the expiry still shows."""
    table = survey_table(spark, sf_dir)
    readable = [r["snapshot_id"] for r in table.snapshots().select("snapshot_id").collect()]
    counts = [
        table.read(s).agg(F.count("*").alias("points")).select(F.lit(s).cast("bigint").alias("snapshot_id"), "points")
        for s in readable
    ]
    return reduce(DataFrame.unionAll, counts)


def commit_rows() -> str:
    """Every commit with the number of records it added, less those it removed."""

    def count(where: str) -> str:
        return f"(SELECT count(*) FROM points WHERE {where})"

    rows = [
        (y - 1994, y - 1995 or "NULL", y + 1, "append", count(f"survey_year = {y}"))
        for y in range(1995, 2002)
    ]
    rows += [
        (8, 7, 2003, "overwrite", "-" + count(f"NOT ({OVERWRITTEN})")),
        (9, 8, 2004, "delete", "-" + count(f"{OVERWRITTEN} AND z < 1")),
        (10, 7, 2006, "append", count("survey_year = 1995 AND z >= 9")),
    ]
    return " UNION ALL ".join(
        f"""SELECT cast({s} AS bigint) AS snapshot_id, cast({p} AS bigint) AS parent_id,
                   cast(epoch(TIMESTAMP '{y}-01-01') AS bigint) AS committed_at,
                   '{op}' AS operation, {n} AS net_records"""
        for s, p, y, op, n in rows
    )


def commits_with_records(spark, sf_dir) -> DataFrame:
    summary = F.col("summary")
    return (
        survey_table(spark, sf_dir)
        .snapshots()
        .select(
            "snapshot_id",
            "parent_id",
            F.col("committed_at").cast("bigint").alias("committed_at"),
            "operation",
            (
                summary["added-records"].cast("bigint") - summary["deleted-records"].cast("bigint")
            ).alias("net_records"),
        )
    )


@query(
    "snapshots",
    on_points(f"SELECT * FROM ({commit_rows()}) WHERE snapshot_id >= 5"),
)
def _snapshots(spark, sf_dir):
    return commits_with_records(spark, sf_dir)


@query(
    "history",
    on_points(
        f"""SELECT cast(epoch(moved) AS bigint) AS made_current_at, h.snapshot_id, h.parent_id,
                   h.snapshot_id NOT IN (8, 9) AS is_current_ancestor, c.net_records
            FROM (SELECT make_timestamp(committed_at * 1000000) AS moved, snapshot_id, parent_id
                  FROM ({commit_rows()})
                  UNION ALL SELECT TIMESTAMP '2004-06-01', 8, 7
                  UNION ALL SELECT TIMESTAMP '2005-01-01', 7, 6) AS h
            LEFT JOIN ({commit_rows()}) AS c
              ON c.snapshot_id = h.snapshot_id AND c.snapshot_id >= 5"""
    ),
)
def _history(spark, sf_dir):
    """Pointer moves, with the records of those snapshots that are still readable."""
    moves = survey_table(spark, sf_dir).history()
    return moves.withColumn("made_current_at", F.col("made_current_at").cast("bigint")).join(
        commits_with_records(spark, sf_dir).select("snapshot_id", "net_records"), "snapshot_id", "left"
    )


PER_YEAR = on_points(
    f"""SELECT survey_year, count(*) AS record_count, cast(0 AS int) AS spec_id
        FROM ({SECOND_COPY.format('survey_year')}) GROUP BY survey_year"""
)


@query("partitions", PER_YEAR)
def _partitions(spark, sf_dir):
    return (
        survey_table(spark, sf_dir)
        .partitions()
        .select("partition.survey_year", "record_count", "spec_id")
    )


@query("insight_export", PER_YEAR)
def _insight_export(spark, sf_dir):
    """Partition statistics exported as CSV and read back."""
    folder = scratch_path(spark, "insight")
    survey_table(spark, sf_dir).export_insights(folder)
    schema = "survey_year int, record_count bigint, file_count bigint, spec_id int"
    return spark.read.schema(schema).csv(f"{folder}/partitions").drop("file_count")


# ---- pipelines


@query(
    "run_asof_voxel",
    f"WITH every_point AS ({DUCKDB_POINTS}), points AS (SELECT * FROM every_point WHERE survey_year <= 1999) "
    + voxels("points"),
)
def _run_asof_voxel(spark, sf_dir):
    table = survey_table(spark, sf_dir).path
    return run_pipeline(
        spark, table, as_of=utc(2000, 6), operator="voxel_sampling", options={"cells": CELLS}
    )


@query(
    "run_export_rotate",
    on_points(
        "SELECT "
        + ", ".join(
            f"round({e}, 6) AS {c}"
            for c, e in {
                "x": f"x * cos({ANGLE!r}) + y * sin({ANGLE!r})",
                "y": f"y * cos({ANGLE!r}) - x * sin({ANGLE!r})",
                "z": "z",
            }.items()
        )
        + " FROM points WHERE survey_year IN (2000, 2001)"
    ),
)
def _run_export_rotate(spark, sf_dir):
    """Incremental read, projection to x, y, z, rotation, CSV export, read back."""
    output = scratch_path(spark, "export")
    run_pipeline(
        spark,
        survey_table(spark, sf_dir).path,
        appended_between=(5, 7),
        columns=XYZ,
        operator="rotate",
        options={"angle": ANGLE},
        output=output,
    )
    return read_xyz(spark, output).select(*[F.round(c, 6).alias(c) for c in XYZ])
