"""Delimited point files: comma-separated, one point per line, optional header."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.schema import ALL_COLUMNS, LAYOUTS, RGB, WHOLE_NUMBERS, XYZ, point_schema

_LINE = "__pt_line"
_FIELDS = "__pt_fields"
_MALFORMED = "__pt_malformed"


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    columns=ALL_COLUMNS,
    default_rgb: float | None = None,
    whole_numbers: bool = False,
    corrupt_column: str | None = None,
) -> DataFrame:
    """Read every `*.csv` under `path`, at any depth, as points of the fixed schema.

    The number of fields tells which layout a line has (13, 15 or 16 columns), so files
    of different layouts may be mixed; columns a layout lacks are NULL. A header must
    name the columns of its layout in order, in any case: a file whose columns sit
    elsewhere is refused instead of shifted. Fields may be quoted.

    `default_rgb` fills colours that are absent. `whole_numbers` truncates the integer
    attributes toward zero. A line that fits no layout or does not parse fails the
    query, or is kept as text in `corrupt_column` beside NULLs.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(F.trim("value").alias(_LINE))
        .filter((F.length(_LINE) > 0) & _is_point(strict=corrupt_column is None))
    )
    parsed = lines.withColumns({_fields(n): _parsed(n) for n in LAYOUTS})
    held = {c: [n for n, names in LAYOUTS.items() if c in names] for c in ALL_COLUMNS}
    text = {c: F.coalesce(*[F.col(_fields(n))[c] for n in held[c]]) for c in ALL_COLUMNS}
    if corrupt_column is None:
        points = parsed.select(*[text[c].cast("double").alias(c) for c in columns])
    else:
        fits = [F.col(_fields(n)).isNotNull() & F.col(_fields(n))[_MALFORMED].isNull() for n in LAYOUTS]
        broken = ~reduce(lambda a, b: a | b, fits)
        for t in text.values():
            broken = broken | (t.isNotNull() & t.try_cast("double").isNull())
        points = parsed.select(
            *[text[c].try_cast("double").alias(c) for c in columns],
            F.when(broken, F.col(_LINE)).alias(corrupt_column),
        )
    changes = {}
    if whole_numbers:
        changes |= {c: F.col(c).cast("int").cast("double") for c in columns if c in WHOLE_NUMBERS}
    if default_rgb is not None:
        changes |= {
            c: F.coalesce(changes.get(c, F.col(c)), F.lit(float(default_rgb)))
            for c in columns
            if c in RGB
        }
    return points.withColumns(changes) if changes else points


def _is_point(strict: bool) -> Column:
    """False for a header of a known layout; a header of any other kind is an error.

    With `strict`, so is a line of a width no layout has. Being part of the row filter,
    the check holds whichever columns are read.
    """
    line = F.col(_LINE)
    header = line.rlike(r'^"?[A-Za-z_]') & ~F.lower(line).rlike("^(nan|inf)")
    known = F.lower(F.regexp_replace(line, r'["\s]', "")).isin(
        *[",".join(names).lower() for names in LAYOUTS.values()]
    )
    point = F.when(header & ~known, _refuse("header matches no known layout: ")).otherwise(~header)
    if strict:
        # Counted in the text: a filter on the parsed fields would parse twice. A quoted comma
        # is counted too, but a field that holds one is no number.
        fits = (_commas(line) + 1).isin(*LAYOUTS)
        quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
        point = F.when(~fits, _refuse("line has neither 13, 15 nor 16 fields: ")).otherwise(point)
        point = F.when(quotes % 2 == 1, _refuse("a quote is not closed: ")).otherwise(point)
    return point


def _refuse(reason: str) -> Column:
    return F.raise_error(F.concat(F.lit(reason), F.col(_LINE))).cast("boolean")


def _fields(width: int) -> str:
    return f"{_FIELDS}_{width}"


def _parsed(width: int) -> Column:
    """The fields of a line of this width as text, by Spark's CSV parser; else NULL."""
    schema = ", ".join(f"`{c}` string" for c in (*LAYOUTS[width], _MALFORMED))
    options = {
        "columnNameOfCorruptRecord": _MALFORMED,
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
    }
    return F.when(_commas(F.col(_LINE)) == width - 1, F.from_csv(_LINE, F.lit(schema), options))


def _commas(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Read headerless x,y,z files."""
    return spark.read.schema(point_schema(XYZ)).option("mode", "FAILFAST").csv(path)


def write_csv(
    df: DataFrame, path: str, *, header: bool = False, single_file: bool = False
) -> None:
    """Write CSV, replacing `path`. `single_file` makes one task write everything."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", str(header).lower()).csv(path)


def write_xyz(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Write only x, y, z."""
    write_csv(df.select(*XYZ), path, single_file=single_file)
