"""Point schemas. Column names and order of the delimited layouts."""

from pyspark.sql import types as T

XYZ = ("x", "y", "z")
RGB = ("red", "green", "blue")

# The twelve attributes every layout starts with.
CORE = (
    "x", "y", "z",
    "intensity", "returnNumber", "numberOfReturns",
    "scanDirectionFlag", "edgeOfFlightLine", "classification",
    "scanAngleRank", "userData", "pointSourceId",
)

# Columns of a delimited line, by its number of fields.
LAYOUTS = {
    13: CORE + ("gpsTime",),
    15: CORE + RGB,
    16: CORE + ("gpsTime",) + RGB,
}

ALL_COLUMNS = LAYOUTS[16]

# Attributes that are whole numbers in a LAS record.
WHOLE_NUMBERS = CORE[3:] + RGB


def point_schema(columns=ALL_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType(), True) for c in columns])
