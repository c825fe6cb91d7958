"""Deterministic "first row of each group"."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Groups whose least value is sent to every task: about a hundred megabytes.
BROADCAST_GROUPS = 1 << 20

_ROW = "__pt_row"
_LEAD = "__pt_lead"
_LEAST = "__pt_least"
_ABSENT = "__pt_absent"
_FIXED_SIZE = T.NumericType | T.BooleanType | T.DateType | T.TimestampType


def least_row_per_group(df: DataFrame, keys, order: list[Column], *, at_most: int) -> DataFrame:
    """The least row by `order` (a total order over the columns to keep) of each group.

    A minimum is combined within every task before the shuffle, so each task sends one
    row per group and no group can be too big, unlike a window or a grouped map.

    `at_most` bounds the number of groups. While they can be broadcast, the least of the
    leading order column is found first, in a hash aggregate over that column alone; whole
    rows are compared only where they reach it. Beyond that, minima of whole rows are taken
    at once, which sorts the rows of every task.
    """
    lead = order[0]
    if at_most <= BROADCAST_GROUPS and isinstance(_type(df, lead), _FIXED_SIZE):
        led = df.withColumn(_LEAD, lead)
        least = led.groupBy(*[F.col(k).alias(f"{_LEAST}{k}") for k in keys]).agg(
            F.min(_LEAD).alias(_LEAST), F.bool_or(F.col(_LEAD).isNull()).alias(_ABSENT)
        )
        # NULL comes first.
        first = F.when(~F.col(_ABSENT), F.col(_LEAST))
        least = F.broadcast(least.withColumn(_LEAST, first).drop(_ABSENT))
        same = [F.col(k).eqNullSafe(F.col(f"{_LEAST}{k}")) for k in keys]
        same.append(F.col(_LEAD).eqNullSafe(F.col(_LEAST)))
        df = led.join(least, reduce(lambda a, b: a & b, same), "left_semi")
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias(_ROW)).select(f"{_ROW}.*")


def _type(df: DataFrame, column: Column) -> T.DataType:
    return df.select(column.alias(_LEAD)).schema[_LEAD].dataType
