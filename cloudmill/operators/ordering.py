"""Total orders, ranks and bounded top-n over a whole DataFrame."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudmill.schema import XYZ
from cloudmill.session import scratch_path

# Up to this many rows may be sorted in one task (a top-k); beyond it, ranks are global.
TOP_K_ROWS = 1_000_000

PART = "__pt_part"
LOCAL = "__pt_local"
INDEX = "__pt_index"
_TIE = "__pt_tie"
_PATH = "__pt_path"
_START = "__pt_start"

# Order of the rows in their files, for `uniform_sample`.
STORED = "stored"
# Paths and offsets of this many files are some tens of megabytes.
BROADCAST_FILES = 200_000


def ordering_columns(df: DataFrame, first=XYZ) -> list[Column]:
    """All columns as one total order, `first` leading. Equal rows are interchangeable."""
    lead = [c for c in first if c in df.columns]
    return [F.col(f"`{c}`") for c in lead + [c for c in df.columns if c not in lead]]


def take_smallest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The `n` least rows by `order`, whatever the size of `n`."""
    if n <= TOP_K_ROWS:
        return df.orderBy(*order).limit(n)
    ranked, _ = with_global_index(df, order)
    return ranked.filter(F.col(INDEX) < n).drop(INDEX)


def with_global_index(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """Add the 0-based rank of every row under `order`; also return the row count.

    Range partitioning spreads the rows; each task then numbers its own, and the
    offsets come from one count per partition. The numbered rows are written to the
    scratch folder: range bounds are sampled, so computing them twice could disagree.

    A group of equal rows of any size is split over tasks by a tie-breaker. The local
    sort before it makes the tie-breaker a function of the partition's content, so
    that a retried task assigns the same values.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    (
        df.sortWithinPartitions(*order)
        .withColumn(_TIE, F.monotonically_increasing_id())
        .repartitionByRange(*order, _TIE)
        .sortWithinPartitions(*order)
        .drop(_TIE)
        .withColumns({PART: F.spark_partition_id(), LOCAL: _position_in_partition()})
        .write.option("compression", "lz4").parquet(path)
    )
    numbered = spark.read.parquet(path)
    sizes = numbered.groupBy(PART).agg(F.count("*").alias("rows")).orderBy(PART).collect()
    starts, total = [0] * (sizes[-1][PART] + 1 if sizes else 0), 0
    for size in sizes:
        starts[size[PART]] = total
        total += size["rows"]
    offset = F.element_at(F.lit(starts or [0]), F.col(PART) + 1)
    ranked = numbered.withColumn(INDEX, offset.cast("bigint") + F.col(LOCAL)).drop(PART, LOCAL)
    return ranked, total


def with_stored_index(df: DataFrame) -> tuple[DataFrame, int]:
    """Add the 0-based position of each row over all parquet files of `df`, in path order.

    A row's position is its index in its file plus the rows of the files before, so it
    depends neither on how files are split into tasks nor on retries. The first pass
    reads no column; the second adds the offsets by a broadcast of one row per file.
    """
    located = df.withColumns(
        {_PATH: F.col("_metadata.file_path"), LOCAL: F.col("_metadata.row_index")}
    )
    files = (
        located.groupBy(_PATH)
        .agg(F.count("*").alias("rows"), F.max(LOCAL).alias("last"))
        .orderBy(_PATH)
        .toArrow()
    )
    rows = files["rows"].to_numpy()
    if (files["last"].to_numpy() + 1 != rows).any():
        raise ValueError("stored positions need a table without filters")
    ends = rows.cumsum()
    starts = pa.table({_PATH: files[_PATH], _START: pa.array(ends - rows, pa.int64())})
    offsets = df.sparkSession.createDataFrame(starts)
    if len(rows) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    ranked = located.join(offsets, _PATH).withColumn(INDEX, F.col(_START) + F.col(LOCAL))
    return ranked.drop(_PATH, _START, LOCAL), int(ends[-1]) if len(ends) else 0


def _position_in_partition() -> Column:
    """The generated id holds the partition in its upper 31 bits, the position below."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
