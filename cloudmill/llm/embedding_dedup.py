"""Near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import saved, table
from cloudmill.llm.components import components

_SLACK = 1e-6  # single precision in blocks; the exact check follows in double precision


def _rotation(size: int, seed: int = 11) -> np.ndarray:
    """A fixed random rotation; it spreads any direction evenly over the blocks."""
    rng = np.random.Generator(np.random.PCG64([seed, size]))
    q, r = np.linalg.qr(rng.standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def near_pairs(
    vectors: DataFrame,
    threshold: float = 0.98,
    block_size: int = 8,
    cell_dims: int = 4,
    cell_width: float = 2.0,
) -> DataFrame:
    """Pairs (a < b) of rows (id, label, unit) with equal labels and cosine >= ``threshold``.

    Unit vectors with that cosine are at most d**2 = 2 - 2 * threshold apart, squared. A
    rotated pair is cut into blocks of ``block_size`` numbers; in at least one block it must
    keep within the block's proportional share of d**2, else the blocks would sum to more.
    Each block is range-joined on its own: its first ``cell_dims`` numbers lie in a grid of
    cells ``cell_width`` block radii wide. A vector is at home in one cell and visits the
    cells, at or behind its own, that its radius touches; visitors meet residents, and the
    whole block must keep the budget. The union of all blocks' pairs is verified exactly in
    double precision.
    """
    budget = 2 - 2 * threshold

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["unit"].map(len)
            for size, rows in batch.groupby(sizes.to_numpy()):
                units = np.array(rows["unit"].tolist(), dtype=np.float64).reshape(len(rows), size)
                turned = units @ _rotation(size)
                for k, at in enumerate(range(0, size, block_size)):
                    part = turned[:, at : at + block_size]
                    radius = np.sqrt(budget * part.shape[1] / size) + _SLACK
                    held = np.zeros((len(rows), block_size), np.float32)
                    held[:, : part.shape[1]] = part
                    grid = part[:, :cell_dims] / (cell_width * radius)
                    reach = 1 / cell_width
                    home = np.floor(grid).astype(np.int64)
                    low, high = np.floor(grid - reach), np.floor(grid + reach)
                    low, high = low.astype(np.int64), high.astype(np.int64)
                    steps = range(int(np.ceil(2 * reach)) + 1)
                    for way in product(steps, repeat=grid.shape[1]):
                        cell = low + np.array(way, dtype=np.int64)
                        is_home = (cell == home).all(axis=1)
                        first = np.argmax(cell != home, axis=1)
                        ahead = np.take_along_axis(cell - home, first[:, None], axis=1)[:, 0] > 0
                        go = np.flatnonzero((cell <= high).all(axis=1) & (is_home | ahead))
                        if not len(go):
                            continue
                        key = np.full(len(go), size * 1009 + k, dtype=np.uint64)
                        for c in cell[go].T:
                            key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(29)
                        out = {
                            "id": rows["id"].to_numpy()[go],
                            "label": rows["label"].to_numpy()[go],
                            "cell": key.astype(np.int64),
                            "part": np.full(len(go), (size << 16) + k, dtype=np.int64),
                            "home": is_home[go],
                            "room": np.full(len(go), radius * radius, np.float32),
                        }
                        out |= {f"x{d}": held[go, d] for d in range(block_size)}
                        yield pd.DataFrame(out)

    fields = ", ".join(f"x{d} float" for d in range(block_size))
    schema = f"id bigint, label bigint, cell bigint, part bigint, home boolean, room float, {fields}"
    blocks = saved(vectors.mapInPandas(cut, schema), "blocks")
    keys = ["label", "cell", "part"]
    residents = blocks.filter("home").select(*keys, F.col("id").alias("a"), *(F.col(f"x{d}").alias(f"r{d}") for d in range(block_size)))
    visitors = blocks.select(*keys, F.col("id").alias("b"), "home", "room", *(f"x{d}" for d in range(block_size)))
    apart = " + ".join(f"(x{d} - r{d}) * (x{d} - r{d})" for d in range(block_size))
    meet = (
        visitors.join(residents, keys)
        .filter(f"(not home or b < a) and a <> b and {apart} <= room")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    ends = vectors.select("id", "unit")
    dot = F.aggregate(
        F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )
    return (
        meet.join(ends.select(F.col("id").alias("a"), F.col("unit").alias("u")), "a")
        .join(ends.select(F.col("id").alias("b"), F.col("unit").alias("v")), "b")
        .filter(dot >= threshold)
        .select("a", "b")
    )


def dedup_embeddings(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    **blocks,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    n_links counts the other rows linked directly (equal labels, cosine >= ``threshold``);
    component_id is the least id reachable by links, itself included; kept marks that row.
    Rows with equal label and vector are one class for the join and counted afterwards, so a
    vector that fills a third of the table costs one row, not all pairs.

    Defined results: a null label, and a vector that is null, empty, zero or holds a null or
    non-finite number, links with nothing. Vectors of different lengths do not link. Repeated
    ids link like any other rows. A null id has a null component unless it is linked. An empty
    table gives an empty one. Other columns are ignored.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), x.alias("x")
    )
    high = F.array_max(F.transform("x", lambda v: F.abs(v)))
    sound = (
        F.col("label").isNotNull()
        & (F.size("x") > 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & (high > 0)
    )
    scaled = F.transform("x", lambda v: v / high)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn(
        "x", F.when(F.col("sound"), scaled)
    )
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v))
    rows = rows.withColumn("unit", F.transform("x", lambda v: v / size + F.lit(0.0))).drop("x")
    rows = rows.withColumn("class", F.when(F.col("sound"), F.sha2(F.to_json(F.struct("label", "unit")), 256)))
    rows = saved(rows, "units")
    classes = saved(
        rows.filter("sound")
        .groupBy("class")
        .agg(
            F.min("id").alias("least"),
            F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"),
            F.first("unit").alias("unit"),
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "unit-classes",
    )
    pairs = saved(near_pairs(classes.select("id", "label", "unit"), threshold, **blocks), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("id").alias("b"), "copies")
    linked = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("links"))
    found = (
        classes.join(linked, F.col("id") == F.col("a"), "left")
        .join(components(pairs).select(F.col("node").alias("id"), "root"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    found = saved(
        found.select("class", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")),
        "class-links",
    )
    roots = found.groupBy("root").agg(F.min("least").alias("component"))
    found = found.join(roots, "root").select("class", "links", "component")
    return rows.join(found, "class", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component", "id")).alias("kept"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings"))
