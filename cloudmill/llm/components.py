"""Connected components of links that may form groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudmill.llm.common import saved

_FOLLOWED = 8  # rounds whose pointers are followed in one plan


def components(links: DataFrame, label: str = "components", known: DataFrame | None = None) -> DataFrame:
    """Nodes of ``links`` (bigint columns a, b) with a common ``root`` for all that are joined.

    ``known`` is what this function returned for earlier links, to which these are added: its
    groups are contracted first, so that only links between them take rounds, and its nodes are
    in the result too.

    Random contraction: in each round every node points at the neighbour, or itself, with the
    least hash; links move to where their ends point and vanish inside a point. Hashes change
    every second round: the first of two leaves a share of nodes in expectation, so rounds grow
    with the logarithm of the longest chain; the second joins what is left of a star, whose
    nodes all reach its least one in two steps. Minima are combined inside each task; each
    round is written to the shared folder, and the rounds' pointers are followed at the end.
    Nodes outside any link do not appear. The driver sees only whether links are left.
    """
    both = links.filter("a <> b").select("a", "b")
    if known is not None:
        for end in ("a", "b"):
            at = known.select(F.col("node").alias(end), F.col("root").alias("to"))
            other = "b" if end == "a" else "a"
            both = both.join(at, end, "left").select(F.coalesce("to", end).alias(end), other)
        both = both.filter("a <> b").select("a", "b")
    left = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    points = []
    while not left.isEmpty():
        seed = F.lit(len(points) // 2)
        least = left.groupBy("a").agg(
            F.min_by("b", F.xxhash64("b", seed)).alias("other"), F.min(F.xxhash64("b", seed)).alias("h")
        )
        own = F.xxhash64("a", seed)
        point = saved(
            least.select("a", F.when(F.col("h") < own, F.col("other")).otherwise(F.col("a")).alias("to")),
            label,
        )
        points.append(point)
        ends = point.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        left = saved(
            left.join(point, "a")
            .join(ends, "b")
            .filter("to <> to_b")
            .select(F.col("to").alias("a"), F.col("to_b").alias("b"))
            .distinct(),
            label,
        )
    if known is not None and not points:
        return known  # no link joins its groups or adds a node
    nodes = (points[0] if points else left).select(F.col("a").alias("node"), F.col("a").alias("root"))
    root = nodes if known is None else known.unionByName(nodes.join(known, "node", "left_anti"))
    for k, point in enumerate(points, 1):
        root = root.join(point.withColumnRenamed("a", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
        if k % _FOLLOWED == 0 and k < len(points):
            root = saved(root, label)
    return saved(root, label) if points else root
