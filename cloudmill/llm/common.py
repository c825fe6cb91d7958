"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.session import scratch_path

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD1342543DE82EF95)
    return h ^ (h >> np.uint64(32))


class Words:
    """All words of many texts at once, as ranges of one lower-cased byte array.

    A word is a run of bytes outside 0x20 and 0x09-0x0D; only A-Z are lower-cased.
    ``offsets[i]`` is the first word of text i (and its last entry the number of words).
    """

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.data = np.frombuffer((b" ".join(raw) + b" ").translate(_LOWER), np.uint8)
        white = _WHITE[self.data]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.offsets = np.searchsorted(self.starts, self.begins)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges, of the words by default.

        A polynomial over random byte values, read off prefix sums, then mixed: two different
        words share a hash with a chance of about 2**-64.
        """
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        powers, inverses = _powers(len(self.data))
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * powers[: len(self.data)], out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * inverses[starts]
        return mixed(h + (ends - starts).astype(np.uint64))


_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64, 256, np.uint64)
_tables: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) <= n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _tables[k] = np.full(size, base, dtype=np.uint64)
            _tables[k][0] = 1
            np.multiply.accumulate(_tables[k], out=_tables[k])
    return _tables


def chunks(texts: list[str | None], size: int) -> Iterator[slice]:
    """Slices with about ``size`` characters of text each, one text at least."""
    lengths = np.fromiter(((len(t) if t else 0) + 1 for t in texts), np.int64, len(texts))
    part = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        if b > a:
            yield slice(int(a), int(b))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    target: str,
    per_class: int,
    all_chars: int,
    text: str = "text",
) -> DataFrame:
    """Up to ``per_class`` labelled whole texts of each class to fit on: columns text, y.

    Only ids whose crc32 is not 1 modulo 3, present in both tables; those with the least hashed
    ids, so the choice is repeatable. The driver holds ``all_chars`` characters of each class:
    of the chosen rows, one that would go beyond is passed over.
    """
    spark = docs.sparkSession
    marks = (
        labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(target).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold("id", 3) != 1))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).alias("text"))
    present = texts.filter(F.col("text").isNotNull())
    lengths = present.select("id", F.length("text").alias("n"))  # texts are not shuffled
    known = saved(lengths.join(marks, "id").groupBy("id", "y").agg(F.max("n").alias("n")), "labelled")
    chosen = []
    for y in (0, 1):
        ranked = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        left = all_chars
        for r in ranked.collect():
            if r["n"] <= left:
                left -= r["n"]
                chosen.append((r["id"], y))
    chosen_ids = F.broadcast(spark.createDataFrame(chosen, "id bigint, y int"))  # 2 * per_class rows
    return present.join(chosen_ids, "id").dropDuplicates(["id"]).select("id", "text", "y")
