"""Target-distribution importance resampling, drawn by parallel sorting by regular sampling."""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudmill.llm.common import chunks, saved, table

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PART = np.zeros(256, dtype=bool)  # bytes of words: digits, letters, and all beyond ASCII
_PART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CHUNK = 1_000_000  # characters read at a time
_GRAMS = 1_000_000  # words whose runs are hashed at a time
_SHORT = 64  # longer words are hashed one by one
_SLICES = 25  # parts in which bucket counts are added up
_RUNS = 512  # runs, and segments, at most


def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    return step


_STEP = _crc_table()


def _shifts() -> np.ndarray:
    """What n zero bytes make of a state, by n and by each byte of the state."""
    out = np.zeros((_SHORT + 2, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, len(out)):
        out[n] = _STEP[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


_SHIFT = _shifts()
_ONES = np.uint32(0xFFFFFFFF)


def _advanced(state: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """A checksum's state after so many zero bytes; it is linear in the state."""
    out = _SHIFT[zeros, 0, state & 0xFF]
    for k in (1, 2, 3):
        out ^= _SHIFT[zeros, k, (state >> np.uint32(8 * k)) & 0xFF]
    return out


class WordRuns:
    """The words of many texts, and the CRC-32 of each run of one to three words of a text.

    The checksum of a run follows from its words' own checksums: state and zero bytes for the
    next word, then the word. So each byte is read once, whatever the number of runs.
    """

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode("utf-8") for t in texts]
        self.data = np.frombuffer((b" ".join(raw) + b" ").translate(_LOWER), np.uint8)
        inside = np.concatenate(([False], _PART[self.data]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.offsets = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes))))
        self.n_words = np.diff(self.offsets)
        self.n_features = sum(np.maximum(self.n_words - k, 0) for k in range(3))

    def checksums(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Text number and checksum of all runs: (words a run, text numbers, checksums)."""
        text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        for a in range(0, len(self.starts), _GRAMS):
            b = min(a + _GRAMS, len(self.starts))
            more = min(b + 2, len(self.starts))
            starts, ends = self.starts[a:more], self.ends[a:more]
            sizes = ends - starts
            long = sizes > _SHORT
            own = self._word_states(starts, np.where(long, 0, sizes))
            zeros = np.where(long, 0, sizes)
            state = _advanced(np.full(more - a, _ONES), zeros) ^ own
            self._redo(state, starts, ends, 1, long)
            yield 1, text[a:b], state[: b - a] ^ _ONES
            spaced = _STEP[(np.uint32(0x20))]
            for words in (2, 3):
                last = slice(words - 1, None)
                n = max(0, more - a - words + 1)
                # A space and a word after the run so far: the space's byte, then the word's.
                ahead = _advanced(state[:n], zeros[last] + 1) ^ _advanced(np.full(n, spaced), zeros[last]) ^ own[last]
                touched = np.zeros(n, dtype=bool)
                for k in range(words):
                    touched |= long[k : n + k]
                self._redo(ahead, starts, ends, words, touched)
                state = ahead
                same = text[a : a + n] == text[a + words - 1 : a + words - 1 + n]
                same[b - a :] = False  # of the next block
                yield words, text[a : a + n][same], state[same] ^ _ONES

    def _word_states(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each word's checksum state, begun with zero."""
        order = np.argsort(-sizes.astype(np.int16), kind="stable")
        at, left = starts[order], sizes[order]
        state = np.zeros(len(order), dtype=np.uint32)
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k))  # words longer than k
            state[:n] = _STEP[(state[:n] ^ self.data[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
        out = np.empty_like(state)
        out[order] = state
        return out

    def _redo(self, state: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int, where: np.ndarray) -> None:
        """Runs that hold a long word, hashed from their bytes."""
        for i in np.flatnonzero(where):
            parts = [self.data[starts[i + k] : ends[i + k]].tobytes() for k in range(words)]
            state[i] = zlib.crc32(b" ".join(parts)) ^ 0xFFFFFFFF


def bucket_counts(texts: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; one array reaches the driver."""
    width = -(-buckets // _SLICES)
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def packed(counts: np.ndarray) -> pa.RecordBatch:
        rows = [c.astype("<i8").tobytes() for c in counts]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], schema=schema
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width * _SLICES, dtype=np.int64)
        for batch in batches:
            bodies = batch.column("text").to_pylist()
            for part in chunks(bodies, _CHUNK):
                for _, _, crc in WordRuns(bodies[part]).checksums():
                    counts += np.bincount(crc % np.uint32(buckets), minlength=len(counts))
        yield packed(counts.reshape(_SLICES, width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, "<i8")
        rows = [s.astype("<i8").tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    parts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "part int, counts binary")
    total = np.zeros((_SLICES, width), dtype=np.int64)
    for r in parts.repartition("part").mapInArrow(add, "part int, counts binary").collect():
        total[r["part"]] += np.frombuffer(r["counts"], "<i8")
    return total.reshape(-1)[:buckets]


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n))))
            for a, b in zip(corpus, target, strict=True)
        ],
        dtype=np.int64,
    )


def _noise(seed: int, doc: int | None) -> int:
    """Thousandths of a Gumbel draw that is a function of seed and id."""
    name = f"{seed}:{'' if doc is None else doc}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def importance_weights(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    seed: int = 42,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs``.

    Features are all runs of one to three words, hashed into ``buckets``. A feature's gain is the
    log ratio of its bucket's share in ``target`` to that in ``docs``; weight is the sum of a
    text's gains, score adds a Gumbel draw, so that the highest scores are a sample without
    replacement in proportion to exp(weight / 1000).

    The counts of all texts are arrays of fixed size; they and the gains are all that leaves a
    task but a row for each document.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, text), bucket_counts(target, buckets, "text"))
    held = docs.sparkSession.sparkContext.broadcast(gains)  # 8 bytes a bucket
    fields = [(x.split(" ")[0], pa.int64()) for x in _SCORED.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in chunks(bodies, _CHUNK):
                runs = WordRuns(bodies[part])
                weight = np.zeros(len(runs.n_words), dtype=np.int64)
                for _, owner, crc in runs.checksums():
                    if not len(owner):
                        continue
                    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    weight[owner[first]] += np.add.reduceat(held.value[crc % np.uint32(buckets)], first)
                noise = np.array([_noise(seed, i) for i in ids[part]], dtype=np.int64)
                columns = [ids[part], runs.n_words, runs.n_features, weight, weight + noise]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], schema=pa.schema(fields)
                )

    source = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    return source.mapInArrow(score, _SCORED)


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]


def _sort_key(score: int, doc: int | None, run: int, place: int) -> tuple:
    return -score, doc is None, doc or 0, run, place


def ranked(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` with their rank by score, then doc_id, for ranks up to ``first``; else null.

    Parallel sorting by regular sampling. Each task sorts its run and gives regular samples, once
    to twice as many as there are segments; the samples, half a million at most, give regular
    splitters, so that no segment holds more than about twice the mean. A row's segment follows from its
    run. Counts of the segments, added up, say where each segment's ranks begin. Segments that
    begin after ``first`` are not exchanged. The others are merged, each in a task, and numbered
    from where they begin. Rows that agree in all columns are told apart by run and place, so
    any number of them is split like other rows.

    ``rows`` must be stored: its runs are read twice.
    """
    spark = rows.sparkSession
    segments = min(_RUNS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = rows.coalesce(_RUNS).sortWithinPartitions(*_order())
    fields = "score bigint, doc_id bigint, run int, place bigint"

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        # Regular samples of a run whose length is not known yet: keep every step-th row, and
        # double the step, dropping every other one, when there are twice as many as asked for.
        kept: list[tuple] = []
        step, place = 1, 0
        for batch in batches:
            for score, doc in zip(batch.column("score").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if place % step == 0:
                    kept.append((score, doc, run, place))
                    if len(kept) == 2 * segments:
                        kept, step = kept[::2], 2 * step
                place += 1
        columns = list(zip(*kept, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array([step] * len(kept), pa.int64())],
            names=["score", "doc_id", "run", "place", "step"],
        )

    samples = runs.select("score", "doc_id").mapInArrow(sample, f"{fields}, step bigint").collect()
    samples = sorted((_sort_key(r["score"], r["doc_id"], r["run"], r["place"]), r["step"]) for r in samples)
    before = np.cumsum([0, *(step for _, step in samples)])  # a sample stands for its step
    cuts = [bisect_left(before, before[-1] * k / segments) for k in range(1, segments)]
    splitters = spark.sparkContext.broadcast(sorted({samples[c][0] for c in cuts if c < len(samples)}))

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = [
                _sort_key(s, d, run, place + k)
                for k, (s, d) in enumerate(
                    zip(batch.column("score").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
                )
            ]
            edges = [bisect_left(keys, s) for s in splitters.value]  # rows below each splitter
            segment = np.searchsorted(edges, np.arange(len(keys)), side="right")
            more = [pa.array(segment, pa.int32()), pa.array([run] * len(keys), pa.int32()),
                    pa.array(range(place, place + len(keys)), pa.int64())]
            place += len(keys)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *more], names=[*batch.schema.names, "segment", "run", "place"]
            )

    columns = ", ".join(f"`{n}` {t}" for n, t in runs.dtypes)
    dealt = saved(runs.mapInArrow(exchange, f"{columns}, segment int, run int, place bigint"), "segments")
    begins, total = [], 0
    for r in dealt.groupBy("segment").count().orderBy("segment").collect():  # a row for each segment
        begins.append((r["segment"], total))
        total += r["count"]
    needed = {s: b for s, b in begins if b < first}
    wanted = F.col("segment").isin(*needed) if needed else F.lit(False)
    offset = F.create_map(*(F.lit(x) for s, b in needed.items() for x in (s, b))) if needed else None
    if not needed:
        return dealt.select(*rows.columns, F.lit(None).cast("bigint").alias("rank"))
    inside = Window.partitionBy("segment").orderBy(*_order(), "run", "place")
    rank = F.row_number().over(inside) + F.element_at(offset, F.col("segment"))
    drawn = dealt.filter(wanted).select(*rows.columns, rank.cast("bigint").alias("rank"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= first, F.col("rank")))
    rest = dealt.filter(~wanted).select(*rows.columns, F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    buckets: int = 10_000,
    seed: int = 42,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Draw ``percent`` % of the documents so that they look like ``target`` (column text).

    Of the N documents with at least ``min_words`` words, the floor(percent * N / 100) highest
    scores are drawn (see ``importance_weights``), ties to the least doc_id. Returns every row:
    doc_id, n_words, n_features, weight, score, rank (from 1; null for those not drawn).

    Defined results: a null, empty or word-less text has no features and weight 0; a null id is
    hashed as an empty one and comes last among ties; repeated rows are drawn each on its own;
    an empty target gives gains from the corpus alone; an empty table gives an empty one. Other
    columns are ignored.
    """
    scored = saved(importance_weights(docs, target, buckets, seed, text, id_column), "scored")
    enough = scored.filter(F.col("n_words") >= min_words)
    short = scored.filter(F.col("n_words") < min_words)
    drawn = ranked(enough, percent * enough.count() // 100)
    return drawn.unionByName(short.withColumn("rank", F.lit(None).cast("bigint")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
