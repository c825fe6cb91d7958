"""Line dedup: documents probe a sharded minimal perfect hash of the lines that repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import saved, table
from cloudmill.llm.perfect_hash import PerfectHash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = " \t\n\x0b\x0c\r"
_LINES = 500_000  # lines of a task that are held before they are handed on
_ROW = 512  # probes in one row: ten thousand rows, an Arrow batch, take about 140 MB
_PROBE = np.dtype([("h", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("salt", "<i8")])
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split(" ") for x in ddl.split(", "))])


def _batch(ddl: str, *columns) -> pa.RecordBatch:
    """A batch of numpy arrays or lists, in the order of ``ddl``."""
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _key(line: str, min_chars: int) -> bytes | None:
    """128 bits of a line's key, None for one that is too short."""
    line = line.strip(_BLANK)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(line.encode().translate(_LOWER), digest_size=16).digest()


def _identified(docs: DataFrame, id_column: str, text: str) -> list[Column]:
    """The id (the largest possible one for null), the text, and a salt that parts rows of one id."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [
        F.coalesce(F.col(id_column).cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"),
        body.alias("body"),
        F.crc32(body.cast("binary")).alias("salt"),
    ]


def _keys_of(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    """The distinct keys of each document, for some documents at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        digests: list[bytes] = []
        docs: list[int] = []
        salts: list[int] = []
        sizes: list[int] = []

        def flush() -> np.ndarray:
            out = np.empty(len(digests), _PROBE)
            both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            out["h"], out["print"] = both[:, 0], both[:, 1]
            out["doc"], out["salt"] = np.repeat(docs, sizes), np.repeat(salts, sizes)
            for held in (digests, docs, salts, sizes):
                held.clear()
            return out

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc", "body", "salt")), strict=True)
            for doc, body, salt in rows:
                found = {_key(line, min_chars) for line in body.split("\n")}
                found.discard(None)
                digests.extend(found)
                docs.append(doc)
                salts.append(salt)
                sizes.append(len(found))
                if len(digests) >= _LINES:
                    yield flush()
        if digests:
            yield flush()

    return read


def index_lines(
    docs: DataFrame,
    min_chars: int = 10,
    shard_keys: int = 4_000_000,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """A sharded perfect hash of the keys that at least two documents hold.

    Each row is a shard of about ``shard_keys`` keys, and at least one shard for each shuffle
    partition: shard, hash (a PerfectHash), prints (64 bits of each key, by slot), counts (rows
    that hold it) and first (the least doc_id that does). Keys are pre-aggregated in each task,
    so that a line found everywhere is a row of each task, no more.
    """
    spark = docs.sparkSession
    keys_of = _keys_of(min_chars)
    fields = "h bigint, print bigint, doc bigint"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in keys_of(batches):
            yield _batch(fields, found["h"].view("<i8"), found["print"].view("<i8"), found["doc"])

    repeated = saved(
        docs.select(*_identified(docs, id_column, text))
        .mapInArrow(keys, fields)
        .groupBy("h", "print")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("doc").alias("n"))
        .filter("first <> last")
        .drop("last"),
        "repeated-lines",
    )
    shards = max(-(-repeated.count() // shard_keys), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = "shard int, shards int, hash binary, prints binary, counts binary, first binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in ("h", "print", "first", "n", "shard")] for b in batches if len(b)]
        if not held:
            return
        h, prints, first, n, shard = (np.concatenate(c) for c in zip(*held, strict=True))
        h, prints = h.view("<u8"), prints.view("<u8")
        # Two keys may agree in h, the prints tell them apart: hash both then.
        seed = 0
        while len(np.unique(_probe_keys(h, prints, seed))) < len(h):
            seed += 1
        perfect = PerfectHash.build(_probe_keys(h, prints, seed))
        at = np.argsort(perfect.slots(_probe_keys(h, prints, seed)))
        blob = seed.to_bytes(8, "little") + perfect.to_bytes()
        yield _batch(
            out, [int(shard[0])], [shards], [blob], [prints[at].tobytes()],
            [np.minimum(n[at], 2**32 - 1).astype("<u4").tobytes()], [first[at].astype("<i8").tobytes()],
        )

    dealt = repeated.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return saved(dealt.repartitionById(shards, F.col("shard")).mapInArrow(build, out), "line-index")


def _probe_keys(h: np.ndarray, prints: np.ndarray, seed: int) -> np.ndarray:
    return h + prints * np.uint64(seed)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 10,
    shard_keys: int = 4_000_000,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Drop lines that stand in an earlier document: doc_id, text (kept lines), n_lines, n_dropped.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that two documents or more hold lose all their lines except in the
    document with the least id; there, and for other keys, all lines stay, joined by a line feed.

    Keys are told apart by 128 bits of a hash. Those that repeat are indexed (``index_lines``).
    Documents probe: the keys of a task's documents go, packed, to the task of their shard, which
    holds that shard's arrays alone and answers with the keys that a document loses. A shard's
    arrays have a bounded size; there are more shards, not larger ones, for more text. A key
    that one task's documents hold very often is still one probe for each document.

    Defined results: a null or empty text is one empty line, which stays. A null doc_id counts
    as the largest possible one, and all such rows as one document, as do rows that share an
    id; repeated rows thus lose nothing to each other. An empty table gives an empty one. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    index = index_lines(docs, min_chars, shard_keys, text, id_column)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = index.agg(F.max("shards")).first()[0] or partitions  # no row: no line repeats
    keys_of = _keys_of(min_chars)
    asked = "shard int, probes binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in keys_of(batches):
            shard = found["h"].view("<i8") % shards
            order = np.argsort(shard, kind="stable")
            found, shard = found[order], shard[order]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            edges = np.concatenate(([0], cuts, [len(shard)]))
            spans = [(i, min(i + _ROW, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) for i in range(a, b, _ROW)]
            yield _batch(asked, [int(shard[a]) for a, _ in spans], [found[a:b].tobytes() for a, b in spans])

    lost = "doc bigint, salt bigint, h bigint"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one shard: first its arrays, then all probes."""
        perfect = None
        for batch in batches:
            probes = []
            for row in batch.to_pylist():
                if row["hash"] is not None:
                    seed = int.from_bytes(row["hash"][:8], "little")
                    perfect = PerfectHash.from_bytes(row["hash"][8:])
                    prints = np.frombuffer(row["prints"], "<u8")
                    first = np.frombuffer(row["first"], "<i8")
                elif perfect is not None:
                    probes.append(row["probes"])
            if not probes:
                continue
            asks = np.frombuffer(b"".join(probes), _PROBE)
            slot = perfect.slots(_probe_keys(asks["h"], asks["print"], seed))
            asks, slot = asks[slot >= 0], slot[slot >= 0]
            gone = (prints[slot] == asks["print"]) & (first[slot] != asks["doc"])
            asks = asks[gone]
            yield _batch(lost, asks["doc"], asks["salt"], asks["h"].view("<i8"))

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), *_identified(docs, id_column, text))
    probes = rows.select("doc", "body", "salt").mapInArrow(ask, asked)
    arrays = index.select("shard", F.lit(None).cast("binary").alias("probes"), "hash", "prints", "first")
    met = (
        arrays.unionByName(probes, allowMissingColumns=True)
        .withColumn("later", F.col("hash").isNull())
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("later")
        .drop("later")
    )
    gone = (
        met.mapInArrow(answer, lost)
        .groupBy("doc", "salt")  # the keys that one text, or its copies under one id, lose
        .agg(F.collect_set("h").alias("gone"))
    )
    kept = "doc_id bigint, text string, n_lines bigint, n_dropped bigint"

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, counts, dropped = batch.column("doc_id"), [], [], []
            for body, lose in zip(batch.column("body").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines = body.split("\n")
                counts.append(len(lines))
                if lose:
                    heads = {h.to_bytes(8, "little", signed=True) for h in lose}
                    lines = [x for x in lines if (_key(x, min_chars) or b"")[:8] not in heads]
                    body = "\n".join(lines)
                texts.append(body)
                dropped.append(counts[-1] - len(lines))
            yield _batch(kept, ids, texts, counts, dropped)

    both = rows.join(gone, ["doc", "salt"], "left").select("doc_id", "body", "gone")
    return both.mapInArrow(drop, kept)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k
    from documents
),
keyed as (
    select doc_id, k, line, translate(
        trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
),
repeated as (
    select key, min(doc_id) as first from keyed where length(key) >= 10
    group by key having count(distinct doc_id) > 1
),
marked as (
    select doc_id, k, line, r.first is not null and r.first <> doc_id as gone
    from keyed left join repeated r using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by k) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
