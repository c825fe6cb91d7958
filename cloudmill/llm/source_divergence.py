"""Source divergence audit: terms recounted in dense slots of broadcast perfect hashes."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudmill.llm.common import saved, table
from cloudmill.llm.perfect_hash import PerfectHash

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}  # bytes of terms
_TERMS = bytes((b + 32 if b < 0x5B else b) if b in _LETTERS else 32 for b in range(256))
_HELD = 250_000  # terms of a task that are counted before they are handed on
_CELLS = 1 << 24  # counts that a task holds in dense slots before they are handed on
_SLICE = 1024  # terms compared at a time: 8 KB for each source of the language
_MATRIX = 1 << 20  # pairs of sources that a task adds up before they are handed on

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(ddl: str, *columns) -> pa.RecordBatch:
    schema = pa.schema([(n, _ARROW[t]) for n, t in (x.split(" ") for x in ddl.split(", "))])
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _by_key(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Sorted rows, group by group."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: tuple(row[n] for n in names))


def terms_of(text: str) -> list[bytes]:
    """A text's terms: runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_TERMS).split()


def _packed(counts: np.ndarray) -> tuple[int, bytes]:
    """Counts in the least width that holds them, compressed; and that width."""
    width = next(w for w in (1, 2, 4, 8) if counts.max(initial=0) < 1 << (8 * w - 1))
    return width, zlib.compress(counts.astype(f"<i{width}").tobytes(), 1)


def _unpacked(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), f"<i{width}").astype(np.int64)


class TermShard:
    """Terms of one language with a slot each, stored so that a probe can be verified."""

    def __init__(self, seed: int, perfect: PerfectHash, keys: bytes, ends: np.ndarray) -> None:
        self.seed, self.perfect, self.keys, self.ends = seed, perfect, keys, ends

    def __len__(self) -> int:
        return len(self.ends)

    @classmethod
    def build(cls, terms: list[bytes]) -> TermShard:
        seed = 0
        while len(hashes := {xxhash.xxh3_64_intdigest(t, seed) for t in terms}) < len(terms):
            seed += 1  # two terms share a hash
        del hashes
        keys = cls._hashed(terms, seed)
        perfect = PerfectHash.build(keys)
        placed = [terms[i] for i in np.argsort(perfect.slots(keys))]
        ends = np.cumsum([len(t) for t in placed], dtype=np.int64)
        return cls(seed, perfect, b"".join(placed), ends)

    @staticmethod
    def _hashed(terms: list[bytes], seed: int) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(t, seed) for t in terms], dtype=np.uint64)

    def term(self, slot: int) -> bytes:
        return self.keys[self.ends[slot - 1] if slot else 0 : self.ends[slot]]

    def slots(self, terms: list[bytes]) -> np.ndarray:
        """Each term's slot, -1 for a term that is not stored here."""
        slots = self.perfect.slots(self._hashed(terms, self.seed))
        for i, (term, slot) in enumerate(zip(terms, slots.tolist(), strict=True)):
            if slot >= 0 and self.term(slot) != term:
                slots[i] = -1
        return slots

    def to_bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.seed.to_bytes(8, "little") + self.perfect.to_bytes(), self.keys, self.ends.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, keys: bytes, ends: bytes) -> TermShard:
        seed = int.from_bytes(data[:8], "little")
        return cls(seed, PerfectHash.from_bytes(data[8:]), keys, np.frombuffer(ends, "<i8"))


def _texts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    names = {"lang": lang, "source": source, "text": text}
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in names.items()))


def frequent_terms(texts: DataFrame, min_docs: int) -> DataFrame:
    """lang, term of all terms that at least ``min_docs`` rows of their language hold: an exact count."""
    fields = "lang string, term string, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, t.decode(), n) for lang, c in held.items() for t, n in c.items()]
            held.clear()
            return _batch(fields, *(zip(*rows, strict=True) if rows else ([], [], [])))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(set(terms_of(text)))
                if sum(map(len, held.values())) >= _HELD:
                    yield flush()
        yield flush()

    counted = texts.select("lang", "text").mapInArrow(count, fields)
    total = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return saved(total.filter(F.col("n") >= min_docs).select("lang", "term"), "frequent-terms")


_INDEX = "lang string, shard int, shards int, hash binary, keys binary, ends binary, bytes bigint"


def index_terms(terms: DataFrame, shard_terms: int) -> DataFrame:
    """Shards of each language's terms, each about ``shard_terms``: a TermShard a row."""
    shards = terms.groupBy("lang").agg(F.ceil(F.count("term") / shard_terms).cast("int").alias("shards"))
    shard = F.pmod(F.crc32(F.col("term").cast("binary")), F.col("shards")).cast("int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, at, n), rows in _by_key(batches, "lang", "shard", "shards"):
            parts = TermShard.build([r["term"].encode() for r in rows]).to_bytes()
            yield _batch(_INDEX, [lang], [at], [n], *([p] for p in parts), [sum(map(len, parts))])

    dealt = terms.join(shards, "lang").withColumn("shard", shard)
    dealt = dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard")
    return saved(dealt.mapInArrow(build, _INDEX), "term-index")


def _waves(index: DataFrame, wave_bytes: int) -> list[tuple]:
    """First and last shard of each run of shards that fits ``wave_bytes``; sizes reach the driver."""
    sizes = index.select("lang", "shard", "bytes").collect()  # a small row for each shard
    waves: list[list] = []
    room = 0
    for lang, shard, size in sorted(sizes, key=lambda r: (r["lang"].encode(), r["shard"])):
        if not waves or size > room:
            waves.append([(lang, shard), None])
            room = wave_bytes
        waves[-1][1] = (lang, shard)
        room -= size
    return [tuple(w) for w in waves]


_COUNTS = "lang string, shard int, source string, width int, counts binary, total bigint"


def _recount(texts: DataFrame, index: DataFrame, first: tuple, last: tuple) -> DataFrame:
    """Occurrences of one wave's terms in each source, by slot, as each task has them."""
    after = (F.col("lang") > first[0]) | ((F.col("lang") == first[0]) & (F.col("shard") >= first[1]))
    until = (F.col("lang") < last[0]) | ((F.col("lang") == last[0]) & (F.col("shard") <= last[1]))
    wave = [tuple(r) for r in index.filter(after & until).drop("bytes").collect()]  # wave_bytes
    held = texts.sparkSession.sparkContext.broadcast(wave)

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, dict[int, TermShard]] = {}
        parts: dict[str, int] = {}
        for lang, shard, n, *data in held.value:
            shards.setdefault(lang, {})[shard] = TermShard.from_bytes(*data)
            parts[lang] = n
        seen: dict[tuple, Counter] = {}
        slots: dict[tuple, np.ndarray] = {}

        def count() -> Iterator[pa.RecordBatch]:
            """Add what was seen to the slots."""
            for (lang, source), terms in seen.items():
                by_shard: dict[int, list[bytes]] = {}
                for t in terms:
                    by_shard.setdefault(zlib.crc32(t) % parts[lang], []).append(t)
                for shard in by_shard.keys() & shards[lang].keys():
                    here, stored = by_shard[shard], shards[lang][shard]
                    at = stored.slots(here)
                    group = (lang, shard, source)
                    if group not in slots:
                        if sum(map(len, slots.values())) + len(stored) > _CELLS:
                            yield from flush()
                        slots[group] = np.zeros(len(stored), dtype=np.int64)
                    times = np.fromiter((terms[t] for t in here), np.int64, len(here))
                    slots[group][at[at >= 0]] += times[at >= 0]
            seen.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, shard, source), counts in slots.items():
                width, packed = _packed(counts)
                yield _batch(_COUNTS, [lang], [shard], [source], [width], [packed], [int(counts.sum())])
            slots.clear()

        waiting = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if lang not in shards:
                    continue
                terms = terms_of(text)
                seen.setdefault((lang, source), Counter()).update(terms)
                waiting += len(terms)
                if waiting >= 4 * _HELD:
                    yield from count()
                    waiting = 0
        yield from count()
        yield from flush()

    return saved(texts.mapInArrow(recount, _COUNTS), "term-counts")


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (counts + 1) / total), exact: a long division, three digits at a time."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // total
        rest = rest % total
    return 1 + whole


def _compare(names: list[str], totals: np.ndarray, counts: np.ndarray, n_terms: int, terms: list[bytes], top: int):
    """Over some terms: the sums for all pairs of sources, and each source's best terms."""
    p = shares(counts, (totals + n_terms)[:, None])
    q = shares(counts.sum(axis=0), int(totals.sum()) + n_terms)
    pairs = np.empty((len(names), len(names)), dtype=np.int64)
    for b in range(len(names)):
        pairs[:, b] = ((p - p[b]) ** 2 // p[b]).sum(axis=1)
    best = []
    for a in range(len(names)):
        at = np.flatnonzero((counts[a] > 0) & (p[a] > q))
        value = (p[a, at] - q[at]) ** 2 // q[at]
        if len(at) > top:
            least = np.partition(value, len(value) - top)[len(value) - top]
            at, value = at[value >= least], value[value >= least]
        found = sorted((-v, terms[t]) for v, t in zip(value.tolist(), at.tolist(), strict=True))
        best += [(names[a], t.decode(), -v) for v, t in found[:top]]
    return pairs, best


_FOUND = "lang string, source string, part string, item string, value bigint"


def source_divergence(
    docs: DataFrame,
    min_docs: int = 3,
    top: int = 200,
    shard_terms: int = 65_536,
    wave_bytes: int = 128 << 20,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """How far the sources of a language part from each other, and by which terms.

    A term is a run of letters and characters beyond ASCII, A-Z lower-cased; each language keeps
    those in at least ``min_docs`` of its rows. Every source of a language gives each kept term
    p = 1 + floor(10**9 * (count + 1) / (N + V)); p and q part by f = floor((p - q)**2 / q).
    Returns lang, source, part, item, value, rank: part ``pair`` has every other source, whose
    p is q, with the sum of f over all kept terms; part ``term`` has the ``top`` terms which the
    source holds more than its language does, whose p is q. Ranks go by value, then by item.
    All arithmetic is exact.

    First the kept terms are counted exactly, then indexed: shards of ``shard_terms`` terms, each
    a minimal perfect hash with the terms themselves, so that a probe is verified. Shards are
    broadcast in waves of at most ``wave_bytes`` (or one shard), with one pass over the texts for
    each wave; a task counts in a dense array for each source, and hands its arrays on when they
    take 128 MB. Arrays are added up by shard and source, cut into slices of 1024 terms, and all
    sources of a language are compared slice by slice.

    Defined results: a null text, lang or source is an empty one; a source without terms has
    counts of 0, a language without kept terms pairs of value 0; repeated rows count each; an
    empty table gives an empty one. Other columns are ignored.
    """
    texts = _texts(docs, text, lang, source)
    terms = frequent_terms(texts, min_docs)
    index = index_terms(terms, shard_terms)
    none = texts.sparkSession.createDataFrame([], _COUNTS)
    counts = none
    for first, last in _waves(index, wave_bytes):
        counts = counts.unionByName(_recount(texts, index, first, last))

    groups = texts.select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    totals = saved(
        groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")),
        "source-totals",
    )
    langs = (
        totals.groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources"))
        .join(terms.groupBy("lang").agg(F.count("term").alias("terms")), "lang")
    )
    sliced = "lang string, shard int, slice int, source string, width int, counts binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, shard, source), rows in _by_key(batches, "lang", "shard", "source"):
            total = 0
            for r in rows:
                total = total + _unpacked(r["width"], r["counts"])
            cut = [_packed(total[a : a + _SLICE]) for a in range(0, len(total), _SLICE)]
            n = len(cut)
            yield _batch(
                sliced, [lang] * n, [shard] * n, range(n), [source] * n, [w for w, _ in cut], [c for _, c in cut]
            )

    named = "lang string, shard int, slice int, keys binary, ends binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of each slice, in the order of their slots."""
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.frombuffer(r["ends"], "<i8")
                for k, a in enumerate(range(0, len(ends), _SLICE)):
                    begin, part = (int(ends[a - 1]) if a else 0), ends[a : a + _SLICE]
                    keys = r["keys"][begin : part[-1]]
                    yield _batch(named, [r["lang"]], [r["shard"]], [k], [keys], [(part - begin).tobytes()])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by language, shard and slice, the one with the terms first."""
        added: list = [None, [], 0]  # language, sources, their matrix so far

        def pairs() -> Iterator[pa.RecordBatch]:
            lang, names, matrix = added
            for a, name in enumerate(names if lang is not None else []):
                others = [b for b in range(len(names)) if b != a]
                n = len(others)
                yield _batch(
                    _FOUND, [lang] * n, [name] * n, ["pair"] * n, [names[b] for b in others], matrix[a, others]
                )
            added[:] = [None, [], 0]

        for (lang, _, _), rows in _by_key(batches, "lang", "shard", "slice"):
            head = next(rows)
            names = [s["source"] for s in head["sources"]]
            totals = np.array([s["total"] for s in head["sources"]], dtype=np.int64)
            ends = np.frombuffer(head["ends"], "<i8").tolist()
            terms = [head["keys"][a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            place = {n: i for i, n in enumerate(names)}
            counts = np.zeros((len(names), len(terms)), dtype=np.int64)
            for r in rows:
                counts[place[r["source"]]] = _unpacked(r["width"], r["counts"])
            matrix, best = _compare(names, totals, counts, head["terms"], terms, top)
            if best:
                n = len(best)
                yield _batch(_FOUND, [lang] * n, [b[0] for b in best], ["term"] * n, [b[1] for b in best], [b[2] for b in best])
            if added[0] != lang:
                yield from pairs()
            added[:] = [lang, names, added[2] + matrix]
            if matrix.size > _MATRIX:
                yield from pairs()
        yield from pairs()

    by_source = counts.select("lang", "shard", "source", "width", "counts").repartition("lang", "shard", "source")
    by_source = by_source.sortWithinPartitions("lang", "shard", "source").mapInArrow(add, sliced)
    heads = index.select("lang", "shard", "keys", "ends").mapInArrow(cut, named).join(langs, "lang")
    met = (
        heads.unionByName(by_source, allowMissingColumns=True)
        .repartition("lang", "shard", "slice")
        .sortWithinPartitions("lang", "shard", "slice", F.col("keys").isNull())
    )
    found = saved(met.mapInArrow(compare, _FOUND), "divergences")
    key = ["lang", "source", "item"]
    added = found.filter("part = 'pair'").groupBy(*key).agg(F.sum("value").alias("value"))
    other = totals.select("lang", F.col("source").alias("item"))
    pair = (  # the result itself: each source beside each other one of its language
        totals.select("lang", "source")
        .join(other, "lang")
        .filter("source <> item")
        .join(added, key, "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    term = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pair.withColumn("rank", rank).unionByName(term)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
),
words as (select row, lang, source, unnest(terms) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct row) >= 3),
vocabulary as (
    select g.lang, count(k.term) as v
    from (select distinct lang from docs) g left join kept k on k.lang = g.lang group by g.lang
),
groups as (select distinct lang, source from docs),
occurring as (
    select lang, source, term, count(*) as n from words join kept using (lang, term) group by all
),
totals as (
    select g.lang, g.source, coalesce(sum(o.n), 0) as total
    from groups g left join occurring o on o.lang = g.lang and o.source = g.source group by all
),
counts as (
    select t.lang, t.source, k.term, coalesce(o.n, 0)::hugeint as n,
        1 + (1000000000::hugeint * (coalesce(o.n, 0) + 1)) // (t.total + v.v)::hugeint as p
    from totals t join kept k on k.lang = t.lang join vocabulary v on v.lang = t.lang
        left join occurring o on o.lang = t.lang and o.source = t.source and o.term = k.term
),
language as (
    select lang, term, 1 + (1000000000::hugeint * (sum(n)::hugeint + 1))
        // (any_value(all_n) + any_value(v))::hugeint as q
    from counts join (select lang, sum(total)::hugeint as all_n from totals group by lang) using (lang)
        join vocabulary using (lang)
    group by lang, term
),
sums as (
    select lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
    from counts x join counts y using (lang, term) where x.source <> y.source group by all
),
pairs as (
    select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
),
terms as (
    select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value
    from counts join language using (lang, term) where n > 0 and p > q
)
select lang, source, 'pair' as part, item, value, (row_number() over (
    partition by lang, source order by value desc, item))::int as rank from pairs
union all
select * from (
    select lang, source, 'term' as part, item, value, (row_number() over (
        partition by lang, source order by value desc, item))::int as rank from terms
) where rank <= 200
"""
