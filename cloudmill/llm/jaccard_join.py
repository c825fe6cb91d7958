"""N-gram Jaccard join with prefix filters under several global token orders."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudmill.llm.common import Words, chunks, mixed, saved, table
from cloudmill.llm.components import components

_PLACES = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 400_000  # characters hashed at a time
_SLICES = 64  # parts in which frequency sketches are added up
_NODE_BITS = 24  # bits of the filters that say which sets a later pass needs
_PIVOTS = 4  # sets of each list that the others are verified with first, and such pairs of each set
_CENTRAL = 16  # as many in the second round, in which only sets of different groups are paired


class Shingles:
    """Distinct n-word shingles of many texts as sorted 64-bit hashes, and a hash of each set.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """

    def __init__(self, texts: list[str | None], n: int) -> None:
        words = Words(texts)
        h = words.hashes()
        full = max(0, len(h) - n + 1)
        grams = np.full(full, n, dtype=np.uint64)
        for k in range(n):
            grams += h[k : k + full] * _PLACES[k % 64]
        grams = mixed(grams)
        sets = []
        for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
            if b - a >= n:
                sets.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                whole = (h[a:b] * _PLACES[np.arange(b - a) % 64]).sum() + np.uint64(b - a)
                sets.append(mixed(np.array([whole], dtype=np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        sums = [mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s)) for s in sets]
        self.nodes = mixed(np.array(sums, dtype=np.uint64)).astype(np.int64)


def _stream(batches: Iterator[pd.DataFrame], n: int) -> Iterator[tuple[pd.DataFrame, Shingles]]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in chunks(texts, _CHUNK):
            yield batch.iloc[part], Shingles(texts[part], n)


def _turned(tokens: np.ndarray, order: int) -> np.ndarray:
    """A bijection of tokens for each order; the top bits are the sketch's bucket."""
    return mixed(tokens + np.uint64(order) * np.uint64(0xA24BAED4963EE407))


def _bounded(sets: np.ndarray, size: int) -> bytes:
    """Counts of a set's tokens in about size / 4 buckets: bounds any intersection."""
    bits = int(np.clip(int(max(size // 4, 1)).bit_length() - 1, 4, 12))
    counts = np.bincount((sets >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    if counts.max() >= 65535:
        counts[:] = 65535  # no bound
    return counts.astype("<u2").tobytes()


def _may_reach(a: bytes, b: bytes, total: int, percent: int) -> bool:
    x, y = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    if len(x) > len(y):
        x, y = y, x
    y = y.reshape(len(x), -1).sum(axis=1)
    return (100 + percent) * int(np.minimum(x, y).sum()) >= percent * total


def _met(postings: DataFrame, percent: int) -> DataFrame:
    """The postings that have, in their token's list, another set whose size allows the similarity.

    Copies of a posting stand side by side in the order of sizes: of these, one at an end stays.
    """
    order = Window.partitionBy("token").orderBy("n", "node")
    beside = {f"{c}_{x}": f(c).over(order) for c in ("n", "node") for x, f in (("lo", F.lag), ("hi", F.lead))}
    alike = f"node_lo <> node and 100L * n_lo >= {percent} * n or node_hi <> node and 100L * n >= {percent} * n_hi"
    return postings.withColumns(beside).filter(alike).drop(*beside)


def _parts(rows: DataFrame, percent: int) -> DataFrame:
    """The rows with their token's list cut, in the order of sizes, where the next size is too large: ``part``."""
    order = Window.partitionBy("token").orderBy("n")
    cut = F.coalesce(F.expr(f"100L * n_lo < {percent} * n"), F.lit(True)).cast("int")
    cuts = rows.withColumn("n_lo", F.lag("n").over(order)).withColumn("cut", cut)
    return cuts.withColumn("part", F.sum("cut").over(order)).drop("n_lo", "cut")


def _several(rows: DataFrame, column: str, *part: str) -> DataFrame:
    """The rows of tokens, or of such parts of their lists, that occur with several values of ``column``."""
    same = Window.partitionBy("token", *part)
    ends = [F.min(column).over(same).alias("lo"), F.max(column).over(same).alias("hi")]
    return rows.select("*", *ends).filter("lo <> hi").drop("lo", "hi")


class JaccardJoin:
    """The steps of ``jaccard_groups`` over one table of texts."""

    def __init__(
        self, docs: DataFrame, words: int, percent: int, orders: int, sketch_bits: int, text: str
    ) -> None:
        body = F.col(f"`{text}`").cast("string")
        # Ids go through pandas as text, which is exact beside nulls. Without one, rows are told
        # apart by their text.
        unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce(body, F.lit(""))))
        self.docs = docs.select(
            F.col("doc_id").cast("bigint").cast("string").alias("doc_id"),
            unnamed.cast("string").alias("same"),
            body.alias("text"),
        )
        self.texts = self.docs.select("text")
        self.words, self.percent, self.orders, self.bits = words, percent, orders, sketch_bits
        self.spark = docs.sparkSession

    def first_pass(self) -> DataFrame:
        """Every row's set hash and size; and the frequency sketches, which become ranks."""
        words, orders, bits = self.words, self.orders, self.bits

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros((orders, 1 << bits), dtype=np.int64)
            for rows, sh in _stream(batches, words):
                tokens = np.concatenate(sh.sets) if len(sh.sets) else np.zeros(0, np.uint64)
                for o in range(orders):
                    at = (_turned(tokens, o) >> np.uint64(64 - bits)).astype(np.int64)
                    counts[o] += np.bincount(at, minlength=1 << bits)
                some = sh.sizes > 0
                node = pd.array(sh.nodes, dtype="Int64")
                node[~some] = pd.NA
                yield pd.DataFrame(
                    {"doc_id": rows["doc_id"], "same": rows["same"], "node": node, "n": sh.sizes, "part": -1, "counts": None}
                )
            parts = [
                zlib.compress(p.astype("<u4" if p.max(initial=0) < 2**32 else "<u8").tobytes(), 1)
                for p in counts.reshape(orders * _SLICES, -1)
            ]
            blank = pd.array([pd.NA] * len(parts), dtype="Int64")
            yield pd.DataFrame(
                {"doc_id": None, "same": None, "node": blank, "n": 0, "part": range(len(parts)), "counts": parts}
            )

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            width = (1 << bits) // _SLICES
            for batch in batches:
                for part, packed in zip(batch["part"].tolist(), batch["counts"], strict=True):
                    raw = zlib.decompress(packed)
                    got = np.frombuffer(raw, "<u4" if len(raw) == 4 * width else "<u8")
                    sums[part] = sums.get(part, 0) + got.astype(np.int64)
            yield pd.DataFrame(
                {"part": list(sums), "counts": [s.astype("<i8").tobytes() for s in sums.values()]}
            )

        schema = "doc_id string, same string, node bigint, n bigint, part int, counts binary"
        both = saved(self.docs.mapInPandas(read, schema), "shingle-sets")
        sketches = both.filter("part >= 0").select("part", "counts")
        total = (  # at most orders * _SLICES rows of fixed size reach the driver
            sketches.repartition("part").mapInPandas(add, "part int, counts binary").collect()
        )
        load = np.zeros((orders * _SLICES, (1 << bits) // _SLICES), dtype=np.int64)
        for r in total:
            load[r["part"]] = np.frombuffer(r["counts"], "<i8")
        self.ranks = []
        for row in load.reshape(orders, -1):
            rank = np.empty(len(row), dtype=np.uint32)
            rank[np.argsort(row, kind="stable")] = np.arange(len(row), dtype=np.uint32)
            self.ranks.append(rank)
        names = [F.col(c).cast("bigint").alias(c) for c in ("doc_id", "same")]
        return both.filter("part < 0").select(*names, "node", "n")

    def needed(self, nodes: DataFrame) -> np.ndarray:
        """A bit filter of fixed size (2**_NODE_BITS) that passes at least these set hashes."""
        at = F.col("node").bitwiseAND(F.lit((1 << _NODE_BITS) - 1))
        rows = (
            nodes.select(F.shiftright(at, 6).cast("int").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("k"))
            .groupBy("w")
            .agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))
            .toPandas()
        )
        out = np.zeros(1 << (_NODE_BITS - 6), dtype=np.int64)
        out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        return out.view(np.uint64)

    def _distinct(self, wanted: np.ndarray | None) -> Callable:
        """A later pass over all texts: each wanted set once per task."""
        words = self.words

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, np.ndarray]]]:
            seen: set[int] = set()
            for _, sh in _stream(batches, words):
                low = sh.nodes.view(np.uint64) & np.uint64((1 << _NODE_BITS) - 1)
                keep = sh.sizes > 0
                if wanted is not None:
                    keep &= ((wanted[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)) == 1
                out = []
                for i in np.flatnonzero(keep):
                    node = int(sh.nodes[i])
                    if node not in seen:
                        seen.add(node)
                        out.append((node, sh.sets[i]))
                yield out

        return sets

    def postings(self, order: int, wanted: np.ndarray | None) -> DataFrame:
        """Prefix tokens of sets under one order (token, node, the set's size n and the token's
        place in it), and each set's bound (node, n, bound).

        Tokens are ordered by how full their sketch bucket is, then by a hash: the common ones
        come last. A set of n keeps its first n - ceil(percent * n / 100) + 1 tokens: two sets
        that reach the similarity share one of these, whatever the order.
        """
        sets, percent, bits = self._distinct(wanted), self.percent, self.bits
        rank = self.spark.sparkContext.broadcast(self.ranks[order])  # 4 bytes * 2**bits
        low = np.uint64((1 << (64 - bits)) - 1)

        def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for group in sets(batches):
                tokens, nodes, sizes, whole = [], [], [], []
                for node, s in group:
                    t = _turned(s, order)
                    key = (rank.value[t >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(64 - bits)) | (t & low)
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    tokens.append(np.sort(np.partition(key, length - 1)[:length] if length < len(s) else key))
                    nodes.append(node)
                    sizes.append(min(length, len(s)))
                    whole.append(len(s))
                if not nodes:
                    continue
                # Cut to 48 bits: a chance meeting makes a candidate, no link.
                flat = (np.concatenate(tokens) >> np.uint64(16)).view(np.int64)
                place = np.concatenate([np.arange(k) for k in sizes])
                yield pd.DataFrame(
                    {"token": flat, "node": np.repeat(nodes, sizes), "n": np.repeat(whole, sizes), "place": place, "bound": None}
                )
                if wanted is not None:
                    yield pd.DataFrame(
                        {
                            "token": 0,
                            "node": nodes,
                            "n": whole,
                            "place": 0,
                            "bound": [_bounded(s, len(s)) for _, s in group],
                        }
                    )

        schema = "token bigint, node bigint, n int, place int, bound binary"
        found = self.texts.mapInPandas(prefixes, schema)
        return found if wanted is None else saved(found, f"prefixes-{order}")  # without bounds, read once

    def pivots(self, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings that meet a set of like size, and pairs of each token's such sets with a few of them.

        The few are drawn by hashes of the sets alone, so that lists of the same sets agree on
        them under every order. A pair comes with the number of tokens that it was found by.
        """
        # Windows over one shuffle of the postings; most tokens are of one set and go before any draw.
        same = Window.partitionBy("token")
        drawn = [F.min_by("node", F.xxhash64("node", F.lit(k))).over(same) for k in range(_PIVOTS)]
        lists = _met(postings, self.percent)
        shared = saved(
            lists.select("token", "node", "n", "place", F.array_distinct(F.array(*drawn)).alias("b")), "shared"
        )
        pairs = shared.select("token", F.col("node").alias("a"), F.explode("b").alias("b")).filter("a <> b")
        return shared.drop("b"), pairs.groupBy("a", "b").agg(F.count("token").alias("found"))

    def central(self, unjoined: DataFrame, first: DataFrame) -> DataFrame:
        """Pairs, as above, of the lists' sets with sets of other groups that link with most pivots.

        A set that missed the drawn pivots by little is most likely to reach one of these.
        """
        ends = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node")))
        links = ends.groupBy("node").agg(F.least(F.count("node"), F.lit(_PIVOTS)).alias("links"))
        known = unjoined.join(links, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        known = known.select("token", "node", "root", "links").repartition("token")  # one shuffle, of narrow rows
        most = Window.partitionBy("token").orderBy(F.col("links").desc(), F.xxhash64("node"), "node")
        ranked = known.withColumn("rank", F.row_number().over(most))
        chosen = F.when(F.col("rank") <= _CENTRAL, F.struct(F.col("node").alias("b"), F.col("root").alias("root_b")))
        few = F.collect_list(chosen).over(Window.partitionBy("token"))  # no more than _CENTRAL: it skips nulls
        pairs = ranked.select("token", F.col("node").alias("a"), "root", few.alias("few"))
        pairs = pairs.select("token", "a", "root", F.inline("few")).filter("root <> root_b")
        return pairs.groupBy("a", "b").agg(F.count("token").alias("found"))

    def best(self, pairs: list[DataFrame], few: int) -> DataFrame:
        """Of the pairs under every order, each set's ``few`` that were found by most tokens.

        The others are left to later rounds, unless these join them.
        """
        both = reduce(
            lambda x, y: x.join(y.withColumnRenamed("found", "more"), ["a", "b"]).select(
                "a", "b", (F.col("found") + F.col("more")).alias("found")
            ),
            pairs,
        )
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("found").desc(), F.xxhash64("b")))
        chosen = both.withColumn("rank", rank).filter(F.col("rank") <= few)
        return chosen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def unjoined(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """The lists' sets that may link with sets of other groups."""
        joined = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lists = _several(_parts(joined, self.percent), "root", "part")
        return saved(lists.select("token", "node", "root", "n", "place"), "unjoined")

    def pairs(self, unjoined: DataFrame) -> DataFrame:
        """Pairs of sets that share a token, may be similar and are not joined yet.

        Sizes differ by a quarter at most, so lists are split by classes of size, and a set is
        met by those of its own class and the next. Sets that reach the similarity do so from
        their first common token on: it must stand early enough in both.
        """
        percent = self.percent
        size = F.floor(F.log(101 / percent, F.col("n"))).cast("int")  # a little wider than allowed
        left = unjoined.withColumn("size", size)
        sides = {
            x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "place")] for x in ("a", "b")
        }
        larger = left.select("token", "size", *sides["a"])
        smaller = left.select(
            "token", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), *sides["b"]
        )
        enough = (
            f"(n_a > n_b or n_a = n_b and node_a > node_b) and root_a <> root_b and 100 * n_b >= {percent} * n_a "
            f"and {100 + percent} * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)"
        )
        pair = [F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")]
        return larger.join(smaller, ["token", "size"]).filter(enough).select(*pair).distinct()

    def verified(self, both: DataFrame, bounds: DataFrame, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Links among the pairs; also all pairs that were looked at."""
        percent = self.percent
        if done is not None:
            both = both.join(done, ["a", "b"], "left_anti")
        both = saved(both, "candidates")

        @F.pandas_udf("boolean")
        def may_reach(x: pd.Series, y: pd.Series, total: pd.Series) -> pd.Series:
            return pd.Series([_may_reach(p, q, t, percent) for p, q, t in zip(x, y, total, strict=True)], dtype=bool)

        one = bounds.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bound").alias("ba"))
        two = bounds.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bound").alias("bb"))
        near = saved(
            both.join(one, "a")
            .join(two, "b")
            .filter("100 * least(na, nb) >= {0} * greatest(na, nb)".format(percent))
            .filter(may_reach("ba", "bb", F.col("na") + F.col("nb")))
            .select("a", "b"),
            "near",
        )
        wanted = self.needed(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))))
        if not wanted.any():
            return near, both  # no pair is left, so neither is a link
        sets = self._distinct(wanted)

        def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for group in filter(None, sets(batches)):
                yield pd.DataFrame({"node": [k for k, _ in group], "s": [s.view(np.int64) for _, s in group]})

        held = saved(self.texts.mapInPandas(tokens, "node bigint, s array<bigint>"), "sets")
        held = held.dropDuplicates(["node"])
        common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
        links = (
            near.join(held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
            .join(held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
            .filter((100 + percent) * common >= percent * (F.size("sa") + F.size("sb")).cast("bigint"))
            .select("a", "b")
        )
        return saved(links, "links"), both


def jaccard_groups(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    orders: int = 2,
    sketch_bits: int = 20,
    text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: groups of texts with similar shingles.

    Two texts link when 100 * |intersection| >= ``percent`` * |union| of their distinct
    ``words``-word shingles; component_id is the least doc_id reachable by links. Equal sets
    are one class. Candidates must share a prefix token under each of ``orders`` global token
    orders, each with its own corpus-wide frequency sketch of 2**``sketch_bits`` counters: the
    pair sets of all orders are intersected, a bound on the intersection leaves hopeless pairs
    out, and the rest is verified exactly on full sets. First each set is paired with a few
    drawn sets of its tokens' lists, then, where lists still hold several groups, with the sets
    that have most links: these join large groups of near copies with few pairs. Then all pairs
    follow that share a token, have sizes and places of the token that allow the similarity,
    and are not joined yet, so that no link between groups is lost. Shingles are compared by 64-bit hash, and classes by a 64-bit hash of the set.

    Defined results: a null, empty or word-less text has no shingles and is alone; texts with
    fewer words are one shingle; repeated rows are one class; a null doc_id links like others,
    and gets its group's least id, null if it has none; no rows give no rows; other columns are
    ignored.
    """
    return _grouped(docs, words, percent, orders, sketch_bits, text).drop("same")


def _grouped(
    docs: DataFrame, words: int, percent: int, orders: int, sketch_bits: int, text: str
) -> DataFrame:
    """As ``jaccard_groups``, with a hash of the text, ``same``, for rows without a doc_id."""
    if orders < 2:
        raise ValueError("candidates are the intersection of two orders or more")
    join = JaccardJoin(docs, words, percent, orders, sketch_bits, text)
    members = join.first_pass()
    shared, pairs, bounds, wanted = [], [], None, None
    for order in range(orders):
        found = join.postings(order, wanted)
        lists, with_least = join.pivots(found.filter("bound is null").select("token", "node", "n", "place"))
        shared.append(lists)
        pairs.append(with_least)
        if wanted is None:
            wanted = join.needed(lists.select("node"))
        elif bounds is None:
            bounds = found.filter("bound is not null").select("node", "n", "bound").dropDuplicates(["node"])
    first, seen = join.verified(join.best(pairs, _PIVOTS), bounds)
    roots = components(first)
    apart = [join.unjoined(lists, roots) for lists in shared]
    central = join.best([join.central(lists, first) for lists in apart], _CENTRAL)
    more, tried = join.verified(central, bounds, seen)
    seen = seen.unionByName(tried)
    roots = components(more, known=roots)
    apart = [join.unjoined(lists.drop("root"), roots) for lists in apart]
    rest = reduce(lambda x, y: x.join(y, ["a", "b"]), (join.pairs(lists) for lists in apart))
    last, _ = join.verified(rest, bounds, seen)
    joined = components(last, known=roots)
    grouped = saved(
        members.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "grouped"
    )
    least = grouped.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return grouped.join(least, "root", "left").select(
        "doc_id", "same", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def keep_one_of_each(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    orders: int = 2,
    sketch_bits: int = 20,
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of each group of similar texts.

    Defined results: rows with the same doc_id are one document, of which one row stays. A row
    without a doc_id goes if its group holds a document; of the others, one row of each text
    stays. No rows give no rows. Columns stay as they are, whatever their names.
    """
    groups = _grouped(docs, words, percent, orders, sketch_bits, text)
    kept = groups.filter("component_id is null or doc_id = component_id")
    kept = kept.select(F.col("doc_id").alias("id"), "same").distinct()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(body)).alias("same"),
    )
    alike = rows["id"].eqNullSafe(kept["id"]) & rows["same"].eqNullSafe(kept["same"])
    first = F.row_number().over(Window.partitionBy("id", "same").orderBy("id"))
    left = rows.join(kept, alike, "left_semi").withColumn("first", first)
    return left.filter("first = 1").select("row.*")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
