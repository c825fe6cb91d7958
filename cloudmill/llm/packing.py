"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import saved, table

END = b"\x00\x00\x00\x00"  # id 0 follows every document
_MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_BIN = f"load bigint, members array<{_MEMBER}>"

_MARKS = ".,;:!?*#$%&|"

_encoders: dict[str, Callable[[str], bytes]] = {}


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _encoder(name: str) -> Callable[[str], bytes]:
    """Text to ids (little-endian unsigned 32-bit) of a byte-level BPE vocabulary.

    Byte-level BPE cuts a text in front of every single space and around every other single
    white-space character, so words can be encoded one by one and remembered. Texts with two
    white-space characters in a row, or with a special token's string, are encoded whole.
    """
    if name in _encoders:
        return _encoders[name]
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = tuple(t.content for t in whole.get_added_tokens_decoder().values())
    pairs = ("  ", "\n\n", "\n ", " \n")
    others = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

    def ids(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    try:
        import base64

        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        twin = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

        def plain(text: str) -> bytes:
            return _little(twin.encode_ordinary(text))

        def letters(word: str) -> bytes:
            piece = word.encode()
            return known_pieces.get(piece) or _little(single(piece))

        single = twin._core_bpe.encode_single_piece
        known_pieces = {piece: _little([i]) for piece, i in ranks.items()}
    except (ImportError, OSError, AttributeError):
        plain = letters = ids

    class Words(dict):
        """Ids of words that follow a space; a leading newline replaces the space."""

        def __missing__(self, word: str) -> bytes:
            core = word.rstrip(_MARKS)
            if core.isalpha():  # letters are one piece, marks behind them another
                if core is word:
                    found = letters(" " + word)
                else:
                    found = self[core] + marks(word[len(core) :])
            else:
                found = plain(word if word[:1] == "\n" else " " + word)
            if len(self) >= 100_000:  # memory only: the ids do not depend on it
                self.clear()
            self[word] = found
            return found

    marks = lru_cache(10_000)(plain)
    known = Words()

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return ids(text)
        if not text or any(p in text for p in pairs) or any(c in text for c in others):
            return plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return (plain(first) if first else b"") + b"".join(map(known.__getitem__, rest))

    _encoders[name] = encode
    return encode


def best_fit(loads: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item, and the bins' loads.

    Items are taken longest first; each goes to the fullest open bin it fits in. Open bins are
    kept by free space, one stack for each amount, so memory is linear in the items.
    """
    order = np.argsort(-loads, kind="stable")
    bins = np.empty(len(loads), dtype=np.int64)
    totals: list[int] = []
    free: dict[int, list[int]] = {}
    spaces: list[int] = []
    for i, load in zip(order.tolist(), loads[order].tolist(), strict=True):
        at = bisect_left(spaces, load)
        if at == len(spaces):
            b, space = len(totals), capacity
            totals.append(0)
        else:
            space = spaces[at]
            stack = free[space]
            b = stack.pop()
            if not stack:
                spaces.pop(at)
        totals[b] += load
        bins[i] = b
        left = capacity - totals[b]
        if left:
            stack = free.setdefault(left, [])
            if not stack:
                insort(spaces, left)
            stack.append(b)
    return bins, np.array(totals, dtype=np.int64)


def _packed(loads: list[int], members: list[list], capacity: int) -> pd.DataFrame:
    bins, totals = best_fit(np.array(loads, dtype=np.int64), capacity)
    held: list[list] = [[] for _ in totals]
    for b, inside in zip(bins.tolist(), members, strict=True):
        held[b].extend(inside)
    return pd.DataFrame({"load": totals, "members": held})


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    vocabulary: str = "byte_bpe_50k",
    slack: int = 2,
    block: int = 100_000,
    fan_in: int = 8,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    A document is its ids and then id 0. Longer ones are cut into pieces of ``capacity``, the
    remainder first. Each partition packs its pieces best-fit decreasing, ``block`` at a time.
    Bins with at most ``slack`` places left are done. The others are items of the next round:
    ``fan_in`` groups meet in one task, of at most about ``block`` items, and are packed again,
    until one group is left or a round of full groups removes less than 1 % of its bins.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined results: a null or empty text is the single id 0. A null id stays null. Repeated
    rows are packed each on its own. No rows give no rows. Other columns are ignored.
    """

    def first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary)
        loads: list[int] = []
        members: list[list] = []
        for batch in batches:
            for doc, body in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                doc = None if doc is None else int(doc)
                data = (encode(body) if body else b"") + END
                size = len(data) // 4
                cut = size % capacity or capacity
                start = 0
                for piece in range(-(-size // capacity)):
                    part = data[4 * start : 4 * (start + cut)]
                    loads.append(cut)
                    members.append([(doc, piece, start, cut, zlib.crc32(part))])
                    start, cut = start + cut, capacity
                if len(loads) >= block:
                    yield _packed(loads, members, capacity)
                    loads, members = [], []
        if loads:
            yield _packed(loads, members, capacity)

    def next_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads: list[int] = []
        members: list[list] = []
        for batch in batches:
            loads += batch["load"].tolist()
            members += batch["members"].tolist()
            if len(loads) >= 2 * block:  # an uneven deal: still bounded
                yield _packed(loads, members, capacity)
                loads, members = [], []
        if loads:
            yield _packed(loads, members, capacity)

    source = docs.select(
        F.col(id_column).cast("bigint").cast("string").alias("doc_id"),  # exact beside nulls in pandas
        F.col(text).cast("string").alias("text"),
    )
    full = F.col("load") >= capacity - slack
    bins = saved(source.mapInPandas(first_round, _BIN), "bins")
    done, rest = bins.filter(full), bins.filter(~full)
    count, groups = rest.count(), max(1, bins.rdd.getNumPartitions())
    while count > 1:
        groups = max(-(-groups // fan_in), -(-count // block))
        bins = saved(rest.repartition(groups).mapInPandas(next_round, _BIN), "bins")
        done, rest = done.unionByName(bins.filter(full)), bins.filter(~full)
        before, count = count, bins.filter(~full).count()
        merged = before - bins.count()
        if groups == 1 or (groups == -(-before // block) and merged < 0.01 * before):
            break
    numbered = done.unionByName(rest).withColumn("sequence_id", F.monotonically_increasing_id())
    places = F.transform(
        F.sequence(F.lit(0), F.size("members") - 1),
        lambda i: F.aggregate(
            F.slice("members", 1, i), F.lit(0).cast("bigint"), lambda a, m: a + m["length"]
        ),
    )
    zipped = F.arrays_zip(F.col("members").alias("m"), places.alias("offset"))
    return numbered.select("sequence_id", F.explode(zipped).alias("x")).select(
        *(F.col(f"x.m.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
        "sequence_id",
        F.col("x.offset").alias("offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
