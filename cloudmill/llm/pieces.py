"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import chunks, table

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_models: dict[str, PieceModel] = {}


class PieceModel:
    """A byte-pair SentencePiece vocabulary, encoded by matching all pieces at once.

    No piece holds a space mark behind another character, so a text's units (space marks and
    the characters behind them) are encoded alone, and each distinct unit once. The distinct
    new units of a batch are concatenated and indexed by a suffix array; every piece is
    binary-searched for its range of occurrences; occurrences are edges from their start to
    their end, sorted by place; and edges are relaxed from left to right: an edge holds if the
    best path to its start ends in a piece that merges leave apart from the edge's piece. That
    gives what merging the best pair again and again gives, because merges inside two
    neighbours never depend on a third. Characters outside the vocabulary become bytes.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        ids = [i for i in range(n) if i not in special and not sp.is_byte(i)]
        if any(SPACE in names[i].lstrip(SPACE) for i in ids):
            raise ValueError("pieces that cross a space are not supported")
        self.ids = np.array(ids, dtype=np.int64)
        self.text = [names[i] for i in ids]
        self.rank = {names[i]: -sp.get_score(i) for i in ids}
        self.lengths = np.array([len(t) for t in self.text], dtype=np.int64)
        self.longest = int(self.lengths.max())
        self.codes = np.zeros((len(ids), self.longest), dtype=np.uint32)
        for k, t in enumerate(self.text):
            self.codes[k, : len(t)] = [ord(c) for c in t]
        self.whole = np.array([self._merged(t) == [t] for t in self.text])
        self.bytes = {i: names[i].replace(SPACE, " ").encode() for i in ids}
        self.bytes |= {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.bytes |= {i: b"" for i in special}
        self.bytes[self.unknown] = " ⁇ ".encode()
        # Marks that no piece holds behind a letter: merges never cross in front of them.
        behind = {t[k] for t in self.text for k in range(1, len(t)) if t[k - 1].isalpha()}
        self.marks = "".join(c for c in ".,;:!?*#$%&|)\"" if c not in behind)
        self.breaks = not any("\n" in t for t in self.text)  # nor a line break anywhere
        self.known: dict[str, bytes] = {}
        self.pair_keys = np.zeros(0, dtype=np.int64)
        self.pair_holds = np.zeros(0, dtype=bool)

    def _merged(self, text: str) -> list[str]:
        """Merge the best-ranked neighbours, the leftmost first, until none is a piece."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        rank = self.rank
        heap = [
            (rank[text[i : i + 2]], i, i + 1, text[i : i + 2])
            for i in range(len(parts) - 1)
            if text[i : i + 2] in rank
        ]
        heapq.heapify(heap)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or j >= len(parts) or parts[j] is None:
                continue
            if parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (more := both + parts[k]) in rank:
                    heapq.heappush(heap, (rank[more], i, k, more))
            h = before[i]
            if h >= 0 and (more := parts[h] + both) in rank:
                heapq.heappush(heap, (rank[more], h, i, more))
        return [p for p in parts if p is not None]

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces gives just these two; remembered."""
        n = len(self.text)
        keys = left * n + right
        distinct, at = np.unique(keys, return_inverse=True)
        place = np.searchsorted(self.pair_keys, distinct)
        place = np.minimum(place, max(len(self.pair_keys) - 1, 0))
        seen = self.pair_keys[place] == distinct if len(self.pair_keys) else np.zeros(len(distinct), bool)
        new = distinct[~seen]
        if len(new):
            text = self.text
            holds = np.fromiter(
                (
                    len(got := self._merged(text[a] + text[b])) == 2 and got[0] == text[a]
                    for a, b in zip((new // n).tolist(), (new % n).tolist(), strict=True)
                ),
                bool,
                len(new),
            )
            keys_now = np.concatenate([self.pair_keys, new])
            order = np.argsort(keys_now, kind="stable")
            self.pair_keys = keys_now[order]
            self.pair_holds = np.concatenate([self.pair_holds, holds])[order]
            place = np.searchsorted(self.pair_keys, distinct)
        answer = self.pair_holds[place][at]
        if len(self.pair_keys) > 8_000_000:  # memory only
            self.pair_keys, self.pair_holds = self.pair_keys[:0], self.pair_holds[:0]
        return answer

    def _suffixes(self, data: np.ndarray) -> np.ndarray:
        """Places of ``data`` ordered by the ``longest`` characters from there on.

        Characters are numbered in order, as many as fit packed into each 64-bit sort key.
        """
        letters, numbers = np.unique(data, return_inverse=True)
        bits = max(1, int(len(letters) - 1).bit_length())
        each = 64 // bits
        numbers = np.concatenate([numbers, np.zeros(self.longest + each, np.int64)]).astype(np.uint64)
        keys = []
        for first in range(0, self.longest, each):
            key = np.zeros(len(data), dtype=np.uint64)
            for k in range(first, first + each):
                key = (key << np.uint64(bits)) | numbers[k : k + len(data)]
            keys.append(key)
        return np.lexsort(keys[::-1])

    def _ranges(self, data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that start with each piece, one character after the other."""
        low = np.zeros(len(self.text), dtype=np.int64)
        high = np.full(len(self.text), len(order), dtype=np.int64)
        padded = np.concatenate([data, np.zeros(self.longest, data.dtype)])

        def bound(which: np.ndarray, depth: int, after: bool) -> np.ndarray:
            a, b = low[which].copy(), high[which].copy()
            want = self.codes[which, depth]
            while (open_ := a < b).any():
                middle = (a + b) // 2
                got = padded[order[np.minimum(middle, len(order) - 1)] + depth]
                go = open_ & ((got <= want) if after else (got < want))
                a = np.where(go, middle + 1, a)
                b = np.where(open_ & ~go, middle, b)
            return a

        for depth in range(self.longest):
            which = np.flatnonzero((self.lengths > depth) & (low < high))
            if len(which):
                first, last = bound(which, depth, False), bound(which, depth, True)
                low[which], high[which] = first, last
        return low, high

    def segment(self, units: list[str]) -> list[bytes]:
        """Piece ids (little-endian unsigned 32-bit) of distinct units."""
        if not units:
            return []
        joined = "\0".join(units) + "\0"
        data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        order = self._suffixes(data)
        low, high = self._ranges(data, order)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        unit_of = np.repeat(np.arange(len(units)), sizes + 1)
        use = np.flatnonzero((low < high) & self.whole)
        count = (high - low)[use]
        piece = np.repeat(use, count)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        start = order[np.repeat(low[use], count) + within]
        # Characters that are no piece: an edge each, numbered behind the pieces.
        n = len(self.text)
        single = np.zeros(len(data), dtype=bool)
        single[start[self.lengths[piece] == 1]] = True
        single[begin + sizes] = True  # the marks between units
        odd = np.flatnonzero(~single)
        start = np.concatenate([start, odd])
        length = np.concatenate([self.lengths[piece], np.ones(len(odd), np.int64)])
        piece = np.concatenate([piece, n + data[odd].astype(np.int64)])
        depth = start + length - begin[unit_of[start]]
        by = np.argsort(depth, kind="stable")
        start, length, piece = start[by], length[by], piece[by]
        cuts = np.searchsorted(depth[by], np.arange(1, int(sizes.max(initial=0)) + 2))
        last = np.full(len(data), -1, dtype=np.int64)  # piece that ends before a place
        come = np.zeros(len(data), dtype=np.int64)
        is_first = np.zeros(len(data), dtype=bool)
        is_first[begin] = True
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, p, size = start[a:b], piece[a:b], length[a:b]
            left = last[s]
            holds = is_first[s] | (p >= n) | (left >= n)
            check = np.flatnonzero(~holds & (left >= 0))
            if len(check):
                holds[check] = self._apart(left[check], p[check])
            s, p, size = s[holds], p[holds], size[holds]
            last[s + size], come[s + size] = p, s
        # Back from every unit's end; tokens come out last first.
        at, unit = begin + sizes, np.arange(len(units))
        places, tokens, owners = [], [], []
        while True:
            go = at > begin[unit]
            at, unit = at[go], unit[go]
            if not len(at):
                break
            places.append(at)
            tokens.append(last[at])
            owners.append(unit)
            at = come[at]
        place, token, owner = map(np.concatenate, (places, tokens, owners))
        token = token[np.argsort(place, kind="stable")]
        counts = np.bincount(owner, minlength=len(units))
        ends = np.cumsum(counts)
        raw = np.where(token < n, self.ids[np.minimum(token, n - 1)], 0).astype("<u4").tobytes()
        out = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        for k in np.unique(np.repeat(np.arange(len(units)), counts)[token >= n]).tolist():
            out[k] = self._with_bytes(token[ends[k] - counts[k] : ends[k]].tolist())
        return out

    def _with_bytes(self, tokens: list[int]) -> bytes:
        n, ids = len(self.text), []
        for t in tokens:
            if t < n:
                ids.append(int(self.ids[t]))
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in chr(t - n).encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Piece ids of whole texts, as little-endian unsigned 32-bit numbers."""
        split = []  # units without their single space mark, or behind NUL as they are
        for t in texts:
            s = self.normalize(t) if t else ""
            if s[:1] == SPACE and SPACE * 2 not in s and "\0" not in s:
                if self.breaks and "\n" in s:
                    s = s.replace("\n", f"{SPACE}\0\n{SPACE}\0")
                split.append(s[1:].split(SPACE))
            else:
                split.append([f"\0{u}" for u in _UNITS.findall(s)])
        known = self.known
        if len(known) > 1_500_000:  # memory only
            known.clear()
        known[chr(0)] = b""
        new = [u for u in dict.fromkeys(u for units in split for u in units) if u not in known]
        parts = {u: (core, f"\0{u[len(core) :]}") for u in new if (core := u.rstrip(self.marks)) != u and core.isalpha()}
        whole = [u for u in new if u not in parts]
        whole += [u for u in dict.fromkeys(u for both in parts.values() for u in both) if u not in known]
        whole = list(dict.fromkeys(whole))
        full = [u[1:] if u[:1] == "\0" else SPACE + u for u in whole]
        known.update(zip(whole, self.segment(full), strict=True))
        known.update((u, known[core] + known[tail]) for u, (core, tail) in parts.items())
        return [b"".join(map(known.__getitem__, units)) for units in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of piece ids: bytes joined, space marks as spaces, without the first one."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


def load(name: str) -> PieceModel:
    """The model of a public vocabulary file, once per process."""
    if name not in _models:
        import public_tokenizers

        _models[name] = PieceModel(public_tokenizers.path(name))
    return _models[name]


def encode_pieces(text: Column, model: str = "piece_bpe_32k.model", chunk: int = 6_000_000) -> Column:
    """A column of piece ids (array<int>) of a text column. Null and empty texts have none."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([np.frombuffer(b, "<u4").astype(np.int32) for part in chunks(texts, chunk) for b in load(model).encode(texts[part])], dtype=object)

    return encode(text)


def decode_pieces(ids: Column, model: str = "piece_bpe_32k.model") -> Column:
    """A column of texts of a column of piece ids. A null array is an empty text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([load(model).decode(np.asarray(i)) if i is not None else "" for i in batch], dtype=object)

    return decode(ids)


def piece_digests(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and decoded_sha256 of every whole text, encoded and decoded.

    ids_crc32 is over unsigned little-endian 32-bit ids. Defined results: a null or empty text
    has no pieces and decodes to an empty text; repeated rows alike; no rows give no rows;
    other columns are ignored.
    """

    @F.pandas_udf("n_pieces bigint, ids_crc32 bigint, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = load(model)
        for batch in batches:
            texts = batch.tolist()
            for_rows = [(len(b) // 4, zlib.crc32(b), pieces.decode(np.frombuffer(b, "<u4"))) for part in chunks(texts, 6_000_000) for b in pieces.encode(texts[part])]
            yield pd.DataFrame(for_rows, columns=["n_pieces", "ids_crc32", "decoded"])

    found = docs.select("doc_id", both(F.col(text).cast("string")).alias("x"))
    return found.select("doc_id", "x.n_pieces", "x.ids_crc32", F.sha2("x.decoded", 256).alias("decoded_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))
