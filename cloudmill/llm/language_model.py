"""Language-model scores by deleted interpolation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import Words, chunks, fold, mixed, saved, table

_CHUNK = 400_000  # characters read at a time
_STEP = 8  # bins in each power of two of a quantised probability
_BINS = 40 * _STEP  # below 2**-40 all probabilities count as the last bin
_BUCKETS = 48  # powers of two of a context's count, and one for unseen contexts
END = np.array([0x6A09E667F3BCC908], dtype=np.uint64)  # stands for the end of a text
_GRAM = np.uint64(0xBB67AE8584CAA73B)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, each followed by the end token, and where each text starts."""
    words = Words(texts)
    offsets = words.offsets + np.arange(len(words.offsets))
    flat = np.empty(offsets[-1], dtype=np.uint64)
    ends = offsets[1:] - 1
    inner = np.ones(len(flat), dtype=bool)
    inner[ends] = False
    flat[inner] = words.hashes()
    flat[ends] = END[0]
    return flat, offsets


def _packed(counts: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if counts.max(initial=0) < 1 << 8 * int(k[2]))
    return kind[2].encode() + zlib.compress(counts.astype(kind).tobytes(), 6)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers below 256**width, byte by byte: high bytes are small and pack well."""
    planes = values.astype(">u8").view(np.uint8).reshape(-1, 8).T[8 - width :]
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 6)


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, 8 - width :] = planes.T
    return full.view(">u8")[:, 0].astype(np.uint64)


def _keys(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)), 8)


def _hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, 8))


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    """Words of a block by falling frequency: frequent words get small numbers."""
    return np.argsort(-counts, kind="stable")


def _bigrams(ids: np.ndarray, offsets: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Hash of every token with the one before it, in the top ``bits``; a text's first follows an end."""
    before = np.empty(len(ids), dtype=np.uint64)
    before[1:] = words[ids[:-1]]
    before[offsets[:-1]] = END[0]
    return mixed(before * _GRAM + words[ids]) >> np.uint64(64 - bits)


def _bins(p: np.ndarray) -> np.ndarray:
    """Quantised probabilities; the last bin holds none at all."""
    with np.errstate(divide="ignore"):
        at = np.floor(-np.log2(p) * _STEP)
    return np.where(p > 0, np.clip(at, 0, _BINS - 2), _BINS - 1).astype(np.int64)


def fit_weights(cells: np.ndarray, counts: np.ndarray, floor: float, rounds: int = 100) -> np.ndarray:
    """Mixture weights of each context bucket by expectation-maximisation.

    ``cells`` holds (bucket, bigram bin, unigram bin) of held-out events and ``counts`` how
    often each occurred; ``floor`` is the uniform probability. Buckets without held-out events
    keep the start weights. Each weight keeps a small share, so that no event gets 0.
    """
    middle = 2.0 ** (-(np.arange(_BINS) + 0.5) / _STEP)
    middle[-1] = 0.0
    weights = np.tile([0.4, 0.5, 0.1], (_BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    if not len(cells):
        return weights
    bucket = cells[:, 0]
    p = np.column_stack([middle[cells[:, 1]], middle[cells[:, 2]], np.full(len(cells), floor)])
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (counts / share.sum(axis=1))[:, None]
        mass = np.zeros((_BUCKETS, 3))
        np.add.at(mass, bucket, share)
        total = mass.sum(axis=1, keepdims=True)
        new = np.where(total > 0, (mass + 1e-3) / (total + 3e-3), weights)
        done = np.abs(new - weights).max() < 1e-7
        weights = new
        if done:
            break
    weights[0, 1:] += weights[0, :1] / 2  # an unseen context has no bigram estimate
    weights[0, 0] = 0.0
    return weights


def score_texts(
    docs: DataFrame,
    train_folds: int = 5,
    held: int = 1,
    deleted: int = 0,
    block_tokens: int = 1_500_000,
    shard_entries: int = 1_000_000,
    gram_bits: int = 48,
    text: str = "text",
) -> DataFrame:
    """log10 probabilities of whole texts under an interpolated bigram model of the corpus.

    Trains on rows whose id's crc32 modulo ``train_folds`` is not ``held``. Of these, fold
    ``deleted`` is left out of the counts to learn the mixture: for each power of two of the
    context's count, expectation-maximisation finds the weights of the bigram's and the
    unigram's relative frequency and the uniform 1 / (V + 1) that make the deleted fold
    likeliest. Probabilities are quantised (8 bins in each power of two) for that alone, so
    that held-out events become a table of bounded size. Scores use the counts of all training
    rows.

    Texts are read once, into blocks of about ``block_tokens``: each text as numbers of the
    block's distinct words, and the block's distinct n-grams with their counts. N-grams go to
    shards by hash, where counts of all blocks are added, and each block gets back the totals
    of its own. So only distinct n-grams of blocks cross the network, a frequent n-gram is one
    entry in each block, and shards hold about ``shard_entries`` for any corpus.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, as the
    unigram base (add one half) defines them.

    Defined results: a null or empty text is one end token; a null id is not held out and
    trains; repeated rows count and score each; without training rows all probabilities are
    uniform over one type; no rows give no rows; other columns are ignored. Words are compared
    by 64-bit hash, bigrams by ``gram_bits`` of theirs.
    """
    spark = docs.sparkSession
    which = fold("doc_id", train_folds)
    source = docs.select(
        F.col("doc_id").cast("bigint").cast("string").alias("doc_id"),  # exact beside nulls in pandas
        F.col(text).cast("string").alias("text"),
        F.when(which == held, F.lit(2)).when(which == deleted, F.lit(1)).otherwise(F.lit(0)).alias("role"),
    )
    # Enough shards for a new bigram every eight characters, counted once in each block.
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 << max(3, int(np.ceil(np.log2(max(1.0, chars / 8 / shard_entries)))))
    shard_bits = int(np.log2(shards))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        rows: list[tuple] = []
        held_tokens: list[np.ndarray] = []
        size = 0

        def block() -> Iterator[pd.DataFrame]:
            name = uuid.uuid4().hex
            flat = np.concatenate(held_tokens)
            words, ids = np.unique(flat, return_inverse=True)
            sizes = np.array([n for _, _, n in rows])
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            role = np.repeat([r for _, r, _ in rows], sizes)
            parts: dict[str, list] = {"shard": [], "gram": [], "size": [], "keys": [], "train": [], "deleted": [], "every": []}
            grams = _bigrams(ids, offsets, words, gram_bits)
            bi, at = np.unique(grams, return_inverse=True)
            every = np.bincount(ids, minlength=len(words))
            # Texts of the deleted fold number only the bigrams that this fold has here.
            deleted_at = np.cumsum(np.bincount(at[role == 1], minlength=len(bi)) > 0) - 1
            rank = np.empty(len(words), np.int64)
            rank[_by_frequency(every)] = np.arange(len(words))
            for gram, distinct, where, bits in ((1, words, ids, 64), (2, bi, at, gram_bits)):
                top = np.uint64(bits - shard_bits)
                train = np.bincount(where[role < 2], minlength=len(distinct))
                out = np.bincount(where[role == 1], minlength=len(distinct))
                cuts = np.searchsorted(distinct >> top, np.arange(shards + 1, dtype=np.uint64))
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        parts["shard"].append(s)
                        parts["gram"].append(gram)
                        parts["size"].append(b - a)
                        parts["keys"].append(_keys(distinct[a:b]))
                        parts["train"].append(_packed(train[a:b]))
                        parts["deleted"].append(_packed(out[a:b]))
                        parts["every"].append(_packed(every[a:b]) if gram == 1 else None)
            yield pd.DataFrame({"block": name, "doc_id": None, "role": -1, "ids": None, "grams": None, **parts})
            yield pd.DataFrame(
                {
                    "block": name,
                    "doc_id": [d for d, _, _ in rows],
                    "role": [r for _, r, _ in rows],
                    "ids": [_planes(rank[ids[a:b]], 4) for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
                    "grams": [
                        _planes(deleted_at[at[a:b]], 4) if r == 1 else None
                        for (_, r, _), a, b in zip(rows, offsets[:-1], offsets[1:], strict=True)
                    ],
                    "shard": -1, "gram": 0, "size": sizes, "keys": None, "train": None, "deleted": None, "every": None,
                }
            )

        for batch in batches:
            bodies, roles = batch["text"].tolist(), batch["role"].tolist()
            names = batch["doc_id"].tolist()
            for part in chunks(bodies, _CHUNK):
                flat, offsets = _tokens(bodies[part])
                held_tokens.append(flat)
                rows += zip(names[part], roles[part], np.diff(offsets).tolist(), strict=True)
                size += len(flat)
                if size >= block_tokens:
                    yield from block()
                    rows, held_tokens, size = [], [], 0
        if rows:
            yield from block()

    schema = (
        "block string, doc_id string, role int, ids binary, grams binary, shard int, gram int, "
        "size bigint, keys binary, train binary, deleted binary, every binary"
    )
    read_once = saved(source.mapInPandas(read, schema), "blocks")

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["size"].to_numpy()
        keys = [_hashes(k) for k in group["keys"]]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = []
        for column in ("train", "deleted"):
            each = np.concatenate([_unpacked(c) for c in group[column]])
            sums.append(np.bincount(at, weights=each, minlength=len(distinct)).astype(np.int64))
        asked = each > 0
        del each
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        known = sums[0] > 0
        # What is left without the deleted fold: of bigrams, those that the block asks for.
        rest, left = sums[0] - sums[1], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = rest[at[a:b]]
            left.append(_packed(here if key[1] == 1 else here[asked[a:b]]))
        out = pd.DataFrame(
            {
                "block": group["block"],
                "shard": group["shard"],
                "gram": group["gram"],
                "keys": group["keys"].where(group["gram"] == 1, None),
                "every": group["every"],
                "train": [_packed(sums[0][at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                "left": left,
                "tokens": 0, "types": 0, "out": 0,
            }
        )
        if len(out) and key[1] == 1:
            out.loc[out.index[0], ["tokens", "types", "out"]] = [sums[0].sum(), known.sum(), sums[1].sum()]
        return out

    answers = saved(
        read_once.filter("role = -1")
        .select("block", "shard", "gram", "size", "keys", "train", "deleted", "every")
        .groupBy("shard", "gram")
        .applyInPandas(
            total,
            "block string, shard int, gram int, keys binary, every binary, train binary, "
            "left binary, tokens bigint, types bigint, out bigint",
        ),
        "counts",
    )
    sums = answers.agg(F.sum("tokens"), F.sum("types"), F.sum("out")).first()
    n_train, n_types, n_deleted = (int(s or 0) for s in sums)
    floor = 1.0 / (n_types + 1)

    def joined(found: pd.DataFrame, gram: int, column: str) -> np.ndarray:
        part = found[found["gram"] == gram].sort_values("shard")
        return np.concatenate([_unpacked(c) for c in part[column]])

    def numbers(docs_of: pd.DataFrame, found: pd.DataFrame) -> tuple:
        """Word numbers of a block's texts, those before them, and where each text starts."""
        every = joined(found, 1, "every")
        by_rank = _by_frequency(every)
        ids = by_rank[np.concatenate([_numbers(i, 4) for i in docs_of["ids"]]).astype(np.int64)]
        offsets = np.concatenate(([0], np.cumsum(docs_of["size"].to_numpy())))
        before = np.concatenate((ids[:1], ids[:-1]))
        before[offsets[:-1]] = ids[offsets[1:] - 1]  # every text ends with the end token
        return ids, before, offsets

    def probabilities(ids, before, at, unigram, bigram, tokens: int) -> tuple:
        context = unigram[before]
        p2 = bigram[at] / np.maximum(context, 1)
        p1 = unigram[ids] / max(tokens, 1)
        bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
        return np.minimum(bucket, _BUCKETS - 1), p2, p1

    def events(docs_of: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(docs_of):
            return pd.DataFrame({"cell": [], "n": []})
        ids, before, _ = numbers(docs_of, found)
        at = np.concatenate([_numbers(g, 4) for g in docs_of["grams"]]).astype(np.int64)
        left = [joined(found, g, "left") for g in (1, 2)]
        bucket, p2, p1 = probabilities(ids, before, at, *left, n_train - n_deleted)
        cells, n = np.unique((bucket * _BINS + _bins(p2)) * _BINS + _bins(p1), return_counts=True)
        return pd.DataFrame({"cell": cells, "n": n})

    deleted_texts = read_once.filter("role = 1").select("block", "ids", "grams", "size")
    deleted_counts = answers.select("block", "shard", "gram", "every", "left")
    cells = (
        deleted_texts.groupBy("block")
        .cogroup(deleted_counts.groupBy("block"))
        .applyInPandas(events, "cell bigint, n bigint")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most _BUCKETS * _BINS**2 cells, in practice some thousand
    )
    at = cells["cell"].to_numpy(np.int64)
    split = np.column_stack([at // _BINS**2, at // _BINS % _BINS, at % _BINS])
    weights = fit_weights(split, cells["n"].to_numpy(float), floor)

    def score(docs_of: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(docs_of):
            return pd.DataFrame({c.split()[0]: [] for c in out_schema.split(", ")})
        ids, before, offsets = numbers(docs_of, found)
        one = found[found["gram"] == 1].sort_values("shard")
        words = np.concatenate([_hashes(k) for k in one["keys"]])
        at = np.unique(_bigrams(ids, offsets, words, gram_bits), return_inverse=True)[1]
        unigram, bigram = joined(found, 1, "train"), joined(found, 2, "train")
        bucket, p2, p1 = probabilities(ids, before, at, unigram, bigram, n_train)
        count, w = unigram[ids], weights[bucket]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * floor
        base = np.log10((count + 0.5) / (n_train + 0.5 * (n_types + 1)))
        heads = offsets[:-1]
        return pd.DataFrame(
            {
                "doc_id": docs_of["doc_id"],
                "held_out": docs_of["role"] == 2,
                "n_tokens": np.diff(offsets),
                "n_known": np.add.reduceat(count > 0, heads, dtype=np.int64),
                "train_tokens": n_train,
                "base_score": np.add.reduceat(base, heads),
                "score": np.add.reduceat(np.log10(np.maximum(p, 1e-300)), heads),
            }
        )

    out_schema = (
        "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    texts = read_once.filter("role >= 0").select("block", "doc_id", "role", "ids", "size")
    counts = answers.select("block", "shard", "gram", "keys", "every", "train")
    scored = texts.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(score, out_schema)
    return scored.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
