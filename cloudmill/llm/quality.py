"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import Words, chunks, fold, labelled_sample, mixed, table

# Kinds of bytes that are counted in each line.
_KINDS = ("lower", "upper", "digit", "space", "stop", "bar", "shout", "symbol", "more", "foreign")
_KIND = np.full(256, _KINDS.index("symbol"), dtype=np.uint8)
_KIND[list(range(0x61, 0x7B))] = _KINDS.index("lower")
_KIND[list(range(0x41, 0x5B))] = _KINDS.index("upper")
_KIND[list(range(0x30, 0x3A))] = _KINDS.index("digit")
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _KINDS.index("space")
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = _KINDS.index("stop")
_KIND[ord("|")] = _KINDS.index("bar")
_KIND[ord("!")] = _KINDS.index("shout")
_KIND[list(range(0x80, 0xC0))] = _KINDS.index("more")  # later bytes of a character
_KIND[list(range(0xC0, 0x100))] = _KINDS.index("foreign")
_OWN = 15  # features of a line itself


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, lines' lengths in characters, and where each text's lines start.

    A line's features are its own and those of the lines before and after it in the text
    (zeros at the ends). An empty text has one empty line.
    """
    texts = [t or "" for t in texts]
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    breaks = np.flatnonzero(data == 0x0A)
    n = len(breaks)
    begin = np.concatenate(([0], breaks[:-1] + 1))
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(per_text)))
    kinds = _KIND[data]
    counts = np.column_stack(
        [np.add.reduceat(kinds == k, begin, dtype=np.int64) for k in range(len(_KINDS))]
    ).astype(np.float64)
    counts[:, _KINDS.index("symbol")] -= 1  # the line break
    chars = counts.sum(axis=1) - counts[:, _KINDS.index("more")]

    words = Words(["\n".join(texts)])
    h = words.hashes()
    at = np.searchsorted(begin, words.starts, side="right") - 1
    n_words = np.bincount(at, minlength=n).astype(np.float64)
    same = np.flatnonzero((h[1:] == h[:-1]) & (at[1:] == at[:-1]))
    repeats = np.bincount(at[1:][same], minlength=n)
    keys = np.sort((at.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
    distinct = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    # Lines that stand more than once in their text.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))
    first = np.searchsorted(at, np.arange(n + 1))
    doc_of = np.repeat(np.arange(len(texts)), per_text)
    content = mixed((sums[first[1:]] - sums[first[:-1]]) + doc_of.astype(np.uint64))
    _, where, times = np.unique(content, return_inverse=True, return_counts=True)

    size, some = np.maximum(chars, 1), np.maximum(n_words, 1)
    share = counts[:, [_KINDS.index(k) for k in _KINDS if k != "more"]] / size[:, None]
    own = np.column_stack(
        [
            share,
            np.log1p(chars),
            chars / some / 10,
            repeats / some,
            distinct / some,
            np.log1p(n_words),
            (times[where] > 1) & (n_words > 0),
        ]
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[offsets[:-1]] = 0
    after[offsets[1:] - 1] = 0
    return np.hstack([own, before, after]), chars + 1, offsets


@dataclass
class LineChain:
    """A two-label chain: label 1 (good) scores x.weights + bias, label 0 scores 0."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    steps: np.ndarray  # steps[a, b]: score of label b after label a
    slope: float = 1.0
    shift: float = 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def marginals(
        self, unary: np.ndarray, offsets: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward-backward: P(line is good), expected label pairs, sum of log partitions."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = offsets[:-1][order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), side="left")
        n = len(unary)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        score = np.column_stack([np.zeros(n), unary])
        for k, m in enumerate(live):
            i = heads[:m] + k
            if k == 0:
                alpha[i] = score[i]
            else:
                alpha[i] = score[i] + np.logaddexp(
                    alpha[i - 1, :1] + self.steps[0], alpha[i - 1, 1:] + self.steps[1]
                )
        for k in range(len(live) - 2, -1, -1):
            i = heads[: live[k + 1]] + k
            ahead = score[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(
                ahead[:, :1] + self.steps[:, 0], ahead[:, 1:] + self.steps[:, 1]
            )
        both = alpha + beta
        log_z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - log_z)
        inner = np.ones(n, dtype=bool)
        inner[offsets[1:] - 1] = False
        i = np.flatnonzero(inner)
        pairs = np.exp(
            alpha[i][:, :, None]
            + self.steps
            + (score[i + 1] + beta[i + 1])[:, None, :]
            - log_z[i][:, None, None]
        ).sum(axis=0)
        return good, pairs, float(log_z[offsets[:-1]].sum())

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """Share of good characters by length-weighted marginals, then a fitted logistic."""
        x, lengths, offsets = line_features(texts)
        good, _, _ = self.marginals(self.emissions(x), offsets)
        share = _weighted(good, lengths, offsets)
        return 1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift)))


def _weighted(good: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    heads = offsets[:-1]
    return np.add.reduceat(good * lengths, heads) / np.add.reduceat(lengths, heads)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_chain(
    x: np.ndarray,
    lengths: np.ndarray,
    offsets: np.ndarray,
    y: np.ndarray,
    rounds: int = 100,
    penalty: float = 2e-3,
) -> LineChain:
    """Maximum conditional likelihood by Adam; every line carries its document's label.

    Without both classes the chain is flat and every document gets 0.5.
    """
    width = 3 * _OWN
    if len(y) == 0 or len(set(y.tolist())) < 2:
        flat = LineChain(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
        flat.slope = 0.0
        return flat
    chain = LineChain(
        x.mean(axis=0), x.std(axis=0) + 1e-3, np.zeros(width), 0.0, np.zeros((2, 2))
    )
    z = (x - chain.mean) / chain.scale
    sizes = np.diff(offsets)
    target = np.repeat(y, sizes).astype(float)
    # Each class weighs the same, whatever its share of the sample.
    seen = np.array([((y == b) * (sizes - 1)).sum() for b in (0, 1)], dtype=float)
    params = np.zeros(width + 1 + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        chain.weights, chain.bias = params[:width], params[width]
        chain.steps = params[width + 1 :].reshape(2, 2)
        good, pairs, _ = chain.marginals(z @ chain.weights + chain.bias, offsets)
        error = (good - target) / len(y)
        observed = np.diag(seen)
        grad = np.concatenate(
            [z.T @ error, [error.sum()], ((pairs - observed) / len(y)).ravel()]
        )
        grad += penalty * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    chain.weights, chain.bias = params[:width], params[width]
    chain.steps = params[width + 1 :].reshape(2, 2)
    good, _, _ = chain.marginals(z @ chain.weights + chain.bias, offsets)
    u = _logit(_weighted(good, lengths, offsets))
    a = b = 0.0
    for _ in range(200):  # logistic regression of the label on the share of good text
        p = 1 / (1 + np.exp(-(a * u + b)))
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * u * u).sum() + 1e-2, (w * u).sum()], [(w * u).sum(), w.sum() + 1e-2]])
        g = np.array([((y - p) * u).sum() - 1e-2 * a, (y - p).sum() - 1e-2 * b])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    chain.slope, chain.shift = max(a, 0.0), b
    return chain


def train_quality(
    docs: DataFrame, labels: DataFrame, per_class: int = 800, all_chars: int = 8_000_000
) -> LineChain:
    """Fit on at most ``per_class`` labelled documents of each class (see labelled_sample).

    Features are computed by the executors; the driver gets those of the sample's lines.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, lengths, offsets = line_features(batch["text"].tolist())
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "y": batch["y"],
                    "x": [x[a:b].ravel() for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
                    "lengths": [
                        lengths[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                    ],
                }
            )

    sample = labelled_sample(docs, labels, "quality", per_class, all_chars)
    schema = "id bigint, y int, x array<double>, lengths array<double>"
    got = sample.mapInPandas(features, schema).toPandas().sort_values("id")
    if not len(got):
        return fit_chain(np.zeros((0, 0)), np.zeros(0), np.zeros(1, int), np.zeros(0))
    lengths = np.concatenate(got["lengths"].tolist())
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in got["lengths"]])))
    x = np.concatenate(got["x"].tolist()).reshape(len(lengths), 3 * _OWN)
    return fit_chain(x, lengths, offsets, got["y"].to_numpy())


def quality_score(model: LineChain) -> Callable:
    """A column function: text to quality, 0 to 1. A null text counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            out = np.empty(len(texts))
            for part in chunks(texts, 200_000):
                out[part] = model.quality(texts[part])
            yield pd.Series(out)

    return score


def classify_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit
) -> DataFrame:
    """``docs`` with columns quality_score and quality_kept (score >= ``threshold``).

    Lines are labelled good or bad by a conditional random field with neighbouring lines'
    features; the score is the share of good text by length. Learns from rows of ``labels``
    whose id's crc32 is not 1 modulo 3; only the text is an input.

    Defined results: null or empty texts score as one empty line; repeated rows alike; without
    labels of both classes every score is 0.5; empty tables give empty tables; other columns
    pass unchanged, and columns of the two new names are replaced.
    """
    score = quality_score(train_quality(docs, labels, **fit))
    scored = docs.withColumn("quality_score", score(F.col("text")))
    return scored.withColumn("quality_kept", F.col("quality_score") >= threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_kept").cast("int").alias("predicted"),
    )
