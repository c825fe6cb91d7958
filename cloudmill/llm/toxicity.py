"""Toxicity from a bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import Words, chunks, fold, labelled_sample, table

WINDOW, STRIDE = 32, 24  # words in a window; words between two windows' starts
_WORD_ROWS, _CHAR_ROWS, _STEM_ROWS = 1 << 14, 1 << 13, 1 << 15
_STEMS = (4, 5, 6, 7, 8)  # bytes at a word's beginning that are inputs of their own
_EW, _EC, _ES = 8, 8, 8  # sizes of inputs: word, runs of three bytes, beginnings
_H, _A = 16, 16  # sizes of states and attention
_X = _EW + _EC + _ES
_ROWS = {"word": (_WORD_ROWS, _EW), "char": (_CHAR_ROWS, _EC), "stem": (_STEM_ROWS, _ES)}
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[list(range(0x61, 0x7B)) + list(range(0x30, 0x3A)) + list(range(0x80, 0x100))] = True

Params = dict[str, np.ndarray]


class Windows:
    """Texts as overlapping windows over their distinct words.

    ``index`` has a row for each window; its entries point at distinct words, of which the
    last stands for "no word". ``owner`` is each window's text. A text without words has one
    empty window. A word's inputs: its own hashed row, hashed rows of its three-byte runs (with
    its ends marked), and of its beginnings, all without marks around it.
    """

    def __init__(self, texts: list[str | None]) -> None:
        words = Words(texts)
        starts, ends = words.starts, words.ends
        solid = np.flatnonzero(_ALNUM[words.data])
        if len(starts) and len(solid):  # leave marks around a word out, if it has more
            first = np.minimum(np.searchsorted(solid, starts), len(solid) - 1)
            last = np.maximum(np.searchsorted(solid, ends) - 1, 0)
            some = (solid[first] >= starts) & (solid[first] < ends)
            starts = np.where(some, solid[first], starts)
            ends = np.where(some, solid[last] + 1, ends)
        hashes = words.hashes(starts, ends)
        distinct, at, row = np.unique(hashes, return_index=True, return_inverse=True)
        self.count = len(distinct)
        self.word_rows = (distinct & np.uint64(_WORD_ROWS - 1)).astype(np.int32)
        starts, ends = starts[at], ends[at]
        stems = [words.hashes(starts, np.minimum(starts + k, ends)) for k in _STEMS]
        self.stem_rows = (np.stack(stems, axis=1) & np.uint64(_STEM_ROWS - 1)).astype(np.int32)
        self.sizes = ends - starts  # a word of n bytes has n runs of three with its ends
        heads = np.concatenate(([0], np.cumsum(self.sizes)))
        self.heads = heads[:-1]
        place = np.arange(heads[-1]) - np.repeat(self.heads, self.sizes)
        byte = np.repeat(starts, self.sizes) + place
        data = words.data.astype(np.uint64)
        final = place == np.repeat(self.sizes - 1, self.sizes)
        left = np.where(place == 0, np.uint64(1), data[byte - 1])
        right = np.where(final, np.uint64(2), data[np.minimum(byte + 1, len(data) - 1)])
        run = (left << np.uint64(16)) | (data[byte] << np.uint64(8)) | right
        self.char_rows = ((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int32)

        sizes = np.diff(words.offsets)
        per_text = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
        self.owner = np.repeat(np.arange(len(sizes)), per_text)
        begin = np.concatenate(([0], np.cumsum(per_text)))
        self.offsets = begin
        nth = np.arange(begin[-1]) - np.repeat(begin[:-1], per_text)
        head = np.repeat(words.offsets[:-1], per_text) + nth * STRIDE
        end = np.repeat(words.offsets[1:], per_text)
        where = head[:, None] + np.arange(WINDOW)
        row = np.append(row, self.count).astype(np.int32)
        self.index = row[np.where(where < end[:, None], where, len(row) - 1)]


def _start(seed: int) -> Params:
    rng = np.random.Generator(np.random.PCG64(seed))

    def draw(*shape: int, size: float = 1.0) -> np.ndarray:
        return (rng.standard_normal(shape) * size / np.sqrt(shape[0])).astype(np.float32)

    p = {
        **{k: (rng.standard_normal(shape) * 0.1).astype(np.float32) for k, shape in _ROWS.items()},
        "Wa": draw(2 * _H, _A),
        "ba": np.zeros(_A, np.float32),
        "va": draw(_A),
        "wo": draw(2 * _H),
        "bo": np.full(1, -2.0, np.float32),
    }
    for side in "fb":
        p[f"W{side}"] = draw(_X, 3 * _H)
        p[f"U{side}"] = draw(_H, 3 * _H)
        p[f"c{side}"] = np.zeros(3 * _H, np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _inputs(p: Params, w: Windows, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input vectors of some distinct words, with the runs they are made of and their owners."""
    sizes = w.sizes[rows]
    own = np.repeat(np.arange(len(rows)), sizes)
    heads = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    runs = w.char_rows[np.arange(len(own)) + np.repeat(w.heads[rows] - heads, sizes)]
    x = np.empty((len(rows), _X), np.float32)
    x[:, :_EW] = p["word"][w.word_rows[rows]]
    if len(rows):
        x[:, _EW : _EW + _EC] = np.add.reduceat(p["char"][runs], heads, axis=0) / sizes[:, None]
        x[:, _EW + _EC :] = p["stem"][w.stem_rows[rows]].mean(axis=1)
    return x, runs, own


def _projected(p: Params, x: np.ndarray, side: str) -> np.ndarray:
    """Gate inputs of words; the row behind them keeps a state as it is (no word)."""
    out = np.zeros((len(x) + 1, 3 * _H), np.float32)
    out[:-1] = x @ p[f"W{side}"] + p[f"c{side}"]
    out[-1, :_H] = -60.0
    return out


def _run(
    p: Params, gates: np.ndarray, index: np.ndarray, side: str, keep: list | None = None
) -> np.ndarray:
    """States of one direction, [steps, windows, _H]: h <- (1 - z) h + z n."""
    u = p[f"U{side}"]
    steps = range(index.shape[1])
    h = np.zeros((len(index), _H), np.float32)
    out = np.empty((index.shape[1], len(index), _H), np.float32)
    for t in steps if side == "f" else reversed(steps):
        x = gates[index[:, t]]
        hu = h @ u
        zr = _sigmoid(x[:, : 2 * _H] + hu[:, : 2 * _H])
        z, r = zr[:, :_H], zr[:, _H:]
        n = np.tanh(x[:, 2 * _H :] + r * hu[:, 2 * _H :])
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * _H :]))
        h = h + z * (n - h)
        out[t] = h
    return out


def _attend(p: Params, states: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Attention-pooled logit of each window."""
    a = np.tanh(states @ p["Wa"] + p["ba"])
    s = a @ p["va"]
    s[absent] = -1e9
    s -= s.max(axis=0)
    e = np.exp(s)
    weight = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ p["wo"] + p["bo"][0], a, weight, pooled


def window_logits(p: Params, w: Windows, block: int = 2048) -> np.ndarray:
    """Logits of all windows, ``block`` at a time."""
    x = _inputs(p, w, np.arange(w.count))[0]
    forward, backward = _projected(p, x, "f"), _projected(p, x, "b")
    out = np.empty(len(w.index), np.float32)
    for i in range(0, len(out), block):
        index = w.index[i : i + block]
        states = np.concatenate(
            [_run(p, forward, index, "f"), _run(p, backward, index, "b")], axis=2
        )
        out[i : i + block] = _attend(p, states, (index == w.count).T)[0]
    return out


def _gradients(
    p: Params,
    w: Windows,
    index: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    keep: Callable[[int], np.ndarray] | None = None,
) -> Params:
    """Gradients of the weighted logistic loss of some windows, by hand.

    ``keep`` gives, for n words, the factors (0 or more) that their inputs are taken by.
    """
    rows, local = np.unique(index, return_inverse=True)
    local = local.reshape(index.shape)
    rows = rows[rows < w.count]
    x, runs, own = _inputs(p, w, rows)
    factors = keep(len(rows)) if keep else np.ones((1, 1), np.float32)
    x *= factors
    kept: dict[str, list] = {"f": [], "b": []}
    parts = [_run(p, _projected(p, x, s), local, s, kept[s]) for s in "fb"]
    states = np.concatenate(parts, axis=2)
    logit, a, attention, pooled = _attend(p, states, (local == len(rows)).T)
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in _ROWS}
    d_logit = (_sigmoid(logit) - y) * weight / len(y)
    g["bo"][0] = d_logit.sum()
    g["wo"] = pooled.T @ d_logit
    d_pooled = d_logit[:, None] * p["wo"]
    d_states = attention[:, :, None] * d_pooled
    d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
    d_s = attention * (d_weight - (attention * d_weight).sum(axis=0))
    g["va"] = np.einsum("tn,tna->a", d_s, a)
    d_a = d_s[:, :, None] * p["va"] * (1 - a * a)
    g["ba"] = d_a.sum(axis=(0, 1))
    g["Wa"] = np.einsum("tnh,tna->ha", states, d_a)
    d_states = d_states + d_a @ p["Wa"].T
    d_x = np.zeros_like(x)
    for k, side in enumerate("fb"):
        u = p[f"U{side}"]
        d_gates = np.zeros((len(rows) + 1, 3 * _H), np.float32)
        by_step = np.empty((index.shape[1], len(index), 3 * _H), np.float32)
        carry = np.zeros((len(index), _H), np.float32)
        for t, before, z, r, n, hun in reversed(kept[side]):
            d_h = d_states[t, :, k * _H : (k + 1) * _H] + carry
            d_n = d_h * z * (1 - n * n)
            d_z = d_h * (n - before) * z * (1 - z)
            d_r = d_n * hun * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g[f"U{side}"] += before.T @ d_hu
            carry = d_h * (1 - z) + d_hu @ u.T
            by_step[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        at, total = _summed(local.T.ravel(), by_step.reshape(-1, 3 * _H))
        d_gates[at] = total
        d_gates = d_gates[:-1]
        g[f"W{side}"] = x.T @ d_gates
        g[f"c{side}"] = d_gates.sum(axis=0)
        d_x += d_gates @ p[f"W{side}"].T
    d_x *= factors
    # Embedding rows: (rows, gradients), summed where rows repeat.
    g["word"] = _summed(w.word_rows[rows], d_x[:, :_EW])
    d_char, d_stem = d_x[:, _EW : _EW + _EC], d_x[:, _EW + _EC :]
    g["char"] = _summed(runs, (d_char / np.maximum(w.sizes[rows], 1)[:, None])[own])
    each = np.repeat(d_stem / len(_STEMS), len(_STEMS), axis=0)
    g["stem"] = _summed(w.stem_rows[rows].ravel(), each)
    return g


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))[: len(rows)]
    return rows[heads], np.add.reduceat(values[order], heads, axis=0)


def fit_toxicity(
    texts: list[str],
    y: np.ndarray,
    epochs: int = 10,
    batch: int = 32,
    seed: int = 7,
    dropped: float = 0.3,
) -> Params | None:
    """Train on whole texts: a text is as toxic as its most toxic window.

    Each step scores all windows of ``batch`` texts and learns from the highest of each toxic
    text and the three highest of each other. A share of ``dropped`` of the words' inputs (of
    each of the three kinds) is left out, so that no kind is relied on alone. Classes weigh the
    same. None without both classes.
    """
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    p = _start(seed)
    slow = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in _ROWS}
    rows = {k: np.full(len(p[k]), 1e-8, np.float32) for k in _ROWS}
    balance = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    step = 0
    kinds = np.repeat(np.arange(3), [_EW, _EC, _ES])

    def keep(n: int) -> np.ndarray:
        drawn = rng.random((n, 3)) >= dropped
        return (drawn / np.float32(1 - dropped)).astype(np.float32)[:, kinds]

    shuffled = rng.permutation(len(texts))
    parts = [shuffled[i : i + batch] for i in range(0, len(shuffled), batch)]
    ready = [(part, Windows([texts[j] for j in part])) for part in parts]
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        for k in rng.permutation(len(ready)):
            part, w = ready[k]
            logits = window_logits(p, w)
            order = np.lexsort((-logits, w.owner))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - w.offsets[w.owner[order]]
            label = y[part][w.owner]
            top = np.flatnonzero(rank < np.where(label == 1, 1, 3))
            each = balance[part][w.owner[top]]
            g = _gradients(p, w, w.index[top], label[top].astype(np.float32), each, keep)
            step += 1
            for k, (m, v) in slow.items():
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                p[k] -= (rate * 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            for k, seen in rows.items():
                at, grad = g[k]
                seen[at] += (grad**2).mean(axis=1)
                p[k][at] -= 5 * rate * grad / np.sqrt(seen[at])[:, None]
    return p


def toxicity_score(p: Params | None, prior: float = 0.0) -> Callable:
    """A column function: text to toxicity, 0 to 1, the highest of all overlapping windows'."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            out = np.full(len(texts), prior)
            if p is not None:
                for part in chunks(texts, 100_000):
                    w = Windows(texts[part])
                    high = np.maximum.reduceat(window_logits(p, w), w.offsets[:-1])
                    out[part] = _sigmoid(high.astype(np.float64))
            yield pd.Series(out)

    return score


def train_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = 1000, all_chars: int = 6_000_000, **fit
) -> Params | None:
    """Fit on at most ``per_class`` labelled documents of each class (see labelled_sample)."""
    got = labelled_sample(docs, labels, "toxic", per_class, all_chars).toPandas().sort_values("id")
    return fit_toxicity(got["text"].tolist(), got["y"].to_numpy(), **fit)


def classify_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit
) -> DataFrame:
    """``docs`` with columns toxic_score and toxic (score >= ``threshold``).

    The network reads every overlapping window of every text; a text scores as its highest
    window. Learns from rows of ``labels`` whose id's crc32 is not 1 modulo 3; only the text is
    an input.

    Defined results: null or empty texts score as one window without words; repeated rows
    alike; without labels of both classes every score is 0; empty tables give empty tables;
    other columns pass unchanged, and columns of the two new names are replaced.
    """
    score = toxicity_score(train_toxicity(docs, labels, **fit))
    scored = docs.withColumn("toxic_score", score(F.col("text")))
    return scored.withColumn("toxic", F.col("toxic_score") >= threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic").cast("int").alias("predicted"),
    )
