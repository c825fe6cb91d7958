"""Classifiers on held-out rows, the chain against all label sequences, gradients by differences."""

import itertools

import numpy as np
import pandas as pd
import pytest

from cloudmill.llm import quality, toxicity
from cloudmill.llm.common import fold
from cloudmill.llm.toxicity import Windows


def labelled(spark, sf, target):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.join(labels, "doc_id", "left_semi")
    return docs, labels, {r.doc_id: r[target] for r in labels.collect()}


@pytest.mark.parametrize(
    ("sf", "target", "classify", "column", "score"),
    [
        ("sf0.01", "quality", quality.classify_quality, "quality_kept", "quality_score"),
        # The smallest table with enough toxic rows to learn from.
        ("sf0.1", "toxic", toxicity.classify_toxicity, "toxic", "toxic_score"),
    ],
)
def test_held_out_rows_are_told_apart(spark, sf, target, classify, column, score):
    docs, labels, truth = labelled(spark, f"/root/testdata/{sf}", target)
    held = docs.filter(fold("doc_id", 3) == 1).select("doc_id").collect()
    got = {r.doc_id: (int(r[column]), r[score]) for r in classify(docs, labels).collect()}
    right = np.mean([got[r.doc_id][0] == truth[r.doc_id] for r in held])
    assert len(got) == len(truth) and right > 0.97
    scores = {y: np.array([got[r.doc_id][1] for r in held if truth[r.doc_id] == y]) for y in (0, 1)}
    above = scores[1][:, None] - scores[0][None, :]
    assert ((above > 0) + 0.5 * (above == 0)).mean() > 0.95  # area under the curve


def test_edge_rows_and_missing_labels(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for classify, score, flat in (
        (quality.classify_quality, "quality_score", 0.5),
        (toxicity.classify_toxicity, "toxic_score", 0.0),
    ):
        out = classify(docs, labels)
        assert {r[score] for r in out.collect()} == {flat} and set(docs.columns) < set(out.columns)
        assert classify(no_docs, labels).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    offsets = np.array([0, 1, 4, 9])
    chain = quality.LineChain(None, None, None, 0.0, rng.normal(size=(2, 2)))
    unary = rng.normal(size=9)
    good, pairs, log_z = chain.marginals(unary, offsets)
    total, want_pairs = 0.0, np.zeros((2, 2))
    for a, b in zip(offsets[:-1], offsets[1:]):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            steps = sum(chain.steps[p, q] for p, q in zip(y, y[1:]))
            weights[y] = np.exp(steps + sum(u for u, k in zip(unary[a:b], y) if k))
        z = sum(weights.values())
        total += np.log(z)
        for k in range(b - a):
            assert good[a + k] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / z)
        for y, w in weights.items():
            for p, q in zip(y, y[1:]):
                want_pairs[p, q] += w / z
    assert log_z == pytest.approx(total) and np.allclose(pairs, want_pairs)


def test_line_features_of_odd_texts():
    x, lengths, offsets = quality.line_features([None, "", "a\n\nA B", "é" * 3])
    assert offsets.tolist() == [0, 1, 2, 5, 6] and lengths.tolist() == [1, 1, 2, 1, 4, 4]
    assert np.isfinite(x).all()


def test_windows_cover_every_word():
    text = " ".join(f"w{i}" for i in range(100))
    w = Windows([text, None, "one", text])
    assert w.offsets.tolist() == [0, 4, 5, 6, 10] and w.count == 101
    assert set(w.index[:4].ravel()) - {w.count} == set(w.index[6:].ravel()) - {w.count}
    assert (w.index[4] == w.count).all()


def test_window_logits_equal_a_plain_forward_pass():
    p = {k: v.astype(np.float64) for k, v in toxicity._start(2).items()}
    w = Windows(["Some BAD words, in a row " * 9, None, "others (here) that are fine"])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    want = []
    for window in w.index:
        inputs = []
        for k in window[window < w.count]:
            chars = p["char"][w.char_rows[w.heads[k] : w.heads[k] + w.sizes[k]]].mean(axis=0)
            stems = np.mean([p["stem"][r] for r in w.stem_rows[k]], axis=0)
            inputs.append(np.concatenate([p["word"][w.word_rows[k]], chars, stems]))
        n = toxicity._H
        sides = []
        for side, order in (("f", inputs), ("b", inputs[::-1])):
            h, states = np.zeros(n), []
            for x in order:
                own, past = x @ p[f"W{side}"] + p[f"c{side}"], h @ p[f"U{side}"]
                z, r = sigmoid(own[:n] + past[:n]), sigmoid(own[n : 2 * n] + past[n : 2 * n])
                h = (1 - z) * h + z * np.tanh(own[2 * n :] + r * past[2 * n :])
                states.append(h)
            sides.append(states if side == "f" else states[::-1])
        if not inputs:
            want.append(p["bo"][0])
            continue
        states = np.array([np.concatenate(both) for both in zip(*sides)])
        e = np.exp(np.tanh(states @ p["Wa"] + p["ba"]) @ p["va"])
        want.append((e / e.sum()) @ states @ p["wo"] + p["bo"][0])
    assert np.allclose(toxicity.window_logits(p, w), want, atol=1e-4)


def test_gradients_equal_differences():
    p = {k: v.astype(np.float64) for k, v in toxicity._start(1).items()}
    w = Windows(["some bad words, in a row", "others here that are fine"])
    y, each = np.array([1.0, 0.0]), np.array([1.0, 1.0])

    def loss():
        z = toxicity.window_logits(p, w)
        return float((np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)).mean())

    g = toxicity._gradients(p, w, w.index, y, each)
    for name in ("Uf", "Wb", "cf", "Wa", "va", "wo", "bo", *toxicity._ROWS):
        at = tuple(0 for _ in p[name].shape)
        if name in toxicity._ROWS:
            rows, values = g[name]
            at = (int(rows[0]), 0)
            g[name] = {at: values[0, 0]}
        kept, h = p[name][at], 1e-2
        p[name][at] = kept + h
        up = loss()
        p[name][at] = kept - h
        down = loss()
        p[name][at] = kept
        assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-5), name


def test_toxicity_scores_few_texts_at_a_time(spark, monkeypatch):
    """What a Python worker holds at once is bounded, whatever a batch holds."""
    held, windows = [], toxicity.Windows

    def counted(texts):
        held.append(sum(map(len, texts)))
        return windows(texts)

    monkeypatch.setattr(toxicity, "Windows", counted)
    texts = pd.Series([f"word{i % 7} " * 1000 for i in range(60)])
    got = pd.concat(list(toxicity.toxicity_score(toxicity._start(7)).func(iter([texts]))))
    assert len(got) == 60 and sum(held) == texts.str.len().sum() and max(held) <= 110_000
