"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from texts import LOWER

from cloudmill.llm.resampling import WordRuns, op12_importance_resampling, ranked, resample

DOCUMENTS = "/root/testdata/sf0.001"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(rows, target):
    """{row number: (n_features, weight, score, rank)} of (doc_id, text) rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    found = [features(t) for _, t in rows]
    s = Counter(bucket(f) for _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
        for b in range(10000)
    ]
    out = {}
    for i, ((doc, _), (words, fs)) in enumerate(zip(rows, found, strict=True)):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(words), len(fs), weight, score, None]
    enough = [i for i in out if out[i][0] >= 20]
    order = sorted(enough, key=lambda i: (-out[i][3], rows[i][0] is None, rows[i][0] or 0, out[i][1], out[i][2]))
    for rank, i in enumerate(order[: 5 * len(enough) // 100], 1):
        out[i][4] = rank
    return out


def table_of(rows, out):
    null_last = lambda r: tuple((v is None, v or 0) for v in r)
    return sorted(((rows[i][0], *v[1:]) for i, v in out.items()), key=null_last)


def collected(df):
    got = [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    return sorted(got, key=lambda r: tuple((v is None, v or 0) for v in r))


def test_checksums_equal_the_library():
    texts = ["One, two three", None, "", "é" * 40 + " b " + "x" * 65 + " c", "a" * 64 + " " + "b" * 63, "…", "z9 日本 Ü"]
    texts += ["w " * 50 + "y" * 5000]
    got = Counter()
    for n, owner, crc in WordRuns(texts).checksums():
        got.update((n, int(o), int(c)) for o, c in zip(owner, crc, strict=True))
    want = Counter()
    for i, text in enumerate(texts):
        for f in features(text)[1]:
            want[(f.count(" ") + 1, i, zlib.crc32(f.encode()))] += 1
    assert got == want


def test_runs_go_on_over_blocks_of_words(monkeypatch):
    from cloudmill.llm import resampling

    texts = ["a b c d e f g", "h", "i j", "k l m n"]
    whole = Counter((n, int(o), int(c)) for n, os, cs in WordRuns(texts).checksums() for o, c in zip(os, cs))
    monkeypatch.setattr(resampling, "_GRAMS", 3)
    assert whole == Counter((n, int(o), int(c)) for n, os, cs in WordRuns(texts).checksums() for o, c in zip(os, cs))
    assert sum(whole.values()) == sum(len(features(t)[1]) for t in texts)


def test_whole_table_equals_plain_version(spark):
    docs = spark.read.parquet(f"{DOCUMENTS}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DOCUMENTS}/benchmark.parquet").collect()]
    want = plain(rows, target)
    assert sum(v[4] is not None for v in want.values()) >= 5
    assert collected(op12_importance_resampling(spark, DOCUMENTS)) == table_of(rows, want)


def test_odd_rows(spark, docs, rows, no_docs):
    target = spark.createDataFrame([("The target text 1 of a few words",), (None,)], "text string")
    texts = [(r[0], r[1]) for r in rows]
    more = [(None, "null id " * 12), (None, "null id " * 12), (3, "again " * 30), (3, "again " * 30)] + [(7, "copy of many words " * 9)] * 400
    schema = "doc_id bigint, text string"
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, schema)).repartition(5)
    both = both.withColumns({"score": F.lit("x"), "rank": F.lit(1), "n_words": F.lit(0)})  # clashing names
    assert collected(resample(both, target)) == table_of(texts + more, plain(texts + more, [r.text for r in target.collect()]))
    assert resample(no_docs, target).count() == 0
    assert resample(docs, target.limit(0)).count() == len(rows)


def test_ranks_of_many_equal_rows_and_any_runs(spark):
    rng = np.random.default_rng(5)
    data = [(int(rng.integers(0, 3000)), 30, 87, 1, int(s)) for s in rng.integers(0, 200, 4000)]
    data += [(9, 30, 87, 1, 150)] * 2000
    df = spark.createDataFrame(data, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    order = sorted(data, key=lambda r: (-r[4], r[0]))
    for parts, first in ((1, 6000), (7, 1500), (16, 1), (3, 0)):
        stored = df.repartition(parts).cache()
        got = sorted((r for r in ranked(stored, first).collect() if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, first + 1))
        assert [(r["doc_id"], r["score"]) for r in got] == [(r[0], r[4]) for r in order[:first]]
        assert ranked(stored, first).count() == len(data)
