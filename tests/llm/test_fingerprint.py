import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cloudmill.llm.fingerprint import (
    PARAGRAPH,
    THIN,
    WIDE,
    combine,
    fingerprint_edits,
    sum_lanes,
    with_next,
)


def plain(text):
    """Counters and fingerprint of a text, paragraph by paragraph."""
    wide, thin, items = [0] * WIDE, [0] * THIN, 0
    seen = {}
    for p in re.split(PARAGRAPH, text):
        seen[p] = seen.get(p, 0) + 1
    for p, n in seen.items():
        first = xxhash.xxh64_intdigest(p.encode(), 42)
        hashes = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), first) for k in (*range(WIDE // 2), WIDE)]
        for k, h in enumerate(hashes[:-1]):
            wide[2 * k] = (wide[2 * k] + n * (h & 0xFFFFFFFF)) % 2**32
            wide[2 * k + 1] = (wide[2 * k + 1] + n * (h >> 32)) % 2**32
        for k in range(THIN):
            thin[k] += n * (hashes[-1] >> k & 1)
        items += n
    pairs = (a | b << 31 for a, b in zip(thin[::2], thin[1::2]))
    digits = ["".join(f"{w:08x}" for w in wide), "".join(f"{p:016x}" for p in pairs), f"{items:x}"]
    return "-".join(digits), 2.0 * np.array(thin) - items


def alike(a, b):
    (left, u), (right, v) = plain(a), plain(b)
    size = np.sqrt((u @ u) * (v @ v))
    return 1.0 if left == right else min(max(u @ v / size if size else 0.0, 0.0), 1.0)


def test_fingerprints_equal_a_plain_version(docs, rows):
    got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    texts = [r[1] or "" for r in rows]
    for k, (i, *_) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[i]
        assert r.fingerprint == plain(t)[0] and r.edited_fingerprint == plain(edited)[0]
        assert abs(r.near_edited - alike(t, edited)) < 1e-9
        assert abs(r.near_next - alike(t, following)) < 1e-9


def test_more_paragraphs_than_a_million(spark):
    many = "\n" * 1_500_000 + "a\nb"
    rows = [(1, many), (2, "a\nb" + "\n" * 1_500_000), (3, "b\nc")]
    got = [r for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got[0].fingerprint == plain(many)[0] == got[1].fingerprint and got[0].near_next == 1
    assert abs(got[1].near_next - alike(many, "b\nc")) < 1e-9


def test_groups_follow_crowded_ids(spark):
    ids = [*range(9000), 2**62, -(2**61), None, *(10**9 + 7 * k for k in range(3000))]
    rows = [(i, f"text {i}. more\nof {i}") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    dealt, _ = with_next(docs, "doc_id", per_group=500)
    sizes = [r["count"] for r in dealt.groupBy("_group").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 1600
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_edits_order_and_equality(docs, rows):
    got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    texts = [r[1] or "" for r in rows]
    for k, (i, *_) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + following[:quarter]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
    by_text = {}
    for (i, *_), t in zip(rows, texts):
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({v.copy().pop() for v in by_text.values()}) == len(by_text)


def test_paragraph_order_insertion_and_deletion(spark):
    items = [(1, p) for p in "abcb"] + [(2, p) for p in "bbca"] + [(3, p) for p in "abc"] + [(4, "b")]
    v = sum_lanes(spark.createDataFrame(items, "k int, paragraph string"), ["k"])
    got = {r.k: r.vector for r in v.collect()}
    assert got[1] == got[2] != got[3]
    three, four, one = (v.filter(F.col("k") == k).select(F.col("vector").alias(f"v{k}")) for k in (3, 4, 1))
    both = three.join(four, F.lit(True)).join(one, F.lit(True))
    row = both.select(combine(F.col("v3"), F.col("v4")).alias("more"), combine(F.col("v1"), F.col("v4"), -1).alias("less")).first()
    assert row.more == got[1] and row.less == got[3]


def test_no_rows_one_row_null_and_equal_ids(spark, no_docs):
    assert fingerprint_edits(no_docs).count() == 0
    one = fingerprint_edits(spark.createDataFrame([(5, "abcdefgh")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1
    odd = spark.createDataFrame([(None, "a"), (2**62, "b"), (-(2**62), None), (1, "c"), (1, "c")], "doc_id bigint, text string")
    assert fingerprint_edits(odd).count() == 5


def test_no_python_in_the_plan(docs):
    plan = fingerprint_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
