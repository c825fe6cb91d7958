"""Source divergence against a plain version in whole numbers."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from texts import LOWER

from cloudmill.llm import source_divergence as module
from cloudmill.llm.source_divergence import TermShard, shares, source_divergence


def plain(rows, top=200, least=3):
    """Sorted result for (text, lang, source) rows."""
    found = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    held = {lang: Counter() for lang, _, _ in found}
    for lang, _, terms in found:
        held[lang].update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in held.items()}
    counts = {}
    for lang, source, terms in found:
        counts.setdefault((lang, source), Counter()).update(t for t in terms if t in kept[lang])
    out = []

    def p(c, t, n, v):
        return 1 + 10**9 * (c[t] + 1) // (n + v)

    def ranked(lang, source, part, items, limit):
        items.sort(key=lambda x: (-x[1], x[0].encode()))
        out.extend((lang, source, part, i, v, r) for r, (i, v) in enumerate(items[:limit], 1))

    for (lang, source), c in counts.items():
        v, n = len(kept[lang]), sum(c.values())
        whole = Counter()
        pairs = []
        for (other, name), d in counts.items():
            if other != lang:
                continue
            whole.update(d)
            if name != source:
                m = sum(d.values())
                pairs.append((name, sum((p(c, t, n, v) - p(d, t, m, v)) ** 2 // p(d, t, m, v) for t in kept[lang])))
        ranked(lang, source, "pair", pairs, None)
        total = sum(whole.values())
        terms = [(t, p(c, t, n, v), p(whole, t, total, v)) for t in c]
        ranked(lang, source, "term", [(t, (a - q) ** 2 // q) for t, a, q in terms if a > q], top)
    return sorted(out)


def collected(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_shares_are_exact():
    for total in (1, 3, 10**6, 10**12 + 39, 9 * 10**15):
        counts = np.array([c for c in (0, 1, total // 3, total // 2 + 1, total - 1)], dtype=np.int64)
        assert shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_terms_are_verified():
    shard = TermShard.from_bytes(*TermShard.build([b"one", b"two", "dreiß".encode()]).to_bytes())
    slots = shard.slots([b"two", b"three", b"one", "dreiß".encode(), b"tw"])
    assert sorted(slots[[0, 2, 3]]) == [0, 1, 2] and slots[1] == slots[4] == -1
    assert shard.term(int(slots[0])) == b"two"


def test_odd_rows_equal_a_plain_version(spark, rows, no_docs, monkeypatch):
    texts = [(t, lang, source) for _, t, lang, source, *_ in rows]
    texts += [("only here and there", "xx", "a")] * 2 + [(None, "yy", None), ("", "yy", "b"), ("12 3", "yy", "c")]
    texts += [("Mixed İ CASE K ta ron", "en", "s1")] * 400 + [("ta", "", ""), (" ta ta ", None, None), ("TA", "", "z"), ("ta", "", "z")]
    docs = spark.createDataFrame(texts, "text string, lang string, source string").repartition(6)
    docs = docs.withColumns({c: F.lit("x") for c in ("term", "shard", "value", "item", "keys", "doc_id")})
    want = plain(texts)
    assert {r[2] for r in want} == {"pair", "term"} and max(r[4] for r in want) > 1000
    assert collected(source_divergence(docs)) == want
    # Several shards, waves and slices, and few ranks.
    monkeypatch.setattr(module, "_SLICE", 7)
    monkeypatch.setattr(module, "_CELLS", 50)
    assert collected(source_divergence(docs, shard_terms=40, wave_bytes=900, top=5)) == plain(texts, top=5)
    assert source_divergence(no_docs).count() == 0
