import random
import re

import pytest
from texts import LOWER

from cloudmill.llm.license_scan import PHRASES, TEMPLATES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "Released under the MIT License.", "mit-license MIT\nLicense apache license",
    "intro\nLicensed under the Apache License, Version 2.0.\nmore", "under license apache the licensed",
    "w " * 500 + "This work is licensed under the GNU General Public License, version 3. " + "z " * 300,
    "Licensed under CC BY-NC 4.0.", "Permission granted free of charge to any person obtaining a copy of this software and associated files",
]


def test_equal_to_plain_search(spark, rows):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + r[0], r[1]) for r in rows]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=("doc_id",)).collect()}
    for i, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        starts, base = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        found = set()
        for label, group in TEMPLATES.items():
            for t in group:
                n, t = len(t.split()), set(t.split())
                for at in range(0, len(words), n):
                    if len(t & set(words[at : at + 2 * n])) >= 0.8 * len(t):
                        found.add(label)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | found))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(found)


def test_notices_broken_over_lines_are_found(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for label, group in TEMPLATES.items():
        for t in group:
            for width in (1, 4, 9):
                words = t.split()
                cut = ["\n# ".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))]
                before = " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(200)))
                want[len(rows)] = label
                rows.append((len(rows), "\n".join([before, *cut, before])))
    found = scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=("doc_id",))
    got = {r.doc_id: r for r in found.collect()}
    assert all(want[i] in got[i].labels.split(",") and got[i].score == 1.0 for i in want)
    clean = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(300))) for i in range(20)]
    none = scan_licenses(spark.createDataFrame(clean, "doc_id bigint, text string"))
    assert {(r.labels, r.score) for r in none.collect()} == {("", 0.0)}


def test_columns_with_names_of_the_result_are_ignored(spark):
    rows = [(1, "mit license", "x", "y", 2.0), (None, None, None, None, None), (1, "mit license", "x", "y", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, labels string, n_words string, score double")
    got = sorted((r.n_words, r.labels) for r in scan_licenses(docs, keep=("doc_id",)).collect())
    assert got == [(0, ""), (2, "mit"), (2, "mit")]


def test_empty_table_and_too_many_templates(docs, no_docs):
    assert scan_licenses(no_docs).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(docs, {"big": ("w " * 100_001,)})
