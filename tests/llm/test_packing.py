import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloudmill.llm.packing import best_fit, pack_documents


def test_pieces_ids_and_places(docs, rows):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack_documents(docs, capacity=64, block=50).collect()
    parts = {}
    bins = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(parts[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and (r.length == 64 or k == 0)
            raw = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.02 * -(-total // 64) + 1


def test_no_rows_null_ids_and_repeated_rows(spark, no_docs):
    assert pack_documents(no_docs).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c")], "doc_id bigint, text string")
    got = pack_documents(twice).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"]
    assert len({r.sequence_id for r in got}) == 1


@pytest.mark.parametrize("loads", [[], [5], [10, 10], [6, 5, 4, 3, 2], [7, 1, 1, 1, 3, 7]])
def test_best_fit_fills_bins(loads):
    bins, totals = best_fit(np.array(loads, dtype=np.int64), 10)
    assert len(bins) == len(loads)
    for b, total in enumerate(totals):
        assert sum(x for x, k in zip(loads, bins) if k == b) == total <= 10
