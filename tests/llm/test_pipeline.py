"""The corpus pipeline, and its stages beside columns called like their own."""

import pytest
import tokenizers
from pyspark.sql import functions as F
from test_joins import least_reachable, words_of

import corpus_pipeline

OWN = ("quality_score", "quality_kept", "toxic_score", "Toxic", "_places", "_redact_row", "id", "same", "row", "first")


def folder(path, docs):
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    empty = docs.sparkSession.createDataFrame([], "doc_id bigint, quality int, toxic int")
    empty.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_equals_a_plain_version(spark, tmp_path, rows):
    secret = "a b c password = abcdefgh12345678 d e f"
    texts = [(i, t, source) for i, t, _, source, *_ in rows] + [(900, secret, "one")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    got = corpus_pipeline.run(spark, folder(tmp_path, docs)).collect()
    sets = {}
    for i, text, _ in texts:  # without labels, both classifiers keep everything
        w = words_of(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    kept = set(least_reachable(sets, links).values())
    assert {r.doc_id for r in got} == kept and len(kept) < len(texts)
    import public_tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts_of = {i: t or "" for i, t, _ in texts}
    lengths = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    plain = {i: len(tokenizer.encode(texts_of[i], add_special_tokens=False).ids) + 1 for i in kept}
    assert {i for i in kept if lengths[i] != plain[i]} <= {900}
    loads = {}
    for r in got:
        loads.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in loads.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_called_like_their_own(spark, tmp_path, stage):
    data = [(1, "one two three four five six"), (2, None), (None, "x"), (3, ""), (4, "token = abcdefgh12345678 and more")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("source", F.lit("s"))
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(OWN)})
    path = folder(tmp_path, docs)
    _, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, path)
    assert out.columns == docs.columns
    found = out.collect()
    assert len(found) == len(data)
    assert {tuple(r[c] for c in OWN) for r in found} == {tuple(range(len(OWN)))}
    assert {r.text for r in found if r.doc_id != 4} == {t for i, t in data if i != 4}
    if stage == 3:
        assert "abcdefgh12345678" not in next(r.text for r in found if r.doc_id == 4)
    assert function(spark, docs.limit(0), path).count() == 0


def test_run_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert corpus_pipeline.run(spark, folder(tmp_path, docs)).count() == 0
