"""Joins, model and tokenizer against plain versions, on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from texts import LOWER
from pyspark.sql import functions as F

from cloudmill.llm.components import components
from cloudmill.llm.embedding_dedup import dedup_embeddings
from cloudmill.llm.jaccard_join import JaccardJoin, jaccard_groups, keep_one_of_each
from cloudmill.llm.language_model import fit_weights, score_texts
from cloudmill.llm.packing import pack_documents
from cloudmill.llm.pieces import decode_pieces, encode_pieces, load, piece_digests


def least_reachable(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = least_reachable({x for l in links for x in l}, links)
    del want[5000]  # in no link with another
    assert set(got) == set(want)
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(want[n])
    assert sorted(map(sorted, groups.values())) == [[0], [1000]]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_jaccard_groups_equal_all_pairs(docs, rows, no_docs):
    sets = {}
    for i, text, *_ in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = least_reachable(sets, links)
    got = {r.doc_id: r for r in jaccard_groups(docs, sketch_bits=10).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    kept = keep_one_of_each(docs, sketch_bits=10)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert jaccard_groups(no_docs, sketch_bits=10).count() == 0


def test_ids_are_exact_beside_a_null_id(spark):
    big = (1 << 53) + 1
    texts = [(None, "a text without an id"), (big, "a text with a very large id"), (-big, "a text of its own here")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    assert {r.doc_id for r in jaccard_groups(docs, sketch_bits=10).collect()} == {None, big, -big}
    assert {r.doc_id for r in score_texts(docs).collect()} == {None, big, -big}
    assert {r.doc_id for r in pack_documents(docs).collect()} == {None, big, -big}


def test_one_of_each_without_ids_and_with_clashing_names(spark):
    same, other = "one two three four five six", "seven eight nine ten eleven twelve"
    data = [(1, same), (None, same), (None, other), (None, other), (2, "x y"), (2, "x y"), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in data], "doc_id bigint, body string, id int, same int, row int")
    kept = keep_one_of_each(docs, text="body", sketch_bits=10)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.body, r.id) for r in kept.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert got == [(1, same, 7), (2, "x y", 7), (3, None, 7), (4, "", 7), (None, None, 7), (None, other, 7)]


def test_jaccard_links_of_a_given_table_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = words_of(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    assert len(links) > 5
    got = {r.doc_id: r.component_id for r in jaccard_groups(docs).collect()}
    assert got == least_reachable(sets, links)


def test_a_group_of_near_copies_of_which_few_link_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.integers(0, len(base), rng.integers(0, 7)):
            words[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(words))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(map(words_of, texts))}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert 100 < len(links) < len(sets) * (len(sets) - 1) / 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_groups(docs, sketch_bits=10).collect()}
    assert got == least_reachable(sets, links)


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 12))
    near = base[:20] + rng.normal(size=(20, 12)) * 0.12
    vectors = [v.tolist() for v in np.concatenate([base, near, near[:5] * 1e3, base[:3]])]
    labels = [i % 3 for i in range(40)] + [i % 3 for i in range(20)] + [i % 3 for i in range(5)] + [0, None, 2]
    vectors += [None, [], [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] * 12, [1.0, 2.0]]
    labels += [0] * 7
    rows = list(zip(range(len(vectors)), vectors, labels))
    links, count = [], Counter()
    ok = [i for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in ok}
    for a in ok:
        for b in ok:
            if a < b and labels[a] == labels[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links.append((a, b))
                count.update((a, b))
    want = least_reachable(range(len(rows)), links)
    schema = "vec_id bigint, embedding array<double>, label int"
    got = {r.vec_id: r for r in dedup_embeddings(spark.createDataFrame(rows, schema)).collect()}
    assert len(links) > 10 and len(got) == len(rows)
    for i in want:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], want[i], want[i] == i)
    assert dedup_embeddings(spark.createDataFrame([], schema)).count() == 0


def test_scores_equal_a_plain_model(docs, rows, no_docs):
    texts = {i: [*words_of(t), None] for i, t, *_ in rows}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    count = Counter(x for i, w in texts.items() if fold[i] != 1 for x in w)
    total, types = sum(count.values()), len(count)
    small = score_texts(docs, block_tokens=700, shard_entries=100)
    got = {r.doc_id: r for r in small.collect()}
    whole = {r.doc_id: r.score for r in score_texts(docs).collect()}
    for i, w in texts.items():
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (fold[i] == 1, len(w), total)
        assert r.n_known == sum(count[x] > 0 for x in w)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.score == pytest.approx(whole[i], rel=1e-9)  # blocks and shards do not matter
    assert score_texts(no_docs).count() == 0


def test_weights_prefer_what_predicts():
    cells = np.array([[3, 8, 40], [3, 16, 60], [5, 319, 16]])
    w = fit_weights(cells, np.array([50.0, 50.0, 100.0]), 1e-4)
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all()
    assert w[3, 0] > 0.9 and w[5, 1] > 0.9


def test_pieces_equal_the_library(docs, rows, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    both = docs.select("doc_id", encode_pieces(F.col("text")).alias("ids")).withColumn("back", decode_pieces(F.col("ids")))
    got = {r.doc_id: r for r in both.collect()}
    digests = {r.doc_id: r for r in piece_digests(docs).collect()}
    for i, text, *_ in rows:
        ids = sp.encode(text or "")
        assert list(got[i].ids) == ids and got[i].back == sp.decode(ids)
        d = digests[i]
        assert d.n_pieces == len(ids) and d.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert d.decoded_sha256 == hashlib.sha256(got[i].back.encode()).hexdigest()
    assert piece_digests(no_docs).count() == 0


def test_pair_memory_does_not_change_pieces():
    model = load("piece_bpe_32k.model")
    text = "the theater thinks\nof 12345 things, aaaa  aaa"
    first = model.encode([text])
    model.known.clear()
    model.pair_keys, model.pair_holds = model.pair_keys[:0], model.pair_holds[:0]
    assert model.encode([text]) == first


def test_lists_of_several_sets_take_one_shuffle_at_any_size(spark):
    """A join with the tokens of several sets would shuffle all postings twice once it is not broadcast."""
    from cloudmill.llm.jaccard_join import _several

    rows = [(1, 10), (1, 11), (1, 11), (2, 12), (3, 13), (3, 13), (4, 14), (4, 15), (4, 16)]
    lists = _several(spark.createDataFrame(rows, "token bigint, node bigint"), "node")
    assert lists.columns == ["token", "node"]
    assert sorted(map(tuple, lists.collect())) == [r for r in rows if r[0] in (1, 4)]
    plan = lists._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1


def test_lists_keep_only_sets_with_one_of_like_size(spark):
    """Sets whose sizes rule the similarity out are not paired, and leave no rows behind."""
    join = JaccardJoin(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 5, 80, 2, 8, "text")
    sizes = {1: 10, 2: 100, 3: 79, 4: 80, 5: 64, 6: 63}
    lists = {7: [1, 2], 8: [2, 3], 9: [2, 4], 10: [1, 1], 11: [4, 5, 5, 6, 1], 12: [6, 3, 2, 4]}
    rows = [(t, k, sizes[k], 0) for t, nodes in lists.items() for k in nodes]
    shared, pairs = join.pivots(spark.createDataFrame(rows, "token long, node long, n int, place int"))
    want = {(9, 2), (9, 4), (11, 4), (11, 5), (11, 6), (12, 2), (12, 3), (12, 4)}  # 63 is too few for 79
    assert {(r.token, r.node) for r in shared.collect()} == want
    assert {(r.a, r.b) for r in pairs.collect()} <= {(a, b) for t, a in want for u, b in want if t == u and a != b}
    # Sets 4 and 5 are joined, the set 6 can still meet them.
    roots = spark.createDataFrame([(4, 4), (5, 4)], "node long, root long")
    apart = join.unjoined(shared, roots)
    assert {(r.token, r.node) for r in apart.collect() if r.token == 11} == {(11, 4), (11, 5), (11, 6)}
    roots = spark.createDataFrame([(4, 4), (5, 4), (6, 4)], "node long, root long")
    assert join.unjoined(shared, roots).filter("token = 11").count() == 0


def test_components_of_links_added_to_known_groups(spark):
    def of(links):
        return spark.createDataFrame(links, "a bigint, b bigint")

    first = [(1, 2), (2, 3), (10, 11), (20, 21)]
    added = [(3, 1), (11, 3), (30, 31), (31, 21), (40, 41), (50, 50)]
    known = components(of(first))
    got = {r.node: r.root for r in components(of(added), known=known).collect()}
    want = least_reachable({x for l in first + added for x in l}, first + added)
    del want[50]
    assert set(got) == set(want)
    assert len({(want[n], r) for n, r in got.items()}) == len(set(want.values())) == len(set(got.values()))
    same = {r.node: r.root for r in components(of([(1, 3), (11, 10)]), known=known).collect()}
    assert same == {r.node: r.root for r in known.collect()}


def test_joined_sets_are_not_grouped_again(spark, monkeypatch):
    from cloudmill.llm import components as steps
    from cloudmill.llm import jaccard_join

    written = []

    def saved(df, label, save=steps.saved):
        written[-1] += 1
        return save(df, label)

    def grouped(*links, **more):
        written.append(0)
        return components(*links, **more)

    monkeypatch.setattr(steps, "saved", saved)
    monkeypatch.setattr(jaccard_join, "components", grouped)
    body = " ".join(f"word{k}" for k in range(60))
    texts = [(i, f"{body} end{i}") for i in range(4)]
    groups = jaccard_groups(spark.createDataFrame(texts, "doc_id bigint, text string"), sketch_bits=10)
    assert {r.component_id for r in groups.collect()} == {0}
    first, *later = written
    assert first > 1 and later == [1, 1]  # one look at each, no round


def test_a_star_takes_few_rounds_and_writes(spark, monkeypatch):
    """What a search plans and runs stays in the driver's memory, whatever the links are."""
    from cloudmill.llm import components as steps

    written = []
    monkeypatch.setattr(steps, "saved", lambda df, label, save=steps.saved: written.append(label) or save(df, label))
    links = [(0, 1 + i) for i in range(500)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = least_reachable({x for l in links for x in l}, links)
    assert set(got) == set(want)
    assert len({(want[n], r) for n, r in got.items()}) == len(set(want.values())) == len(set(got.values()))
    assert len(written) <= 6  # the links, two rounds of two, and the result


def test_passes_over_texts_end_with_the_pairs(spark, monkeypatch):
    """Without candidates nothing is verified, so no text is read for it."""
    from cloudmill.llm import jaccard_join

    written = []
    monkeypatch.setattr(
        jaccard_join, "saved", lambda df, label, save=jaccard_join.saved: written.append(label) or save(df, label)
    )
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(5)] + [(9, "w0x0 w0x1")]
    groups = jaccard_groups(spark.createDataFrame(texts, "doc_id bigint, text string"), sketch_bits=10)
    assert {(r.doc_id, r.component_id) for r in groups.collect()} == {(i, i) for i, _ in texts}
    assert written.count("candidates") == 3 and not {"sets", "links"} & set(written)
