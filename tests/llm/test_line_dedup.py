"""Perfect hashes, and line dedup against a plain version."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import LOWER

from cloudmill.llm.line_dedup import dedup_lines, index_lines
from cloudmill.llm.perfect_hash import PerfectHash

LAST = (1 << 63) - 1


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_every_key_has_a_slot_of_its_own(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    perfect = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert len(perfect) == len(keys)
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
    assert (perfect.slots(keys + np.uint64(1)) < len(keys)).all()
    assert len(perfect.words) * 64 <= 4 * len(keys) + 1000


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="not distinct"):
        PerfectHash.build(np.array([5, 5, 7], dtype=np.uint64))


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plain(rows):
    """(doc_id, text, n_lines, n_dropped) of (doc_id, text) rows."""
    holders = {}
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    for i, ls in lines:
        for line in ls:
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(LAST if i is None else i)
    out = []
    for i, ls in lines:
        own = LAST if i is None else i
        kept = [x for x in ls if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == own]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (0, v) for v in r))


def odd_rows(rows):
    common = "  A line that Many documents hold\t"
    texts = [(i, f"{t}\n{common}\nown line {i} of this one\n{common.strip().upper()}") for i, t, *_ in rows if t]
    texts += [(i + 500, None) for i in range(3)] + [(600, ""), (601, "\n\n\n"), (602, "short\nshort"), (603, "short")]
    texts += [(None, common), (None, common + "\nonly there, twice"), (700, "only there, twice"), (701, "x" * 300_000)]
    texts += [(702, "x" * 300_000), (703, "ten chars!"), (704, " TEN CHARS!  "), (705, " ten chars!")]
    texts += [(710, "nine char\n日本語日本語日本語日"), (711, "nine char\n日本語日本語日本語日\r"), (3, "the same id again\n" + common)]
    texts += [(720, "the same row\nthe same row, again")] * 300 + [((1 << 53) + 1, "the same row\nb"), (1 << 53, "the same row\na")]
    texts += [(-5, "before zero, a line"), (800, "before zero, a line\n")]
    return texts


def test_odd_rows_equal_a_plain_version(spark, rows, no_docs):
    texts = odd_rows(rows)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    docs = docs.withColumns({c: F.lit("x") for c in ("doc", "body", "salt", "gone", "shard", "h", "n_lines")})
    want = in_order(plain(texts))
    assert sum(r[3] for r in want) > 100
    for shard_keys in (4_000_000, 3):
        got = in_order(tuple(r) for r in dedup_lines(docs, shard_keys=shard_keys).collect())
        assert got == want
    assert dedup_lines(no_docs).count() == 0


def test_nothing_repeats(spark):
    docs = spark.createDataFrame([(1, "a line of its own"), (2, None)], "doc_id bigint, text string")
    assert in_order(tuple(r) for r in dedup_lines(docs).collect()) == [(1, "a line of its own", 1, 0), (2, "", 1, 0)]


def test_index_counts_rows_and_keeps_the_least_id(spark):
    docs = spark.createDataFrame(
        [(5, "a line in three"), (9, "a line in three\nelse"), (2, "A LINE IN THREE "), (4, "a line in one")],
        "doc_id bigint, text string",
    )
    shards = index_lines(docs).collect()
    assert len(shards) == 1
    h, mark = np.frombuffer(hashlib.blake2b(b"a line in three", digest_size=16).digest(), "<u8")
    assert PerfectHash.from_bytes(shards[0].hash[8:]).slots(np.array([h])).tolist() == [0]
    assert np.frombuffer(shards[0].prints, "<u8").tolist() == [mark]
    assert np.frombuffer(shards[0].counts, "<u4").tolist() == [3]
    assert np.frombuffer(shards[0].first, "<i8").tolist() == [2]
