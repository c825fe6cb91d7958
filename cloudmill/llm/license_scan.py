"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import table

# Phrases whose words, one behind the other, mark a license.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Notices, grants and disclaimers of widely used licenses, as published, as words.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy"
        " of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the"
        " license is distributed on an as is basis without warranties or conditions of any kind"
        " either express or implied",
    ),
    "boost": (
        "distributed under the boost software license version 1 0",
        "permission is hereby granted free of charge to any person or organization obtaining a"
        " copy of the software and accompanying documentation covered by this license",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are"
        " permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of"
        " conditions and the following disclaimer in the documentation and or other materials"
        " provided with the distribution",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0"
        " international license",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms"
        " of the gnu general public license as published by the free software foundation",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or"
        " without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this"
        " software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the software",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either"
        " in source code form or as a compiled binary for any purpose commercial or non commercial"
        " and by any means",
    ),
    "zlib": (
        "permission is granted to anyone to use this software for any purpose including commercial"
        " applications and to alter it and redistribute it freely subject to the following"
        " restrictions",
    ),
}
MAX_TEMPLATE_WORDS = 100_000  # templates go to every task: refused beyond this size

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def _words(text: str | None) -> list[bytes]:
    """A text's words: runs of a-z, 0-9 and bytes from 0x80, after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


@dataclass
class _Index:
    """Word sets of the templates of one length by the words of their prefixes."""

    size: int  # words of a template; blocks have twice as many, one starts at every size-th word
    labels: list[str]
    sizes: list[int]
    needs: list[int]  # least overlap that meets the containment threshold
    words: list[frozenset[int]]
    lists: dict[int, list[tuple[int, int]]]  # prefix word -> templates and its position there

    @classmethod
    def build(
        cls, templates: dict[str, tuple[str, ...]], rank: dict[bytes, int], threshold: float
    ) -> list[_Index]:
        """One index for each length; ``rank`` is the words' global order, rarest first."""
        by_size: dict[int, _Index] = {}
        for label in sorted(templates):
            for template in templates[label]:
                text = template.encode().split()
                if not text:
                    continue
                out = by_size.setdefault(len(text), cls(len(text), [], [], [], [], {}))
                ids = sorted({rank[w] for w in text})
                need = max(1, int(np.ceil(threshold * len(ids) - 1e-9)))
                k = len(out.labels)
                out.labels.append(label)
                out.sizes.append(len(ids))
                out.needs.append(need)
                out.words.append(frozenset(ids))
                for position, w in enumerate(ids[: len(ids) - need + 1]):
                    out.lists.setdefault(w, []).append((k, position))
        return [by_size[n] for n in sorted(by_size)]

    def blocks(self, known: dict[int, list[int]]) -> Iterator[tuple[int, list[int]]]:
        """Blocks with a prefix word: their first word, and their known words in global order.

        ``known`` has the places of each template word of the text. Blocks run over line breaks
        and overlap by half, so any run of ``size`` words lies in one.
        """
        parts = {at // self.size for w in self.lists.keys() & known.keys() for at in known[w]}
        if not parts:
            return
        firsts = parts | {part - 1 for part in parts if part}
        around = parts | firsts | {first + 1 for first in firsts}
        held: dict[int, set[int]] = {}
        for w in frozenset().union(*self.words) & known.keys():
            for at in known[w]:
                if (part := at // self.size) in around:
                    held.setdefault(part, set()).add(w)
        none: set[int] = set()
        for first in sorted(firsts):
            yield first * self.size, sorted(held.get(first, none) | held.get(first + 1, none))

    def matches(self, own: list[int]) -> Iterator[tuple[int, float]]:
        """Templates contained in a block of known words, with the share of words that it has.

        Words that no template has are the rarest of all and count for nothing here, so the
        block's known words in global order are all of its set that can overlap. A template
        needs one of its prefix words in the block (prefix filter), a block of enough words
        (length filter), and enough words left behind the first common one in both orders
        (positional filter). What is left is verified exactly.
        """
        seen: set[int] = set()
        for i, w in enumerate(own):
            for k, position in self.lists.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)
                need = self.needs[k]
                if len(own) < need or min(len(own) - i, self.sizes[k] - position) < need:
                    continue
                common = len(self.words[k].intersection(own))
                if common >= need:
                    yield k, common / self.sizes[k]


def template_counts(docs: DataFrame, templates: dict[str, tuple[str, ...]], text: str) -> dict:
    """How many texts of the whole corpus hold each template word, 0 included."""
    vocabulary = sorted({w for group in templates.values() for t in group for w in t.encode().split()})
    known = frozenset(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bytes, int] = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for body in batch["text"]:
                for w in known.intersection(_words(body)):
                    total[w] += 1
        yield pd.DataFrame({"word": [w.decode() for w in total], "n": list(total.values())})

    rows = (
        docs.select(F.col(text).cast("string").alias("text"))
        .mapInPandas(count, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()  # a row for each template word
    )
    return dict.fromkeys(vocabulary, 0) | {r["word"].encode(): r["n"] for r in rows}


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = 0.8,
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Licenses of every text: phrases, and templates contained in its text blocks.

    A template of n words is looked for in blocks of 2n words, one at every n-th word of the
    text whatever its line breaks, so that any run of n words lies in one. It is found in every
    block that has at least ``threshold`` of its distinct words. Words are ordered by how many
    texts of the whole corpus hold them, rarest first; prefix, length and positional filters
    leave few pairs to verify exactly. The corpus side is streamed and needs no shuffle; the
    templates are the small side, refused beyond MAX_TEMPLATE_WORDS.

    Returns ``keep`` columns, n_words, n_base (places of phrases), first_word and last_word
    (their least and greatest start, null without any), base_labels and labels (distinct,
    sorted, comma-joined; labels adds the templates'), score (greatest containment found, 0
    without any), spans (template places: first word of the block, label, containment).

    Defined results: a null text is empty and has no words; repeated rows alike; an empty table
    gives an empty one; columns of ``docs`` outside ``keep`` are ignored.
    """
    if sum(len(t.split()) for group in templates.values() for t in group) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words for a scan that sends them to every task")
    counts = template_counts(docs, templates, text)
    rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    indexes = _Index.build(templates, rank, threshold)
    patterns = [(p.encode().split(), label) for p, label in phrases.items()]
    firsts: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for words, label in patterns:
        firsts.setdefault(words[0], []).append((words, label))

    def scan(texts: pd.Series) -> pd.DataFrame:  # noqa: C901
        rows = []
        for body in texts:
            words = _words(body)
            starts, base, more, spans = [], set(), set(), []
            places: dict[int, list[int]] = {}  # of template words
            for at, w in enumerate(words):
                if w in rank:
                    places.setdefault(rank[w], []).append(at)
                if w in firsts:
                    for phrase, label in firsts[w]:
                        if words[at : at + len(phrase)] == phrase:
                            starts.append(at)
                            base.add(label)
            for index in indexes:
                for at, block in index.blocks(places):
                    for k, share in index.matches(block):
                        more.add(index.labels[k])
                        spans.append((at, index.labels[k], share))
            rows.append(
                (
                    len(words),
                    len(starts),
                    min(starts, default=None),
                    max(starts, default=None),
                    ",".join(sorted(base)),
                    ",".join(sorted(base | more)),
                    max((s for _, _, s in spans), default=0.0),
                    spans,
                )
            )
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in _FOUND.split(", ")])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    found = F.pandas_udf(scan, f"{_FOUND}")
    result = docs.select(*keep, found(F.col(text).cast("string")).alias("_found"))
    return result.select(*keep, "_found.*")


_FOUND = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans array<struct<word:bigint,label:string,share:double>>"
)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), keep=("doc_id",)).drop("spans")
