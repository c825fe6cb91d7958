"""A small corpus of odd rows that the text tests share."""

import random

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, base string, node string"


def prose(rng, words):
    syllables = ["ta", "ron", "mi", "Lé", "su", "kor", "e", "Van", "ol", "di", "ß", "日"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


def corpus():
    """Texts with nulls, an empty one, long ones, copies, ties, odd spaces; clashing columns."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 400)) for _ in range(40)]
    texts = [None, "", " \t\n ", "one", "one two three four", prose(rng, 6000), "x" * 5000]
    texts += base + base[:6] + ["  a  b\n\n c<|endoftext|>  d", "A\r\nB\x1cC\x85D ", "\0\0 nul ▁ mark"]
    for t in base[:12]:  # near copies on both sides of the threshold
        w = t.split(" ")
        for k in (1, 3, 9):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = prose(rng, 1)
            texts.append(" ".join(v))
    passage = prose(rng, 80)
    texts += [passage + " " + prose(rng, n) for n in (5, 15, 18, 20, 22, 40, 90, 200)]
    lang = ["en", None, "fr"]
    return [
        (i, t, lang[i % 3], f"s{i % 5}" if i % 7 else None, None, "b", "n") for i, t in enumerate(texts)
    ]
