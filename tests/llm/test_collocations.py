"""Collocations against a plain count, with odd rows, ties and small stretches."""

import random
import re
from collections import Counter
from itertools import pairwise

import pytest

from meshloom.llm import collocations as c


def brute(rows, min_words=2, max_words=3, min_count=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    candidates = {p: a for p, a in f.items() if len(p) > min_words and a >= min_count}
    for (lang, *words), a in candidates.items():
        cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(
            p[0] == lang and len(p) > len(words) + 1 and any(list(p[i : i + len(words)]) == words for i in range(1, len(p) - len(words) + 1)) and 100 * m >= 50 * a for p, m in candidates.items()
        )
        if not inside:
            out.append((lang, " ".join(words), a, f[lang, *words[:k]], f[lang, *words[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [*(f"w{i}" for i in range(25)), "New", "YORK", "city", "été", "日本", "x" * 40]
    rows = []
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for at in range(0, len(words) - 3, 9):
            words[at : at + 3] = rng.choice([["New", "York", "City"], ["red", "sea", "w1"], ["w3", "w4"]])
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " - "]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), ("en", ""), (None, " .,; "), *[("fr", "same words here. same words here")] * 12]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n long, phrase string").repartition(parts)


@pytest.mark.parametrize("setting", [{}, {"max_words": 4, "min_count": 4, "top": 30}, {"filter_bits": 64}])
def test_against_plain_counts(spark, setting):
    rows = corpus(3)
    made = sorted(tuple(r) for r in c.collocations(frame(spark, rows), **setting).collect())
    want = brute(rows, **{k: v for k, v in setting.items() if k != "filter_bits"})
    assert made == want
    assert len(want) > 20


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(c, "STRETCH", 50)
    text = "one two, three four five. " * 40 + "a piece without any end " * 20
    parts = [bytes(t) for _, t in c.stretches("en", memoryview(text.encode()))]
    assert b"".join(parts) == text.encode()
    assert len(parts) > 10
    assert all(b[:1] in b".," for _, b in pairwise(parts) if b)


def test_empty_table(spark):
    assert c.collocations(frame(spark, [], 1)).count() == 0


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 1)], "lang string, phrase string, n long")
    (row,) = c.scored(counts, 2).collect()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))
