"""Components of the exact join against all pairs, with hot tokens, groups of copies and odd rows."""

import random

import pytest

from meshloom.llm import jaccard


def shingles(text):
    words = bytes(text or "", "utf8").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets if i is not None)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, line = [word() for _ in range(40)], "the same line in many texts here".split()
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([7, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.4:
                copy[5:5] = line
            if rng.random() < 0.3:
                copy[3:3] = passage
            rows.append(" ".join(copy))
    # a chain: each text links with the next, the ends don't
    chain = [word() for _ in range(100)]
    for k in range(6):
        rows.append(" ".join(chain[k * 8 : k * 8 + 80]))
    rows += [" ".join([*passage, word(), word()]) for _ in range(5)]
    rows += ["", None, " ", "one", "One", "one two three", "one two  three\n", "one two three four", "a b c d e", "A B C D E"]
    rng.shuffle(rows)
    return [(7 * i % 997, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "hot", "group", "block"), [(1, 24, 64, 256), (2, 1, 1, 2), (3, 1, 3, 1)])
def test_components(make, monkeypatch, seed, hot, group, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed)
    assert sorted(map(tuple, jaccard.jaccard_components(make(rows)).collect())) == brute(rows)


def test_copies_and_odd_rows(make):
    text = " ".join(f"x{i}" for i in range(50))
    rows = [(i, text) for i in range(5, 60)] + [(3, text + " end"), (None, text), (None, "alone in the world without a key"), (70, ""), (71, ""), (80, "repeated id first text of it"), (80, "repeated id second text of it here")]
    got = jaccard.jaccard_components(make(rows)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60} == {3}
    assert sorted(((r["component_id"] is None, r["component_id"] or 0) for r in got if r["doc_id"] is None)) == [(False, 3), (True, 0)]
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (70, 71)} == {70: 70, 71: 71}
    assert len(got) == len(rows)
    kept = jaccard.one_of_each(make(rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 70, 71, 80, 80] and len(kept.columns) == 7


def test_rows_without_a_key_stay_unless_copied(make):
    copy = " ".join(f"x{i}" for i in range(50))
    rows = [(5, copy), (None, copy), (None, copy.upper()), (None, "alone in the world without a key"), (None, copy + " end"), (None, ""), (None, None), (6, copy)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(make(rows)).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], *rows[3:7]], key=str)


def test_repeated_keys_link_all_their_texts(make):
    s1, s2, s3 = (" ".join(f"{c}{i}" for i in range(20)) for c in "pqr")
    rows = [(3, s1), (5, s1), (5, s2), (9, s2), (4, s3), (5, s3), (10, "quite another text with other words"), (10, "")]
    got = jaccard.jaccard_components(make(rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(3, 3), (4, 3), (5, 3), (9, 3), (10, 10)}


def test_tables_without_links(make):
    assert jaccard.jaccard_components(make([(1, "a b c d e f")]).where("false")).count() == 0
    assert sorted(map(tuple, jaccard.jaccard_components(make([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)])).collect())) == [(1, 2, 1), (2, 2, 2), (3, 0, 3)]


def test_short_tokens_keep_their_order():
    import numpy as np

    tokens = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * 2)
    assert (jaccard.long(jaccard.short(tokens)) == (tokens >> np.uint64(16)).astype(np.int64)).all()
    assert jaccard.overlap(np.array([1, 3, 5]), np.array([3, 4, 5, 9])) == 2 and jaccard.overlap(np.array([], int), np.array([1])) == 0
