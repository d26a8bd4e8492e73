"""Fingerprints: equal texts, estimates against exact similarity, the edited texts, odd inputs."""

import hashlib
import json
import random
import struct

import pytest
import xxhash

from meshloom.llm import minhash


def shingles(text):
    words = (text or "").lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(3)
    out = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 20, 100, 400]))) for _ in range(60)]
    return [*out, "", None, "one", "one two three four", "Five Words Are just one", "x " * 50, "é\tü\nñ " * 9]


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_edited(make, parts):
    rows = list(enumerate(texts()))
    rows += [(1000 + i, t) for i, t in enumerate([rows[3][1], rows[3][1]])]
    got = {r["doc_id"]: r for r in minhash.edited_fingerprints(make(rows), parts=parts).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    errors = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, after)]
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.02
    assert got[1000]["fingerprint"] == got[1001]["fingerprint"] == got[3]["fingerprint"]
    assert len(got[0]["fingerprint"]) == minhash.BINS * minhash.BITS // 4 and got[60]["fingerprint"] == ""


def test_odd_tables(make):
    assert minhash.edited_fingerprints(make([(1, "a")]).where("false")).count() == 0
    (r,) = minhash.edited_fingerprints(make([(4, "a b c d e f")])).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c a b c"[:6] + b"a b c"[:5]).hexdigest()
    rows = minhash.edited_fingerprints(make([(None, "x y"), (None, None), (2, "p q"), (2, "p q"), (2, "r s")])).collect()
    assert len(rows) == 5 and sorted(r["n_chars"] for r in rows) == [0, 3, 3, 3, 3]


def plain_fingerprint(text):
    """The fingerprint by a loop over shingles and bins."""
    words = (text or "").lower().split()
    if not words:
        return ""

    def chained(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed

    grams = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words]
    lowest = {}
    for gram in grams:
        x = chained(w.encode() for w in gram) >> 1
        b = x >> 63 - minhash.LOG_BINS
        lowest[b] = min(x, lowest.get(b, x))
    orders = json.loads(minhash.probe_orders())
    out = ""
    for b in range(minhash.BINS):
        donor = b if b in lowest else next(o for o in orders[b] if o in lowest)
        out += f"{chained([struct.pack('<q', lowest[donor]), struct.pack('<i', b)]) & 255:02x}"
    return out


def test_against_a_plain_fingerprint(make):
    rows = [*enumerate(texts()), (500, " ".join(f"v{i % 40_000}" for i in range(60_000)))]
    got = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(make(rows)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in rows}


def test_a_text_of_two_shingles_is_like_no_other(make):
    """Copied bins agree by chance one by one: disjoint texts stay near 0."""
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(6))) for i in range(300)]
    near = [r["near_next"] for r in minhash.edited_fingerprints(make(rows)).collect()]
    assert max(near) < 0.05


def test_probe_orders_are_permutations():
    orders = json.loads(minhash.probe_orders())
    assert all(sorted(o) == list(range(minhash.BINS)) for o in orders) and len({o[0] for o in orders}) > minhash.BINS // 3
