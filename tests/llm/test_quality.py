"""The ledger against a plain count of every measurement; policies and ablations from the bits."""

import re

import pytest

from meshloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n ", "one two", "a b c d e f g h " * 6, "word " * 100, "same line\nsame line\n\n \nother\nsame line", "x\r\ny\r\nx\r\n", "#*$ %& |<> ok " * 10,
    " ".join(f"w{i}" for i in range(60)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9", "ÉÀ é ünï " * 9, "UPPER CASE TEXT ONLY " * 10, "\x0bv\x0ct\x1c not\x85white\xa0space " * 5, "averyveryverylongwordindeed " * 25,
    " ".join(str(i % 11) for i in range(300)), "plain and simple words of usual length that make no trouble at all for any of the rules we have here now",
]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {k for i, w in enumerate(windows) if w in twice for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    bits = [n < 20, 100 * len(covered) > 30 * n, 10 * symbols > 3 * n, 2 * dup > len(lines), chars < 2 * n or chars > 15 * n, 10 * upper > 6 * letters]
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_lines": len(lines), "n_dup_lines": dup, "n_upper": upper, "n_letters": letters, "n_repeat_words": len(covered),
        "base_failed": bits[0] or bits[1], "kept": not any(bits), "failed_bits": sum(1 << k for k, b in enumerate(bits) if b),
    }


def test_measurements_and_verdicts(make):
    got = {r["doc_id"]: r.asDict() for r in quality.quality_verdicts(make(list(enumerate(TEXTS)))).collect()}
    names = [r.name for r in quality.RULES]
    every = [plain(text)["failed_bits"] for text in TEXTS]
    for i, text in enumerate(TEXTS):
        want = plain(text)
        assert {k: got[i][k] for k in want} == want, text
        bits = want["failed_bits"]
        assert got[i]["alone"] == (names[bits.bit_length() - 1] if bits.bit_count() == 1 else None) and got[i]["alike"] == every.count(bits) and got[i]["policy"] == "default-1"


def test_policies_and_ablations(make):
    docs = make([*enumerate(TEXTS), (None, TEXTS[-1]), (15, TEXTS[-1])])
    rows = quality.ledger(docs)
    bits = [r["failed_bits"] for r in rows.collect()]
    found = {r["rule"]: r for r in quality.ablations(rows, quality.DEFAULT).collect()}
    for k, rule in enumerate(quality.RULES):
        r = found[rule.name]
        assert (r["failed"], r["failed_alone"], r["kept_without"]) == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits), sum(b & ~(1 << k) == 0 for b in bits))
    kept = quality.apply_policy(docs)
    assert kept.columns == docs.columns and kept.count() == sum(b == 0 for b in bits) > 0
    assert quality.ledger(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["few_words", "upper_case"])
def test_masks(name):
    assert quality.Policy("p", 2, (name,)).mask == 1 << [r.name for r in quality.RULES].index(name)


def test_long_text(make):
    text = " ".join(f"w{i % 5000}" for i in range(40_000))
    r = quality.quality_verdicts(make([(1, text)])).first()
    assert r["n_words"] == r["n_repeat_words"] == 40_000 and not r["kept"]


def test_columns_of_any_name(spark):
    """Columns that clash with the ledger's own, nulls in all of them, rows that repeat, and a policy of one rule."""
    rows = [(None, t, None, 5, "x", None) for t in TEXTS] + [(1, TEXTS[-1], "w", None, None, 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, failed_bits string, n_words int, t string, __text int")
    kept = quality.apply_policy(docs)
    assert kept.schema == docs.schema and kept.count() == sum(plain(r[1])["kept"] for r in rows)
    own = quality.Policy("few", 1, ("few_words",))
    assert quality.apply_policy(docs, own).count() == sum(not plain(r[1])["base_failed"] for r in rows)
    assert quality.quality_verdicts(docs.where("false")).count() == 0 and quality.apply_policy(docs.where("false")).count() == 0
