"""Restored words, learning, held-out accuracy, odd tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def restorer(docs):
    return toxicity.Restorer(toxicity.trigram_counts(docs))


@pytest.mark.parametrize(("written", "read"), [("1d10t", "idiot"), ("m0r0n,", "moron"), ("s.c.u.m", "scum"), ("$tupid", "stupid"), ("tr@sh!", "trash"), ("idioooot", "idiot"), ("c-l-o-w-n", "clown")])
def test_disguised_words(restorer, written, read):
    assert restorer.words(written) == (read,)


@pytest.mark.parametrize(("written", "read"), [("idio7", "idiot"), ("idi07", "idiot"), ("worthle55", "worthless"), ("hat3", "hate"), ("!diot", "idiot"), ("stup1d!", "stupid"), ("stupid$$$", "stupid"), ("pathetic!!", "pathetic")])
def test_signs_at_the_ends_of_words(restorer, written, read):
    assert restorer.words(written) == (read,)


@pytest.mark.parametrize("word", ["a$$", "dumba$$", "scu3", "+rash", "b!"])
def test_words_with_signs_at_the_ends_are_decoded(restorer, monkeypatch, word):
    monkeypatch.setattr(toxicity.Restorer, "decode", lambda self, raw: "seen" + raw)
    assert restorer.words(word)[0].startswith("seen")


@pytest.mark.parametrize("word", ["2024", "plain", "don", "été", "1,000", "%%%"])
def test_other_words_stay(restorer, word):
    assert "".join(restorer.words(word)) == "".join(c for c in word if c.isalnum())


def test_spelled_words(restorer):
    reader = toxicity.Reader(restorer)
    assert reader.read(b"you s t u p i d thing a b")[1] == [("stupid",)]


def test_long_runs_are_read_as_a_whole(restorer, monkeypatch):
    run = list("yourcommentsareabsolutelypatheticandnobodywantsstupidwordshere")
    want = restorer.spelled(run)
    assert "".join(want) == "".join(run) and {"com", "ments", "and", "body"} <= set(want)
    assert {restorer.spelled(list("yo" * n) + run)[-8:] for n in range(40)} == {want[-8:]}  # wherever the run begins
    assert restorer.words("-".join(run)) == want
    monkeypatch.setattr(toxicity, "SETTLE_CHARS", 3)
    assert restorer.spelled(run) == want and restorer.words("1d10t" * 20) == ("idiot" * 20,)
    monkeypatch.setattr("meshloom.llm.units.SEGMENT", 20)
    assert toxicity.Reader(restorer).read((" ".join(run) + " end a b").encode())[1] == [want]


def test_trigram_counts_are_those_of_all_texts(docs):
    want = np.zeros(toxicity.CLASSES**3, np.int64)
    for r in docs.collect():
        c = [0, 0, *toxicity.classes_of(r["text"]), 0]
        np.add.at(want, [(a * toxicity.CLASSES + b) * toxicity.CLASSES + d for a, b, d in zip(c, c[1:], c[2:], strict=False)], 1)
    assert (toxicity.trigram_counts(docs) == want).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = rows[rows["held_out"]]
    rank = held["score"].rank()
    n1, n0 = held["toxic"].sum(), (1 - held["toxic"]).sum()
    assert (rank[held["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.93
    hit = held[held["predicted"] == 1]["toxic"]
    assert hit.mean() > 0.9 and hit.sum() / n1 > 0.8
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()


def test_only_texts_count(make, spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(d, labels).collect()} for d in (docs, moved))
    assert a == b


def test_odd_tables(make, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, None), (2, ""), (None, "x"), (3, "a b c"), (3, "a b c")]
    got = toxicity.toxicity_scores(make(rows), none).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1 and not any(r["predicted"] for r in got)
    assert toxicity.toxicity_scores(make(rows).where("false"), none).count() == 0
    some = spark.createDataFrame([(i, int(i < 40)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = make([(i, "good words here" + (" vile thing" if i < 40 else "")) for i in range(200)] + [(None, "vile"), (900, None)])
    kept = toxicity.drop_toxic(docs, some)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(40, 200)) | {900} and not {r["doc_id"] for r in kept.collect()} & set(range(40))


def readings(arcs, costs, at=0, state=(0, 0)):
    """(cost, text) of every reading of a lattice, by trying all."""
    if at == len(arcs):
        yield costs[state[0], state[1], 0], ""
        return
    for to, read, extra in arcs[at]:
        a, b = state
        cost = extra
        for ch in read:
            c = int(toxicity.CLASS[min(ord(ch), 0x250)])
            cost += costs[a, b, c]
            a, b = b, c
        for more, rest in readings(arcs, costs, to, (a, b)):
            yield cost + more, read + rest


@pytest.mark.parametrize("raw", ["1d10t", "a$$", "s.c.u.m", "idiooot", "h4t3!!", "0|<3", "b a d", "no-one", "1001", "xx11..--", "é1é", "$$$", "w.o.r.d-5"])
def test_decoding_finds_the_cheapest_of_all_readings(restorer, monkeypatch, raw):
    every = list(readings(list(restorer.arcs(raw)), restorer.costs))
    cheapest = min(cost for cost, _ in every)
    for settle in (toxicity.SETTLE_CHARS, 2):
        monkeypatch.setattr(toxicity, "SETTLE_CHARS", settle)
        assert min(cost for cost, text in every if text == restorer.decode(raw)) == pytest.approx(cheapest)


def test_scores_are_those_of_a_plain_loop(spark, docs, restorer):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels, restorer)
    assert model.units
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    for r in docs.collect():
        words, run = [], []
        for w in [*(r["text"] or "").lower().split(), ".."]:
            if len(w) == 1 and (w.isalpha() or w in toxicity.LOOKS_LIKE):
                run.append(w)
            else:
                words += restorer.spelled(run) if len(run) >= 3 else ()
                run = []
            words += restorer.words(w) if w != ".." else ()
        units = [u for w in words for u in toxicity.units_of(w)]
        counts = np.array([[units.count(u) for u in model.units]], float)
        assert got[r["doc_id"]] == pytest.approx(float(model.score(counts, np.array([len(words)], float))[0])), r["doc_id"]


def test_clashing_columns_and_long_texts(spark):
    """Columns with the names that the operator uses inside, words of any length, texts longer than the sample takes."""
    rows = [(i, "good words here" + (" vile thing" if i < 40 else ""), 1, "a", 2.0, 3, 4, 5) for i in range(200)]
    rows += [(300, "vile thing " * 3_000, 1, "a", 2.0, 3, 4, 5), (301, "1d10t" * 30, 1, "a", 2.0, 3, 4, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, y string, t double, part int, __row int, __gone int")
    labels = spark.createDataFrame([(i, int(i < 40), 9, 9) for i in range(200)] + [(300, 1, 9, 9)], "doc_id long, toxic int, k int, y int")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(scores) == 202 and all(scores[i] == (i < 40) for i in range(200)) and scores[300] == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(40, 200))
