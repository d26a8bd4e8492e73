"""Encoding, counts, token files and packing of small tables, against the library and by hand."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshloom.llm import packing, token_file
from meshloom.llm.bpe import decoded, encoded, round_trip_digests
from meshloom.llm.common import fresh_dir
from meshloom.llm.token_counts import token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
B, W = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
ROWS = [(5, "Hello  world, hello!"), (3, None), (-2, ""), (9, "é <|endoftext|> x"), (3, "again"), (None, "no id"), (7, "long text. " * 900), (8, "Hello  world, hello!"), (11, "zz " * 3000)]


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def test_round_trip(make):
    docs = make(ROWS)
    want = []
    for i, t in ROWS:
        own = ids(B, t)
        want.append((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(B.decode(own, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, round_trip_digests(docs, BYTE).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, decoded(encoded(docs, BYTE), BYTE).collect()), key=key) == sorted(((i, t or "") for i, t in ROWS), key=key)


def test_counts(make):
    want = [(i, len((t or "").encode()), len(ids(B, t)), len(ids(B, t)) > 5) for i, t in ROWS]
    assert sorted(map(tuple, token_counts(make(ROWS), BYTE, 5).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_token_files(spark, make, parts):
    folder = fresh_dir(spark, "t")
    docs = make(ROWS)
    n = token_file.write_tokens(docs, WORD, folder, 1, parts)
    got = [tuple(r) for r in token_file.token_index(spark, folder, n).collect()]
    at, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        own = [*ids(W, t), 1]
        want.append((i, at, len(own), crc(own)))
        at += len(own)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert token_file.write_tokens(docs.where("doc_id > 100"), WORD, fresh_dir(spark, "t"), 1, parts) == 0


def test_lost_task_of_the_last_step(spark, make):
    """A file that stands without its draft is left as it is."""
    folder = fresh_dir(spark, "t")
    n = token_file.write_tokens(make(ROWS), WORD, folder, 1, 2)
    before = sorted(map(tuple, token_file.token_index(spark, folder, n).collect()), key=key)
    assert before == sorted(map(tuple, token_file.token_index(spark, folder, n).collect()), key=key)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_variable_length_code(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    control, data = token_file.pack(values)
    assert len(control) == -(-n // 4) and (token_file.unpack(control, data, n) == values).all()


def test_range_part(spark):
    from pyspark.sql import functions as F

    bounds = [-5, 0, 3, 4, 100]
    for some in ([], bounds[:1], bounds):
        got = {r["x"]: r["p"] for r in spark.createDataFrame([(x,) for x in [-9, -5, -4, 0, 1, 3, 4, 5, 100, 101, None]], "x long").select("x", token_file.range_part(F.col("x"), some).alias("p")).collect()}
        assert got == {x: (0 if x is None else sum(b < x for b in some)) for x in got}


def check_packing(rows, texts, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert total == sum(len(ids(W, t)) + 1 for _, t in texts)
    return len(by), -(-total // capacity)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(make, capacity):
    rows = packing.packed(make(ROWS), WORD, capacity).collect()
    got, least = check_packing(rows, ROWS, capacity)
    assert got <= least + 1
    for r in rows:
        if r["doc_id"] == 9:
            own = [*ids(W, dict(ROWS)[9]), 0][r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and crc(own) == r["ids_crc32"]
    assert packing.packed(make(ROWS).where("false"), WORD, capacity).count() == 0


def brute(lengths, capacity):
    """The least number of sequences, by trying everything."""
    best = len(lengths)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(lengths):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + lengths[i] <= capacity:
                go(i + 1, [*loads[:k], loads[k] + lengths[i], *loads[k + 1 :]])
        go(i + 1, [*loads, lengths[i]])

    go(0, [])
    return best


def test_solver_on_small_cases():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 11, 9).tolist(), reverse=True)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing.solve(histogram, 10)
        least = brute(lengths, 10)
        assert plan.bound <= least <= plan.sequences <= least + 1
        used = {}
        for config, n in plan.patterns:
            assert sum(s * a for s, a in config) <= 10
            for s, a in config:
                used[s] = used.get(s, 0) + a * n
        assert used == histogram


def test_solver_on_many_lengths():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1, 30_000).astype(int) + 1, 2047)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.solve(histogram, 2048)
    assert plan.bound <= plan.sequences <= plan.bound * 1.002 + 1
    sizes = np.array(sorted(histogram))
    plain = sum(packing.best_fit(sizes, np.array([histogram[int(s)] for s in sizes]), 2048).values())
    assert plan.sequences <= plain
    with pytest.raises(ValueError):
        packing.solve({3000: 1}, 2048)


@pytest.mark.parametrize(("low", "high", "each", "least"), [(520, 1020, 1200, 233_700), (690, 1031, 2000, 339_600), (520, 1020, 12, 2330)])
def test_the_program_is_solved(low, high, each, least):
    """Lengths that don't fill the capacity: the bound is far above the volume, and rounding comes near it."""
    histogram = dict.fromkeys(range(low, high), each)
    plan = packing.solve(histogram, 2048)
    assert plan.bound >= least > 1.01 * sum(s * n for s, n in histogram.items()) / 2048
    assert plan.fractional <= plan.bound * (1 + packing.GAP) + 1
    assert plan.bound <= plan.sequences <= plan.bound * 1.005 + 20
    used = {}
    for config, n in plan.patterns:
        assert sum(s * a for s, a in config) <= 2048
        for s, a in config:
            used[s] = used.get(s, 0) + a * n
    assert used == histogram


def run_by_run(lengths, capacity):
    """Best fit, one run after the other."""
    gaps = []
    for size in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - size)
    return sorted(gaps)


def test_best_fit_of_counts_is_best_fit():
    rng = np.random.default_rng(7)
    for n in (1, 5, 40, 300):
        lengths = rng.integers(1, 60, n).tolist()
        sizes, count = np.unique(lengths, return_counts=True)
        found = packing.best_fit(sizes, count, 100)
        assert sorted(100 - sum(int(sizes[i]) * a for i, a in config) for config, times in found.items() for _ in range(times)) == run_by_run(lengths, 100)


@pytest.mark.parametrize(("low", "high", "n"), [(1000, 1060, 5000), (520, 1020, 6000), (400, 900, 6000)])
def test_a_plan_is_no_worse_than_best_fit(low, high, n):
    histogram = dict(zip(*(x.tolist() for x in np.unique(np.random.default_rng(low).integers(low, high, n), return_counts=True)), strict=True))
    sizes = np.array(sorted(histogram))
    plain = sum(packing.best_fit(sizes, np.array([histogram[int(s)] for s in sizes]), 2048).values())
    plan = packing.solve(histogram, 2048)
    assert plan.bound <= plan.sequences <= plain and (low == 1000 or plan.sequences < 0.97 * plain)


def test_files_are_closed_when_full(spark, make, monkeypatch):
    """Many files for a range, and documents longer than what is decoded at once."""
    monkeypatch.setattr(token_file, "FILE_IDS", 50)
    monkeypatch.setattr(token_file, "SLICE_IDS", 8)
    rows = [(i, f"some words of text number {i} " * (1 + i % 7)) for i in range(200)]
    docs = make(rows)
    folder = fresh_dir(spark, "t")
    monkeypatch.setattr(token_file, "blocks", lambda batches: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    files = token_file.write_tokens(docs, WORD, folder, 1, 2)
    assert files > 20
    got = {r["doc_id"]: r for r in token_file.read_tokens(spark, folder, files).collect()}
    at = 0
    for i, t in rows:
        own = [*ids(W, t), 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (at, len(own), crc(own), np.array(own, "<u4").tobytes())
        at += len(own)
