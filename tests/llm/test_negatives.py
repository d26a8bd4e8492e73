"""Hard negatives against all pairs: clusters, equal vectors, ties, odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meshloom.llm import negatives as n


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100):
    good = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in good:
        if not anchor(i):
            continue
        score = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in good)
        for less, p, _ in [x for x in score if x[2] == label and x[1] != i][:positives]:
            fit = [(s, j) for s, j, other in score if other != label and low * -less <= 100 * -s <= high * -less][:negatives]
            out += [(i, p, k + 1, j, -less, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, label, v, 1.0, "x") for i, label, v in rows], "vec_id long, label int, embedding array<float>, distance double, cell string").repartition(parts)


def exact(x):
    return round(x * 1024) / 1024  # as a float32 has it


def clusters(seed, size=360, dim=12):
    rng = random.Random(seed)
    means = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(size):
        k = rng.randrange(6)
        rows.append((i, k % 4 if rng.random() < 0.6 else rng.randrange(4), [exact(x + rng.gauss(0, 0.08)) for x in means[k]]))
    return rows


@pytest.fixture
def small(monkeypatch):
    """Many blocks, chunks and rounds in a small table."""
    for name, value in {"BLOCK": 16, "CHUNK": 8, "FIRST": 20, "GROWTH": 3}.items():
        monkeypatch.setattr(n, name, value)


def test_clusters_in_many_rounds(spark, small):
    rows, told = clusters(1), []
    made = sorted(tuple(r) for r in n.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, told=lambda *x: told.append(x)).collect())
    assert made == brute(rows, lambda i: i % 20 == 0)
    assert len(made) > 100
    assert len(told) > 6
    assert told[-1][1] == 0


def test_equal_vectors_and_ties(spark, small):
    rows = clusters(2, 200, 4)
    rows += [(1000 + i, i % 3, [0.25, 0.5, -0.125, 0.0]) for i in range(150)]
    made = sorted(tuple(r) for r in n.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, low=60, positives=3, negatives=7).collect())
    assert made == brute(rows, lambda i: i % 50 == 0, 3, 7, 60)


def test_odd_rows(spark):
    rows = [*clusters(3, 60, 3), (None, 1, [0.1, 0.2, 0.3]), (100, None, [0.1, 0.2, 0.3]), (110, 1, None), (120, 1, [0.1, None, 0.3]), (130, 1, [0.1, float("nan"), 0.3])]
    rows += [(140, 1, [0.1, float("inf"), 0.3]), (150, 2, []), (160, 2, [0.5]), (170, 0, [0.0, 0.0, 0.0]), (61, 3, [exact(0.3), exact(0.1), exact(0.2)]), (70, 3, [-0.25, -0.5, -0.5])]
    made = sorted(tuple(r) for r in n.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect())
    assert made == brute(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(0, 1, [1.0])], [(0, 1, [1.0]), (0, 1, [1.0])], [(0, 1, []), (1, 1, []), (2, 2, [])]])
def test_few_rows(spark, rows):
    made = sorted(tuple(r) for r in n.hard_negatives(frame(spark, rows, 1), F.col("vec_id") % 10 == 0).collect())
    assert made == brute(rows, lambda i: i % 10 == 0)


def test_repeated_rows_stay_rows(spark):
    rows = clusters(4, 80, 3)
    twice = [*rows, rows[7], rows[8]]
    made = sorted(tuple(r) for r in n.hard_negatives(frame(spark, twice), F.col("vec_id") % 10 == 0).collect())
    assert made == brute(twice, lambda i: i % 10 == 0)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, [float(rng.randrange(-(1 << 20), 1 << 20)) for _ in range(4)]) for i in range(60)]
    made = sorted(tuple(r) for r in n.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0).collect())
    assert made == brute(rows, lambda i: i % 5 == 0)
    with pytest.raises(ValueError, match="64 bits"):
        n.hard_negatives(frame(spark, [(0, 1, [1e12])]), F.col("vec_id") == 0)
