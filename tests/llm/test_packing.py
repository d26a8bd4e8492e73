"""The plan comes from the program's amounts, not from best fit beside it."""

import numpy as np
import pytest

from meshloom.llm import packing


def histogram_of(lengths):
    return dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))


@pytest.mark.parametrize("lengths", [np.random.default_rng(1).lognormal(6, 1, 4000).astype(int).clip(1, 2047), np.random.default_rng(2).integers(400, 1500, 6000)])
def test_the_program_is_solved_for_very_many_lengths(lengths):
    """Nearly all lengths between differ: amounts meet the demand at little more than the bound."""
    histogram = histogram_of(lengths)
    sizes = np.array(sorted(histogram))
    plain = packing.best_fit(sizes, np.array([histogram[int(s)] for s in sizes]), 2048)
    plan = packing.solve(histogram, 2048)
    assert plan.fractional <= 1.1 * plan.bound
    assert plan.bound <= plan.sequences <= 1.002 * sum(plain.values()) + 1


def test_the_plan_is_rounded_from_the_amounts(monkeypatch):
    """Other amounts give another plan, though best fit would need fewer sequences."""
    histogram = {1000: 40, 500: 40, 24: 40}
    monkeypatch.setattr(packing, "amounts_of", lambda lengths, *rest: (packing.Counter({((len(lengths) - 1, 1),): 40.0}), 0.0, 40.0))
    plan = packing.solve(histogram, 2048)
    assert plan.sequences == 40 and all((1000, 1) in config for config, _ in plan.patterns)


def test_rounds_go_on_until_the_gap_is_closed():
    """Lengths for which hundreds of Newton steps don't reach the gap."""
    plan = packing.solve(histogram_of(np.random.default_rng(2).integers(400, 1500, 6000)), 2048)
    assert plan.fractional <= plan.bound * (1 + packing.GAP)


@pytest.mark.parametrize(("low", "high", "n"), [(520, 1020, 600), (100, 900, 300), (1000, 1060, 500)])
def test_the_simplex_method_closes_the_gap(monkeypatch, low, high, n):
    """Where weights get too steep before the gap is closed."""
    monkeypatch.setattr(packing, "LAST_RATE", 0.0)
    histogram = histogram_of(np.random.default_rng(low).integers(low, high, n))
    lengths = np.array(sorted(histogram))
    count = np.array([histogram[int(s)] for s in lengths])
    amounts, bound, total = packing.amounts_of(lengths, count, 2048)
    cover = np.zeros(len(lengths))
    for config, times in amounts.items():
        assert sum(int(lengths[i]) * a for i, a in config) <= 2048
        for i, a in config:
            cover[i] += a * times
    assert (cover >= count * (1 - 1e-9)).all() and bound <= total <= bound * (1 + packing.GAP)
