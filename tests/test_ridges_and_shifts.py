"""Peaks by wavelets and shifts by expected positions, on planted data."""

import numpy as np
import pytest

from cyclarium import catalog
from cyclarium.functions import expected, wavelets
from cyclarium.queries import peaks as queries


def bumps(centres, sigma, n=400, heights=None):
    x = np.arange(n)
    return sum(h * np.exp(-0.5 * ((x - c) / sigma) ** 2) for c, h in zip(centres, heights or [1.0] * len(centres)))


def test_wavelet_by_its_formula():
    w = wavelets.ricker(41, 4.0)
    assert w[20] == pytest.approx(2 / (np.sqrt(3 * 4.0) * np.pi**0.25)) and w[16] == pytest.approx(0, abs=1e-12)
    assert (w == w[::-1]).all() and (w**2).sum() == pytest.approx(1, rel=1e-3) and abs(wavelets.ricker(121, 4.0).sum()) < 1e-6


def test_transform_by_loops():
    y = np.random.default_rng(1).normal(size=60)
    for row, width in zip(wavelets.transform(y, np.array([2, 3])), (2, 3)):
        w = wavelets.ricker(10 * width, width)
        for i in range(20, 40):
            assert row[i] == pytest.approx(sum(w[k] * y[i + k - len(w) // 2] for k in range(len(w))) if len(w) % 2 else sum(w[::-1][len(w) - 1 - k] * y[i + k - len(w) // 2] for k in range(len(w))), abs=1e-9)


@pytest.mark.parametrize("sigma", [4.0, 6.0, 8.0])
def test_planted_peaks(sigma):
    centres = [40, 120, 170, 300]
    y = bumps(centres, sigma, heights=[1.0, 0.3, 0.6, 1.0]) + np.random.default_rng(2).normal(0, 0.004, 400)
    found = wavelets.find_peaks(y)
    assert all(np.abs(found - c).min() <= 2 for c in centres)
    strong = [p for p in found if y[max(0, p - 2) : p + 3].max() > 0.1]
    assert len(strong) == 4


def test_flat_and_short_densities():
    assert len(wavelets.find_peaks(np.zeros(100))) == 0 and len(wavelets.find_peaks(np.array([1.0, 2.0]))) == 0


def test_ridges_end_after_gaps():
    rows = np.zeros((4, 30))
    for r, p in ((3, 10), (2, 11), (0, 12), (1, 25)):
        rows[r, p] = 1.0
    near = wavelets.ridges(rows, np.full(4, 2.0), 2.0)
    assert sorted(map(tuple, near)) == [((1, 25),), ((3, 10), (2, 11), (0, 12))]
    assert len(wavelets.ridges(rows, np.full(4, 2.0), 0.0)) == 3
    assert len(wavelets.ridges(rows, np.full(4, 0.5), 2.0)) == 4


DATA = [np.array(z, float) for z in ([20, 50], [21, 51], [22, 52])]


@pytest.mark.parametrize("options", [{"rounds": 3}, {"rounds": 3, "discard": 0.5}])
def test_small_shifts(options):
    np.testing.assert_allclose(expected.expected_biases(DATA, 1.0, **options), [1, 0, -1], atol=0.1)


@pytest.mark.parametrize("symmetric", [False, True])
def test_planted_shifts(symmetric):
    rng = np.random.default_rng(4)
    peaks, shift = np.array([20.0, 50.0, 60.0, 90.0]), rng.uniform(-1.5, 1.5, 25)
    shift -= np.median(shift)
    cycles = [np.sort((peaks + s + rng.normal(0, 0.1, 4))[rng.random(4) < 0.8]) for s in shift]
    bias = expected.expected_biases(cycles, 1.0, symmetric=symmetric, rounds=3)
    full = [i for i, z in enumerate(cycles) if len(z)]
    before, after = np.std(shift[full]), np.std((bias + shift)[full])
    assert after < (0.35 if not symmetric else 1.0) * before
    assert all(bias[i] == 0 for i in range(25) if i not in full)


def test_cost_by_loops():
    own, others, p = np.array([1.0, 5.0, 30.0]), np.array([0.5, 1.5, 2.0, 5.2]), 1.0
    cost, seen = 0.0, 0.0
    for x in own + 0.3:
        near = [y for y in others if abs(y - x) <= 4]
        if near:
            w = [np.exp(-0.5 * (y - x) ** 2) for y in near]
            cost += ((x + sum(a * b for a, b in zip(near, w))) / (1 + sum(w)) - x) ** 2
            seen += np.log(len(near) + 1)
        else:
            cost += 16
    assert expected.likely_cost(0.3, own, others, p, 4.0, 0.1) == pytest.approx(cost / 3 + 0.1 / (seen + 0.001) * 0.09)
    assert expected.least(lambda x: (x - 0.7) ** 2, 2.0, 1e-6) == pytest.approx(0.7, abs=1e-5)


def test_no_events():
    assert expected.expected_biases([], 1.0).tolist() == [] and expected.expected_biases([np.zeros(0)], 1.0).tolist() == [0.0]
    assert expected.expected_biases([np.array([3.0])], 1.0).tolist() == [0.0]


@pytest.mark.parametrize(("name", "options"), [("expected_biases", {}), ("expected_biases_symmetric", {"symmetric": True, "rounds": 1, "average": 0.5})])
def test_queries_by_loops(spark, sf_dir, name, options):
    own = {}
    for r in queries._flat(spark, sf_dir).where("avg is not null").collect():
        own.setdefault((r.track, r.bead), {}).setdefault(r.cycle, []).append(r.avg)
    got = {(r.track, r.bead, r.cycle): r.bias for r in catalog.queries()[name](spark, sf_dir).collect()}
    assert len(got) == sum(map(len, own.values()))
    for key, cycles in own.items():
        names = sorted(cycles)
        bias = expected.expected_biases([np.sort(cycles[c]) for c in names], 3.0, **options)
        assert [got[*key, c] for c in names] == pytest.approx(bias.tolist(), abs=1e-8)


@pytest.mark.parametrize("symmetric", [False, True])
def test_costs_of_all_cycles_at_once(monkeypatch, symmetric):
    """Costs of several moves are those of one at a time, and so are the least ones, also in small blocks of cycles."""
    rng = np.random.default_rng(6)
    cycles = [np.sort(rng.uniform(0, 60, n)) for n in (3, 1, 4, 2, 3)]
    events, cycle = np.concatenate(cycles), np.repeat(np.arange(5), [len(z) for z in cycles])
    order = np.argsort(events)
    costs = expected.Costs(events, cycle, events[order], cycle[order], 3.0, 12.0, 0.1, 7.5 if symmetric else None)
    one = expected.symmetric_cost if symmetric else expected.likely_cost
    plain = [lambda x, i=i: one(x, cycles[i], np.sort(np.concatenate(cycles[:i] + cycles[i + 1 :])), 3.0, 12.0, 0.1) for i in range(5)]
    moves = rng.uniform(-7.5, 7.5, (6, 5))
    got = (costs.symmetric if symmetric else costs.likely)(moves)
    assert got.tolist() == [pytest.approx([f(x) for f, x in zip(plain, row)]) for row in moves]
    best = np.array([expected.least(f, 7.5, 3e-4) for f in plain])
    for size in (expected.PAIRS, 10):
        monkeypatch.setattr(expected, "PAIRS", size)
        assert expected.expected_biases(cycles, 3.0, symmetric=symmetric, rounds=1).tolist() == pytest.approx((best - np.median(best)).tolist(), abs=1e-9)
