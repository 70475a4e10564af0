"""Kernels against small cases with known answers."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cyclarium.functions import cleaning, distributions, events, filters, peaks

NAN = np.nan


def test_constant_runs():
    z = np.arange(50.0)
    for s in (slice(0, 3), slice(10, 13), slice(20, 30), slice(40, 42), slice(47, 50)):
        z[s] = 100
    lost = lambda n: np.flatnonzero(np.isnan(cleaning.constant_runs(z, n))).tolist()
    assert lost(3) == [1, 2, 11, 12, *range(21, 30), 48, 49]
    assert lost(5) == list(range(21, 30))


def test_local_missing():
    z = np.ones(100)
    z[[7, 10, 19, 21]] = NAN
    assert np.flatnonzero(np.isnan(cleaning.local_missing(z, 1, 50))).tolist() == [7, 10, 19, 20, 21]


def test_islands():
    z = np.ones(100)
    for a, b in ((5, 15), (20, 35), (55, 65), (70, 85)):
        z[a:b] = NAN
    z[[15, 17, 19]] = 2.0
    out = cleaning.islands(z)
    assert np.isnan(out[5:35]).all()
    assert np.isfinite(out[65:70]).all()


def test_derivate_and_aberrant():
    z = np.zeros(50)
    z[10], z[20] = 100, 1
    out = cleaning.derivate(z)
    assert np.flatnonzero(np.isnan(out)).tolist() == [10, 20] or set(np.flatnonzero(np.isnan(out))) >= {10, 20}
    assert cleaning.aberrant(np.full(20, NAN))[1]


def test_interval_extension_stays_in_bounds():
    z = np.ones(30)
    z[7:] += 5
    out = events.extend(z, [(0, 5), (7, 9), (20, 25)], 1.1)
    assert out[0] == (0, 7)
    assert out[1][0] == 7


def test_merge_by_test():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1e-3, 30)
    parts = [(0, 10), (11, 20), (22, 30)]
    assert events.merge_by_test(z, parts) == [(0, 30)] or len(events.merge_by_test(z, parts)) < 3
    z[11:20] += 1
    assert events.merge_by_test(z, parts) == parts
    z[:10] += 1
    assert events.merge_by_test(z, parts) == [(0, 20), (22, 30)] or len(events.merge_by_test(z, parts)) == 2


def test_range_and_population_mergers():
    z = np.arange(100.0)
    assert events.merge_by_population(z, [(0, 10), (5, 17), (8, 20), (30, 40), (37, 41)], 75) == [(0, 10), (5, 20), (30, 41)]
    assert events.merge_by_range(z, [(0, 10), (5, 17), (8, 23), (30, 40), (35, 41)], 70) == [(0, 10), (5, 23), (30, 41)]


def test_selector():
    z = np.ones(100)
    assert events.select(z, [(0, 0), (1, 1), (5, 10)], 0, 5) == [(5, 10)]
    assert events.select(z, [(0, 0), (1, 1), (5, 10), (20, 30)], 1, 5) == [(21, 29)]
    z = np.ones(50)
    z[0:5] = z[10:15] = NAN
    z[19] = NAN
    assert events.select(z, [(0, 15), (10, 20)], 0, 5) == [(0, 15)]


def test_splits_find_steps():
    z = np.concatenate([np.full(20, x) for x in (20.0, 19.0, 18.0, 17.0)]) + np.random.default_rng(1).normal(0, 0.01, 80)
    found = events.detect(z, 0.02)
    assert len(found) == 4
    assert all(abs(a - 20 * i) <= 3 for i, (a, _) in enumerate(found))


def test_collapse():
    lines = [(5, np.zeros(5)) for _ in range(5)]
    profile, count = filters.collapse_to_mean(lines, 20)
    assert (count[5:10] == 5).all() and np.allclose(profile, 0)
    grid = [(5, np.arange(25.0).reshape(5, 5)[i]) for i in (1, 2, 3)]
    for collapse in filters.COLLAPSE.values():
        profile, _ = collapse(grid, 20)
        assert np.allclose(np.diff(profile[5:10]), 1)


def test_stitch():
    profile, count = np.array([0.0, 1, 0, 3, 4]), np.array([10, 10, 0, 10, 10])
    for how in ("interpolation", "fit", "slope"):
        assert np.allclose(filters.stitch(profile, count, 10, how), [0, 1, 2, 3, 4], atol=1.01)


def test_filters_keep_levels():
    z = np.concatenate([np.zeros(50), np.ones(50)])
    z[3] = NAN
    for f in (filters.forward_backward, filters.non_linear):
        out = f(z)
        assert math.isnan(out[3]) and np.allclose(out[[20, 80]], [0, 1], atol=1e-3)


def test_matching():
    ref = np.array([1.0, 5, 10, 32])
    assert peaks.match(ref, ref - 1, 10) == [(i, i) for i in range(4)]
    assert peaks.match(ref, np.array([0.8, 6, 35]), 10) == [(0, 0), (1, 1), (3, 2)]
    assert peaks.match(ref, np.array([0.8, 35, 37]), 10) == [(0, 0), (3, 1)]
    assert peaks.match(ref, np.array([-100.0, 5, 37]), 10) == [(1, 1), (3, 2)]


def test_grid_fit_recovers():
    theory = np.array([0, 0.1, 0.2, 0.5, 1, 1.5]) / 8.8e-4
    x = ((theory * 1.03 + 1) * 8.8e-4)[:-1]
    cost, stretch, bias = peaks.grid_fit(theory, x)
    assert np.allclose((x - bias) * stretch, theory[:-1], atol=1e-2)
    assert peaks.gaussian_fit(theory, theory * 8.8e-4)[0] < 1e-3


def test_mixture_finds_levels():
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(m, 0.01, 100) for m in (0, 0.5, 1)])
    par, resp = peaks.best_mixture(z, rng.exponential(10, 300) + 1, 5)
    assert len(par) >= 3 and np.abs(par[:, 1][:, None] - [0, 0.5, 1]).min(axis=0).max() < 0.02


@pytest.mark.parametrize("given", [True, False])
def test_mixture_has_no_largest_number_of_levels(given):
    rng = np.random.default_rng(1)
    levels = np.arange(14) * 10.0
    z = np.concatenate([rng.normal(m, 0.5, 25) for m in levels])
    par, resp = peaks.best_mixture(z, rng.exponential(10, len(z)) + 1, centres=levels[::2] if given else None, precision=0.3)
    assert len(par) == 14 and np.abs(par[:, 1] - levels).max() < 0.5
    assert (resp.argmax(axis=1) == np.repeat(np.arange(14), 25)).all()
    assert len(peaks.best_mixture(z, z + 1, 5)[0]) <= 5
    one = peaks.best_mixture(np.array([3.0]), np.array([2.0]), centres=np.array([3.0]))
    assert len(one[0]) == 1


def test_biases():
    true = np.array([0.0, 0.1, -0.1, 0.05, 0.0])
    means = np.array([[1.0], [2.0], [3.0]]) - true
    w = np.ones_like(means)
    for f in (peaks.min_bias, peaks.least_squares_bias):
        got = f(w, means)
        assert np.allclose(got - got.mean(), true - true.mean(), atol=1e-6)
    cycles = [np.array([1.0, 2, 3]) - b for b in true]
    assert np.allclose(peaks.cycle_biases(cycles, 0.02), true, atol=0.02)


@pytest.mark.parametrize(("p", "df", "x"), [(0.95, 1, 3.841459), (0.9, 3, 6.251389), (0.5, 10, 9.341818)])
def test_chi_squared(p, df, x):
    assert distributions.chi_squared_quantile(p, df) == pytest.approx(x, abs=1e-5)


@pytest.mark.parametrize(("t", "df", "p"), [(2.228139, 10, 0.975), (0.0, 4, 0.5), (-1.812461, 10, 0.05), (12.7062, 1, 0.975)])
def test_student(t, df, p):
    assert distributions.student_cdf(t, df) == pytest.approx(p, abs=1e-5)


@given(st.lists(st.floats(-10, 10) | st.just(NAN), max_size=60))
def test_detect_never_fails(values):
    z = np.array(values, float)
    found = events.detect(z, 0.1)
    assert all(0 <= a < b <= len(z) for a, b in found)
