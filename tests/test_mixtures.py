"""Mixtures of peaks against sums by hand and planted peaks."""

import math

import numpy as np
import pytest

from cyclarium import catalog
from cyclarium.functions import mixtures
from cyclarium.queries import peaks as peak_queries


def planted(seed=0, centres=(0.0, 0.1, 0.13, 0.4), sigma=2e-3, n=60):
    rng = np.random.default_rng(seed)
    z = np.concatenate([rng.normal(c, sigma, n) for c in centres])
    t = np.concatenate([rng.exponential(20.0 + 10 * i, n) + 1 for i in range(len(centres))])
    return z, t


def test_scores_by_hand():
    par = np.array([(0.4, 0.0, 1.0, 2.0), (0.6, 3.0, 0.5, 4.0)])
    z, t = np.array([0.5, 2.0, 9.0]), np.array([1.0, 3.0, 0.5])
    want = [[math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) * math.exp(-y / d) / d for _, m, s, d in par] for x, y in zip(z, t)]
    model = mixtures.Model()
    np.testing.assert_allclose(model.scores(z, t, par), want)
    like = sum(math.log(sum(w[0] * x for w, x in zip(par, row))) for row in want)
    assert model.likelihood(z, t, par) == pytest.approx(like)
    assert model.bic(z, t, par) == pytest.approx(-2 * like + 8 * math.log(3 / (2 * math.pi)))
    flat = [[math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) for _, m, s, _ in par] for x in z]
    np.testing.assert_allclose(mixtures.MODELS["gauss"].scores(z, t, par), flat)
    sharp = [[f * math.exp(-10 * y / d) * 10 / d for f, (_, _, _, d) in zip(row, par)] for row, y in zip(flat, t)]
    np.testing.assert_allclose(mixtures.MODELS["weighted"].scores(z, t, par), sharp)
    events = [1, 1]  # whole numbers of 1.2 and 1.8
    even = like + sum(k * math.log(1) - 1 - math.log(math.factorial(k)) for k in events)
    assert mixtures.MODELS["even"].likelihood(z, t, par) == pytest.approx(even)


def test_a_turn_never_lowers_the_likelihood():
    z, t = planted()
    par = mixtures.from_centres(z, t, np.array([0.0, 0.2, 0.4]))
    last = -math.inf
    for _ in range(30):
        now = mixtures.Model().likelihood(z, t, par)
        assert now >= last - 1e-9
        par, last = mixtures.Model(tries=1).fit(z, t, par), now


@pytest.mark.parametrize("method", mixtures.METHODS)
def test_planted_peaks(method):
    z, t = planted()
    centres = np.array([0.0, 0.1, 0.13, 0.4]) if method == "weighted" else np.array([0.0, 0.115, 0.4])
    places, ids = mixtures.find(z, t, centres, method, precision=3e-3)
    kept = [places[i] for i in range(len(places)) if (ids == i).sum() >= 10]
    assert kept == pytest.approx([0.0, 0.1, 0.13, 0.4], abs=3e-3)
    truth = np.repeat(range(4), 60)
    nearest = np.abs(places[np.maximum(ids, 0)][:, None] - np.array([0.0, 0.1, 0.13, 0.4])).argmin(axis=1)
    assert (nearest[ids >= 0] == truth[ids >= 0]).mean() > 0.97


def test_events_of_no_peak():
    z, t = planted(centres=(0.0, 0.5))
    par = mixtures.from_centres(z, t, np.array([0.0, 0.5]))
    places, ids = mixtures.assign(mixtures.Model(), np.append(z, 3.0), np.append(t, 20.0), par)
    assert ids[-1] == -1 and (ids[:-1] >= 0).mean() > 0.9 and places == pytest.approx([0, 0.5], abs=1e-3)
    assert mixtures.assign(mixtures.Model(), z, t, par, least=1000)[1].max() == -1
    assert len(mixtures.find(np.zeros(0), np.zeros(0), np.zeros(0))[0]) == 0
    places, ids = mixtures.find(np.array([1.0]), np.array([5.0]), np.zeros(0), least=1)
    assert places == pytest.approx([1.0]) and ids.tolist() == [0]
    with pytest.raises(ValueError):
        mixtures.find(z, t, places, "unknown")


@pytest.mark.parametrize("method", ["full", "random"])
def test_queries_by_loops(spark, sf_dir, method):
    """The query's peaks are those of each bead's events by themselves."""
    own = {}
    for r in peak_queries._flat(spark, sf_dir).where("avg is not null").collect():
        own.setdefault((r.track, r.bead), []).append((r.cycle, r.event, r.avg, r.length))
    got = {}
    for r in catalog.queries()[f"select_peaks_em_{method}"](spark, sf_dir).collect():
        got.setdefault((r.track, r.bead), set()).add((r.cycle, r.event, r.peak))
    assert got
    for key, rows in own.items():
        rows.sort()
        z, t = np.array([r[2] for r in rows]), np.array([float(r[3]) for r in rows])
        found = peak_queries.op.histogram_peaks(z, 1.5)
        places, ids = mixtures.find(z, t, found, method, precision=1.5, least=3)
        count = np.bincount(ids[ids >= 0], minlength=len(places))
        ids = np.where((ids >= 0) & (count[np.maximum(ids, 0)] >= 3), ids, -1) if len(places) else ids
        order = {int(k): i for i, k in enumerate(sorted(set(ids[ids >= 0].tolist()), key=lambda k: places[k]))}
        assert got.get(key, set()) == {(r[0], r[1], order[int(i)]) for r, i in zip(rows, ids) if i >= 0}


@pytest.mark.parametrize("model", [mixtures.Model(), mixtures.MODELS["gauss"], mixtures.MODELS["weighted"]])
def test_fits_in_step_are_those_one_by_one(monkeypatch, model):
    rng = np.random.default_rng(5)
    z, t = rng.normal(50, 18, 40), rng.integers(3, 20, 40).astype(float)
    starts = [mixtures.from_centres(z, t, rng.choice(z, k)) for k in (1, 2, 5, 5, 8)]
    for size in (mixtures.CELLS, 1000):
        monkeypatch.setattr(mixtures, "CELLS", size)
        for got, start in zip(mixtures.fit_all(model, z, t, starts), starts):
            np.testing.assert_allclose(got, model.fit(z, t, start), rtol=1e-6, atol=1e-9)
