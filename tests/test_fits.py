"""Fits to the ends and to pieces of hairpins."""

import itertools

import numpy as np
import pytest

from cyclarium import catalog
from cyclarium.functions import fits
from cyclarium.functions.peaks import NO_MATCH, chi_squared
from cyclarium.operators import peaks as op
from cyclarium.queries import peaks as peak_queries

SCALE = 8.8e-4


@pytest.mark.parametrize(("stretch", "bias"), list(itertools.product([0.96, 1.0, 1.04], [-0.05, 0.0, 0.05])))
def test_ends_of_a_bead(stretch, bias):
    seq = np.array([0.01, 0.02, 0.035, 0.7, 0.85, 0.95])
    cost, s, (low, high) = fits.edge_fit([seq[:3] / SCALE, (seq[3:] - 0.5) / SCALE], seq / stretch + bias)
    assert (s * SCALE, low) == pytest.approx((stretch, bias), rel=5e-4, abs=5e-4)
    assert cost == pytest.approx(0, abs=1e-6) and high == pytest.approx(bias + 0.5 / stretch, abs=5e-4)


def exhaustive(theory, peaks, stretch, spread, slack, window):
    """The best of all products of pairs of both ends."""
    bounds = stretch * (1 - spread), stretch * (1 + spread)
    own = fits.ends_of(theory, peaks, bounds, slack)
    if any(len(p) < 2 for p in own):
        return NO_MATCH
    best = NO_MATCH
    each = [[np.array([(i, k), (j, m)]) for i, j in itertools.combinations(range(len(t)), 2) for k, m in itertools.combinations(range(len(p)), 2) if p[m] > p[k] and bounds[0] <= (t[j] - t[i]) / (p[m] - p[k]) <= bounds[1]] for t, p in zip(theory, own)]
    for pairs in itertools.product(*each):
        made = fits.edge_cost(theory, own, list(pairs), window)
        best = min(best, made[0] if made else NO_MATCH)
    return best


def test_ends_by_exhaustive_search():
    """The edges that meet hold the best of all products, for beads with noise, missing and spurious peaks."""
    rng = np.random.default_rng(5)
    hits = 0
    for _ in range(60):
        theory = [np.sort(rng.uniform(0, 150, 4)), np.sort(rng.uniform(900, 1100, 4))]
        whole = np.concatenate(theory)
        keep = rng.random(8) > 0.15
        peaks = whole[keep] / rng.uniform(0.95, 1.05) + rng.normal(0, 1.5, keep.sum()) + rng.uniform(-20, 20)
        peaks = np.sort(np.concatenate([peaks, rng.uniform(0, 1000, rng.integers(0, 3))]))
        got = fits.edge_fit(theory, peaks, 1.0, 0.1, 30.0, 8.0)[0]
        want = exhaustive(theory, peaks, 1.0, 0.1, 30.0, 8.0)
        assert got >= want - 1e-9
        assert got == pytest.approx(want)
        hits += want < NO_MATCH
    assert hits > 40


def test_edges_in_order():
    rng = np.random.default_rng(6)
    t, p = np.sort(rng.uniform(0, 10, 7)), np.sort(rng.uniform(0, 9, 6))
    got = {tuple(r[:4].astype(int)) for r in fits.edges(t, p, (0.8, 1.3))}
    assert got == {(i, j, k, m) for i, j in itertools.combinations(range(7), 2) for k, m in itertools.combinations(range(6), 2) if 0.8 <= (t[j] - t[i]) / (p[m] - p[k]) <= 1.3}


@pytest.mark.parametrize(("stretch", "bias", "gap"), list(itertools.product([0.96, 1.0, 1.04], [-0.05, 0.0, 0.05], [0.1, 0.05])))
def test_pieces_of_a_hairpin(stretch, bias, gap):
    own = [np.array([0.1, 0.5, 1.0]), np.array([2.0, 2.25, 3.0])]
    placed = [x / stretch + bias for x in own]
    peaks = np.concatenate([placed[0], placed[1] - placed[1][0] + placed[0][-1] + gap])
    out = fits.pieces_fit([x / SCALE for x in own], peaks, bias=(-3.0, 3.0), ordered=False)
    assert [s for _, s, _ in out] == pytest.approx([stretch / SCALE] * 2, rel=1e-3)
    one, two = fits.joined([x / SCALE for x in own], out)
    assert two - one[-1] == pytest.approx((own[1] - own[1][0] + gap * stretch) / SCALE, abs=1)


def test_pieces_in_order():
    """A piece in order takes the peaks above the first's; without order it may take any that are left."""
    pieces = [np.array([0.0, 100.0, 250.0]), np.array([0.0, 60.0, 200.0])]
    peaks = np.concatenate([pieces[0], pieces[1] + 400])
    fit = lambda peaks, **o: fits.pieces_fit(pieces, peaks, 1.0, 0.05, (-1000.0, 1000.0), 5.0, 0.1, 1000.0, **o)
    out = fit(peaks)
    assert [(round(s, 6), round(b, 6)) for _, s, b in out] == [(1, 0), (1, 400)]
    turned = np.concatenate([pieces[1], pieces[0] + 400])
    assert [(round(s, 6), round(b, 6)) for _, s, b in fit(turned, ordered=False)] == [(1, 400), (1, 0)]
    (_, s1, b1), (_, s2, b2) = fit(turned)
    assert pieces[0][-1] / s1 + b1 < pieces[1][0] / s2 + b2
    with pytest.raises(ValueError):
        fits.pieces_fit([*pieces, pieces[0]], peaks)
    assert all(c == NO_MATCH for c, _, _ in fits.pieces_fit(pieces, np.array([1.0])))


def test_pieces_by_exhaustive_search():
    """Breaking off at dear candidates loses nothing."""
    rng = np.random.default_rng(7)
    for _ in range(15):
        pieces = [np.sort(rng.uniform(0, 300, 3)), np.sort(rng.uniform(0, 300, 3))]
        peaks = np.sort(np.concatenate([pieces[0] / 1.02 + 10, pieces[1] / 1.02 + 320 + rng.normal(0, 1, 3), rng.uniform(0, 600, 1)]))
        best = 2 * NO_MATCH
        for i in (0, 1):
            for a in fits.candidates(pieces[i], peaks, (0.9, 1.1), (-700.0, 700.0), 6.0):
                rest = fits._rest(pieces[i], peaks, a, 6.0, False, i == 0)
                for b in fits.candidates(pieces[1 - i], rest, (a[1] - 0.1, a[1] + 0.1), (a[2] - 700, a[2] + 700), 6.0):
                    best = min(best, a[0] + b[0])
        got = fits.pieces_fit(pieces, peaks, 1.0, 0.1, (-700.0, 700.0), 6.0, 0.1, 700.0, ordered=False)
        assert sum(c for c, _, _ in got) == pytest.approx(best)
        first = min((0, 1), key=lambda k: abs(got[k][0] - chi_squared(pieces[k], peaks, *got[k][1:], 6.0)))
        assert got[first][0] == pytest.approx(chi_squared(pieces[first], peaks, *got[first][1:], 6.0))


def test_beads_are_fitted_by_themselves(spark):
    seq = np.array([10.0, 25.0, 60.0, 700.0, 850.0, 950.0])
    rows = [("t", b, float(x) / 1.02 + b) for b in range(4) for x in seq] + [("t", 9, 1.0), ("t", 9, None)]
    beads = spark.createDataFrame(rows, "track string, bead bigint, peakposition double")
    hairpins = {"A": (seq[:3].tolist(), seq[3:].tolist()), "B": ([0.0, 100.0], [500.0, 990.0])}
    got = {(r.bead, r.hpin): r for r in op.fit_ends(beads, hairpins, stretch=1.0, slack=20.0, window=5.0).collect()}
    assert got.keys() == {(b, h) for b in (0, 1, 2, 3, 9) for h in "AB"}
    assert all(got[b, "A"].stretch == pytest.approx(1.02) and got[b, "A"].bias == pytest.approx(b) for b in range(4)) and got[9, "A"].cost == NO_MATCH
    parts = op.fit_pieces(beads, {"A": [seq[:3].tolist(), seq[3:].tolist()]}, stretch=1.0, bias=(-20.0, 20.0), window=5.0, stretch_step=0.1, bias_step=20.0)
    own = {(r.bead, r.piece): (r.stretch, r.bias) for r in parts.where("bead < 9").collect()}
    assert own == {(b, i): (pytest.approx(1.02), pytest.approx(b)) for b in range(4) for i in (0, 1)}


def test_queries_by_loops(spark, sf_dir):
    """Each bead's fits are those of its own peaks alone."""
    own = {}
    for r in peak_queries._peaks(spark, sf_dir).select("track", "bead", "peakposition").distinct().collect():
        own.setdefault((r.track, r.bead), []).append(r.peakposition)
    ends = {(r.track, r.bead, r.hpin): (r.cost, r.stretch, r.bias, r.topbias) for r in catalog.queries()["fit_ends"](spark, sf_dir).collect()}
    parts = {(r.track, r.bead, r.hpin, r.piece): (r.cost, r.stretch, r.bias) for r in catalog.queries()["fit_pieces"](spark, sf_dir).collect()}
    assert len(ends) == len(own) * len(peak_queries.ENDS) and any(c is not None for c, *_ in ends.values())
    for (track, bead), x in own.items():
        for h, both in peak_queries.ENDS.items():
            cost, stretch, biases = fits.edge_fit(list(both), np.array(x), **peak_queries.FITTED)
            assert ends[track, bead, h] == (pytest.approx(cost) if cost < NO_MATCH else None, *map(pytest.approx, (stretch, *biases)))
        for h, pieces in peak_queries.PIECES.items():
            made = fits.pieces_fit(pieces, np.array(x), **peak_queries.PIECED)
            assert [parts[track, bead, h, i] for i in range(len(pieces))] == [(pytest.approx(c) if c < NO_MATCH else None, pytest.approx(s), pytest.approx(b)) for c, s, b in made]
