"""Densities of peaks and fits to references, against arrays."""

import numpy as np
import pytest

from cyclarium.functions.peaks import NO_MATCH, match
from cyclarium.operators import references as op

STEP = 0.2


def plain_density(peaks, step=STEP, edge=20):
    """(low, densities) on an array; later kernels, which are wider or higher up, replace the ones below."""
    z = np.array([p for p, _ in peaks])
    low, high = z.min() - edge * step, z.max() + edge * step
    out = np.zeros(int(np.floor((high - low) / step)) + 1)
    w = np.rint(np.array([np.nan if r is None else r for _, r in peaks]) / step)
    good = w[w > 0]
    w = np.where(w > 0, w, int(np.percentile(good, 75)) if len(good) else 4).astype(int)
    for i in sorted(range(len(z)), key=lambda i: (w[i], z[i])):
        at = int(np.rint((z[i] - low) / step))
        d = np.arange(-2 * w[i], 2 * w[i] + 1)
        k = np.exp(-0.5 * (d / w[i]) ** 2)
        for x, y in zip(at + d, k / k.sum()):
            if 0 <= x < len(out):
                out[x] = y
    return low, out


def plain_profile(low, y, pivot, step=STEP, least=1e-3):
    """(zero, x of kept bins, their heights) on an array."""
    enough = np.concatenate([[True], y >= least, [True]])
    kept = enough[1:-1] | enough[:-2] | enough[2:]
    x, v = np.flatnonzero(kept), y[kept].copy()
    tops = v[1:-1][(v[2:] < v[1:-1]) & (v[:-2] < v[1:-1])]
    v = np.minimum(v, np.median(tops)) if len(tops) else v
    zero = {"bottom": low, "top": low + (len(y) - 1) * step, "absolute": 0.0}[pivot]
    return zero, low - zero + x * step, v


def plain_cost(left, right, s, b, symmetry):
    at = lambda f, u: np.interp(u, f[1], f[2], left=0.0, right=0.0)
    out = 0.0
    if symmetry in ("both", "left"):
        out -= (at(left, (right[1] - b) * s) * right[2]).sum()
    if symmetry in ("both", "right"):
        out -= (at(right, left[1] / s + b) * left[2]).sum()
    return out


def beads(seed, n=5):
    rng = np.random.default_rng(seed)
    own = {b: np.sort(rng.uniform(0, 60, rng.integers(3, 7))) for b in range(n)}
    lines = {b: (rng.uniform(0.96, 1.04), rng.uniform(-3, 3)) for b in range(n)}
    spread = lambda: float(rng.uniform(0.3, 1.2))
    reference = {b: [(float(x), spread()) for x in z] for b, z in own.items()}
    moved = {b: [(float(x) / lines[b][0] + lines[b][1], spread() if rng.random() < 0.7 else None) for x in z] for b, z in own.items()}
    return reference, moved, lines


def tables(spark, reference, moved):
    left = spark.createDataFrame([(b, x, r) for b, rows in reference.items() for x, r in rows], "bead int, peakposition double, resolution double")
    right = spark.createDataFrame([("t", b, x, r) for b, rows in moved.items() for x, r in rows] + [("t", 77, 1.0, 0.5)], "track string, bead int, peakposition double, resolution double")
    return left, right


def test_densities_by_arrays(spark):
    _, moved, _ = beads(1)
    moved[9] = [(3.0, None), (4.0, 0.0), (5.0, None)]
    rows = spark.createDataFrame([("t", b, x, r) for b, own in moved.items() for x, r in own], "track string, bead int, peakposition double, resolution double")
    got = {}
    for r in op.peak_density(rows, STEP).orderBy("bin").collect():
        got.setdefault(r.bead, []).append((r.low, r.density))
    for b, own in moved.items():
        low, want = plain_density(own)
        assert got[b][0][0] == pytest.approx(low)
        np.testing.assert_allclose([d for _, d in got[b]], want, atol=1e-12)


@pytest.mark.parametrize("pivot", ["bottom", "top", "absolute"])
def test_profiles_by_arrays(spark, pivot):
    _, moved, _ = beads(2)
    rows = spark.createDataFrame([("t", b, x, r) for b, own in moved.items() for x, r in own], "track string, bead int, peakposition double, resolution double")
    got = op.profile(op.peak_density(rows, STEP), STEP, pivot=pivot).orderBy("bin").collect()
    for b, own in moved.items():
        zero, x, y = plain_profile(*plain_density(own), pivot)
        kept = [(r.x, r.y) for r in got if r.bead == b and r.kept]
        np.testing.assert_allclose(kept, np.column_stack([x, y]), atol=1e-9)
        np.testing.assert_allclose([r.y for r in got if r.bead == b], np.interp([r.x for r in got if r.bead == b], x, y), atol=1e-9)
        assert next(r.zero for r in got if r.bead == b) == pytest.approx(zero)


@pytest.mark.parametrize(("symmetry", "pivot"), [("both", "bottom"), ("left", "top"), ("right", "absolute")])
def test_fits_by_arrays(spark, symmetry, pivot):
    reference, moved, _ = beads(3)
    left, right = tables(spark, reference, moved)
    grid = op.Grid((1.0, 0.05, 0.025), (0.0, 3.0, 1.0))
    got = {r.bead: r for r in op.fit_to_reference(left, right, STEP, grid, symmetry=symmetry, pivot=pivot, rounds=1).collect()}
    assert got.keys() == reference.keys()
    for b in reference:
        one, two = plain_profile(*plain_density(reference[b]), pivot), plain_profile(*plain_density(moved[b]), pivot)
        of = lambda options: min((round(plain_cost(one, two, s, x, symmetry), 9), s, x) for s, x in options)  # noqa: B023, E731
        best = of(grid.nodes())
        cost, s, x = of([(best[1] + i, best[2] + j) for i, j in grid.finer(1)])
        assert got[b].cost == pytest.approx(cost, abs=1e-8)
        assert (got[b].stretch, got[b].bias) == (pytest.approx(s), pytest.approx(x + two[0] - one[0] / s))


def plain_chi(theory, x, s, c, window):
    """Line and cost as chi_squared_fits defines them."""
    pairs = lambda s, c: match(theory, x * s + c, window)

    def line(found, s, c):
        if len(found) < 2 or np.var(x[[j for _, j in found]]) == 0:
            return s, c
        y, z = theory[[i for i, _ in found]], x[[j for _, j in found]]
        s = ((y - y.mean()) * (z - z.mean())).mean() / z.var()
        return s, y.mean() - s * z.mean()

    first = pairs(s, c)
    if len(first) > 1:
        s, c = line(first, s, c)
        again = pairs(s, c)
        if len(again) > len(first):
            s, c = line(again, s, c)
    found = pairs(s, c)
    if not found:
        return NO_MATCH, s, -c / s
    square = sum((theory[i] - (x[j] * s + c)) ** 2 for i, j in found) if len(found) > 1 else 0.0
    return np.sqrt((square / window**2 + (len(theory) + len(x) - 2 * len(found)) ** 2) / (2 * len(found))), s, -c / s


@pytest.mark.parametrize("method", ["corrected", "chisquare"])
def test_lines_through_pairs(spark, method):
    reference, moved, lines = beads(4)
    left, right = tables(spark, reference, moved)
    grid = op.Grid((1.0, 0.04, 0.02), (0.0, 3.0, 1.5))
    got = {r.bead: r for r in op.fit_to_reference(left, right, STEP, grid, method=method, window=1.5, first=0, rounds=2).collect()}
    best = {r.bead: r for r in op.fit_to_reference(left, right, STEP, grid, rounds=2).collect()}
    for b in reference:
        theory, x = np.array([p for p, _ in reference[b]]), np.array([p for p, _ in moved[b]])
        if method == "corrected":
            want = plain_chi(theory, x, best[b].stretch, -best[b].bias * best[b].stretch, 1.5)
        else:
            zero = [plain_density(rows[b])[0] for rows in (reference, moved)]
            options = [(s, y + zero[1] - zero[0] / s) for s, y in grid.nodes()]
            want = min(plain_chi(theory, x, s, -bias * s, 1.5) for s, bias in options)
        assert (got[b].cost, got[b].stretch, got[b].bias) == pytest.approx(want, abs=1e-7)
        assert (got[b].stretch, got[b].bias) == pytest.approx(lines[b], abs=1e-6)


def test_interpolator_keeps_what_lines_need(spark):
    y = [0.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.2, 5e-4, 0.0, 0.0]
    rows = spark.createDataFrame([("t", 1, i, v) for i, v in enumerate(y)] + [("t", 2, i, 0.3) for i in range(3)] + [("t", 1, 50, None)], "track string, bead int, bin long, density double")
    got = [(r.bead, r.bin, r.density) for r in op.interpolator(rows).orderBy("bead", "bin").collect()]
    assert got == [(1, 2, 0.0), (1, 3, 0.5), (1, 5, 0.5), (1, 6, 0.2), (1, 7, 0.0), (2, 0, 0.3), (2, 1, 0.3), (2, 2, 0.3)]


def test_nodes_of_a_grid_arent_rows(spark):
    """Profiles meet as arrays, one row for each bead; the best is that of a search by loops."""
    heights = [0.0, 1.0, 3.0, 1.0, 0.0, 2.0, 0.0]
    rows = lambda moved: spark.createDataFrame([("t", 1, i, 2.0 + moved, 2.0 + moved, True, y) for i, y in enumerate(heights)], "track string, bead int, bin long, start double, zero double, kept boolean, y double")
    grid = op.Grid((1.0, 0.1, 0.1), (0.0, 2.0, 1.0))
    out = op.fit_densities(rows(0.0).drop("track"), rows(1.0), 1.0, grid, 0)
    assert "Generate" not in out._jdf.queryExecution().toString()
    line = lambda start, x: float(np.interp(x, start + np.arange(7), heights, 0.0, 0.0))
    best = min((round(-sum(y * line(2.0, (3.0 + i - b) * s) + y * line(3.0, (2.0 + i) / s + b) for i, y in enumerate(heights)), 9), s, b) for s, b in grid.nodes())
    (got,) = out.collect()
    assert (got.cost, got.stretch, got.bias) == pytest.approx((best[0], best[1], best[2] + 3.0 - 2.0 / best[1]))
