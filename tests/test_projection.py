"""Projection of frames onto peaks against dense arrays, and against signals with known levels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclarium.operators import projection as op

LEVELS = (0.0, 0.5, 0.25, 0.0, -0.05)


def levels(n_cycles=100, moved=None, seed=0):
    """Cycles of five levels of ten frames each; the middle thirty frames are the measure phase."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_cycles):
        z = np.concatenate([rng.normal(0, 1e-3, 10) + x for x in LEVELS])
        z[10:40] += (moved or {}).get(c, 0.0)
        rows += [("t", 1, c * 50 + i, c, i, 5 if 10 <= i < 40 else 1, float(z[i])) for i in range(50)]
    return rows


def made(spark, rows):
    frames = spark.createDataFrame(rows, "track string, bead bigint, frame bigint, cycle int, cycleframe int, phase int, z double")
    return frames, frames.select("track", "bead").distinct().withColumn("precision", F.lit(1e-3))


def dense_heights(cycles, precision, c=op.Projection()):
    """The same heights by loops over arrays."""
    ends = [np.quantile([f(x[np.isfinite(x)]) for x in cycles], q) for f, q in ((np.min, c.edges[0]), (np.max, c.edges[1]))]
    low, span = ends[0] - c.overshoot * precision, ends[1] - ends[0] + 2 * c.overshoot * precision
    n = math.floor(span / (c.binwidth * precision) + 0.5) + 1
    width, size, out = span / (n + 1), c.bins(c.spread), []
    for z in cycles:
        d = np.array([math.floor((x - low) / width * c.digits + 0.5) if np.isfinite(x) else -1 for x in z])
        d[(d < 0) | (d // c.digits >= n)] = -1
        good = np.flatnonzero(d >= 0)
        hist = np.zeros(n)
        for k, i in enumerate(good):
            a = d[good[k - 1]] if k else d[i]
            b = d[good[k + 1]] if k + 1 < len(good) else a
            if abs(d[i] - (a + b) / 2) < c.bins(c.step) * c.digits:
                hist[d[i] // c.digits] += 1
        about = np.array([hist[max(0, j - size) : j + size + 1].sum() for j in range(n)])
        weight = np.where(about >= c.least_frames, 1 / np.maximum(about, 1), 0)
        heights = np.zeros(n)
        for i in good:
            top = rest = 0.0
            for j in range(i - c.neighbours, i + c.neighbours + 1):
                j = min(max(j, 0), len(d) - 1)
                if d[j] >= 0:
                    w = math.exp(-(((d[j] - d[i]) * c.bins(c.likeness) / c.digits) ** 2) / 2)
                    top, rest = top + w * weight[d[j] // c.digits], rest + w
            heights[d[i] // c.digits] += top / rest
        out.append(heights)
    return low, width, np.array(out)


def dense_means(heights, c=op.Projection()):
    half = c.weights()
    kernel = np.array(half[:0:-1] + half)
    hits = np.convolve((heights > 0).sum(0), kernel, "same")
    rate = np.where(hits > c.least_cycles, heights.sum(0) / np.maximum(hits, 1e-12), 0)
    return np.convolve(rate, kernel, "same")


def test_heights_equal_dense_arrays(spark):
    rows = levels(12, {3: 0.002})
    rows = [(*r[:6], float("nan") if r[2] % 17 == 0 else r[6]) for r in rows]
    frames, precision = made(spark, rows)
    cycles = [np.array([r[6] for r in rows if r[3] == c and r[5] == 5]) for c in range(12)]
    low, width, want = dense_heights(cycles, 1e-3)
    heights = op.cycle_heights(op.digitized(frames, precision))
    got = np.zeros_like(want)
    for r in heights.collect():
        got[r.cycle, r.bin] = r.height
        assert r.low == pytest.approx(low) and r.width == pytest.approx(width)
    np.testing.assert_allclose(got, want, atol=1e-9)
    means = {r.bin: r.density for r in op.mean_heights(heights).collect()}
    for i, x in enumerate(dense_means(want)):
        assert means.get(i, 0.0) == pytest.approx(x, abs=1e-9)


def test_peaks_and_events_of_levels(spark):
    frames, precision = made(spark, levels())
    _, biases, peaks = op.project(frames, precision)
    at = sorted(r.peakposition for r in peaks.collect())
    assert len(at) == 3 and np.allclose(at, [0.0, 0.25, 0.5], atol=2e-3)
    events = op.extract_events(frames, peaks, biases).collect()
    per = {}
    for e in events:
        per.setdefault(e.cycle, []).append(e)
    assert len(per) == 100 and all(sorted(e.peak for e in x) == [0, 1, 2] for x in per.values())
    assert all(8 <= e.length <= 10 and abs(e.avg + e.bias - e.peakposition) < 3e-3 for e in events)


def test_cycles_that_moved_are_moved_back(spark):
    shift = 5 * 1e-3 / 3
    frames, precision = made(spark, levels(60, {0: shift, 1: -shift}))
    for repeats in (1, 2):
        _, biases, _ = op.project(frames, precision, op.Projection(repeats=repeats))
        bins = {r.cycle: r.bias / (1e-3 / 3) for r in biases.collect()}
        assert abs(bins[0] - 5) < 3 and abs(bins[1] + 5) < 3 and all(abs(bins[c]) < 3 for c in range(2, 60))
    _, biases, _ = op.project(frames, precision, op.Projection(repeats=0))
    assert {r.bias for r in biases.collect()} == {0.0}


def test_missing_signals(spark):
    frames, precision = made(spark, [(*r[:6], None) for r in levels(3)])
    assert op.project_peaks(frames, precision).count() == 0
    assert op.project_peaks(frames.limit(0), precision.limit(0)).count() == 0
