"""Experiments on a common scale, by planted stretches and by hand."""

import numpy as np
import pytest

from cyclarium.operators import experiments as op
from cyclarium.operators.references import Grid

SCHEMA = "track string, bead int, peakposition double, hybridisationrate double, resolution double, avg double, std double"


def rows(spark, tracks):
    return spark.createDataFrame([(t, 1, float(p), float(h), 0.002, float(p) + 0.001, 0.003) for t, own in tracks.items() for p, h in own], SCHEMA)


def kept(df):
    return {(r.track, r.peakposition) for r in df.collect()}


def test_zero_by_hand(spark):
    tracks = {
        "weak": [(-0.3, 0.01), (-0.2, 0.02), (0.0, 0.9), (0.5, 0.01)],
        "strong below": [(-0.3, 0.01), (-0.2, 0.095), (-0.1, 0.01), (0.0, 0.9)],
        "nothing below": [(0.0, 0.2), (1.0, 0.01)],
        "no zero": [(0.0, 0.05), (1.0, 0.1)],
    }
    got = kept(op.find_zero(rows(spark, tracks), ["track"]))
    gone = {("weak", -0.3), ("weak", -0.2), ("strong below", -0.3)}
    assert got == {(t, p) for t, own in tracks.items() for p, _ in own} - gone


def test_masks_by_hand(spark):
    tracks = {t: [(float(i), 0.5) for i in range(4)] for t in "abcdef"}
    got = kept(op.mask_peaks(rows(spark, tracks), {"a": 2, "b": -1, "c": [0, -1], "d": 9, "e": [9], "f": None}, ["track"]))
    left = {"a": [0, 1], "b": [0, 1, 2], "c": [1, 2], "d": range(4), "e": range(4), "f": range(4)}
    assert got == {(t, float(i)) for t, own in left.items() for i in own}
    assert op.mask_peaks(rows(spark, tracks), {}, ["track"]).count() == 24


def test_pivots(spark):
    made = rows(spark, {"a": [(1.0, 0.5), (3.0, 0.5)], "b": [(2.0, 0.5)]})
    assert kept(op.set_pivot(made, ["track"])) == {("a", -2.0), ("a", 0.0), ("b", 0.0)}
    assert kept(op.set_pivot(made, ["track"], "min", {"b": 0.5})) == {("a", 0.0), ("a", 2.0), ("b", 0.5)}
    assert kept(op.set_pivot(made, ["track"], "abs")) == kept(made)


def test_planted_stretches(spark):
    rng = np.random.default_rng(1)
    peaks = np.array([0.0, 0.11, 0.3, 0.42, 0.77, 0.9])
    stretch = {"ref": 1.0, "x": 1.06, "y": 0.93, "lost": 1.0}
    tracks = {t: [(p / s + 0.4, 0.5) for p in peaks] for t, s in stretch.items()}
    tracks["x"] = [*tracks["x"][:2], *tracks["x"][3:]]
    tracks["y"] += [(tracks["y"][0][0] - 0.2, 0.01), (tracks["y"][2][0] + rng.uniform(0.03, 0.05), 0.2)]
    out = op.align_experiments(rows(spark, tracks), "ref", step=1e-3, discarded=["lost"], grid=Grid((1.0, 0.12, 0.03), (0.0, 0.02, 0.005)))
    got = {}
    for r in out.collect():
        got.setdefault(r.track, []).append(r)
    want = peaks - peaks[-1]
    assert got.keys() == {"ref", "x", "y"}
    assert sorted(r.peakposition for r in got["ref"]) == pytest.approx(want.tolist(), abs=1e-6)
    assert sorted(r.peakposition for r in got["x"]) == pytest.approx(np.delete(want, 2).tolist(), abs=1e-4)
    near = [min(abs(r.peakposition - w) for r in got["y"]) for w in want]
    assert max(near) < 1e-4 and len(got["y"]) == 7
    assert all(r.std == pytest.approx(0.003 * stretch["x"], rel=1e-3) for r in got["x"])
