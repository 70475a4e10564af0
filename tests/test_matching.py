"""Matching of two lists against a merging loop, and series seen from frames that lack their values."""

import random

import numpy as np
import pytest

from cyclarium.functions import peaks
from cyclarium.operators import comparison, selection


def merged(one, two, window):
    """Pairs of indices by walking along both lists and halving the chains at their closest neighbours."""
    i = j = last = 0
    chains, out = [], []
    while i < len(one) or j < len(two):
        side = 0 if j == len(two) else 1 if i == len(one) else last if one[i] == two[j] else int(one[i] > two[j])
        node = (side, i, one[i]) if side == 0 else (side, j, two[j])
        i, j, last = i + (side == 0), j + (side == 1), side
        if chains and chains[-1][-1][0] != side and not chains[-1][-1][2] < node[2] - window:
            chains[-1].append(node)
        else:
            chains.append([node])

    def resolve(chain):
        if len(chain) > 1:
            k = min(range(1, len(chain)), key=lambda k: chain[k][2] - chain[k - 1][2])
            out.append(tuple(x[1] for x in sorted(chain[k - 1 : k + 1])))
            resolve(chain[: k - 1])
            resolve(chain[k + 1 :])

    for chain in chains:
        resolve(chain)
    return sorted(out)


def lists(rng, most=20):
    return [np.array(sorted(rng.randrange(most) for _ in range(rng.randrange(9))), float) for _ in range(2)]


def test_kernel_by_walking():
    rng = random.Random(1)
    for _ in range(5000):
        one, two = lists(rng)
        window = rng.choice([1, 2, 3, 5])
        assert peaks.match(one, two, window) == merged(one, two, window)


@pytest.mark.parametrize("first", ["target", "position"])
def test_windows_by_walking(spark, first):
    """Also for positions that repeat or that both lists have; empty lists match nothing."""
    rng = random.Random(2)
    own = {k: lists(rng) for k in range(150)}
    points = spark.createDataFrame([(k, float(x)) for k, (_, p) in own.items() for x in p] + [(500, 1.0), (501, None)], "k int, position double")
    targets = spark.createDataFrame([(k, float(x)) for k, (t, _) in own.items() for x in t] + [(502, 1.0)], "k int, target double")
    got = sorted((r.k, r.target, r.position) for r in selection.matched(points, targets, ["k"], 2.0, first).collect())
    want = []
    for k, (t, p) in own.items():
        pairs = merged(t, p, 2.0) if first == "target" else [(i, j) for j, i in merged(p, t, 2.0)]
        want += [(k, t[i], p[j]) for i, j in pairs]
    assert got == sorted(want)


def test_matching_differs_from_mutual_neighbours(spark):
    """Of a chain of four the closest two are taken and then the outer two stay alone; of five, both ends can match."""
    points = spark.createDataFrame([(1, x) for x in (0.0, 2.0, 4.5)], "k int, position double")
    targets = spark.createDataFrame([(1, x) for x in (1.2, 3.1)], "k int, target double")
    pairs = lambda f: {(r.position, r.target) for r in f(points, targets, ["k"], 2.0).collect()}
    assert pairs(selection.matched) == {(2.0, 1.2), (4.5, 3.1)}
    assert pairs(selection.mutual) == {(2.0, 1.2)}


def test_match_distance_by_walking(spark):
    rng = random.Random(3)
    own = {k: lists(rng) for k in range(40)}
    points = spark.createDataFrame([(k, float(x)) for k, (p, _) in own.items() for x in sorted(set(p))], "k int, position double")
    targets = spark.createDataFrame([(k, float(x)) for k, (_, t) in own.items() for x in sorted(set(t))], "k int, target double")
    got = {r.k: r for r in comparison.match_distance(points, targets, ["k"], 2.0, 1.1, 0.2).collect()}
    for k, (p, t) in own.items():
        p, t = sorted(set(p)), sorted(set(t))
        placed = [x * 1.1 + 0.2 for x in t]
        pairs = merged(p, placed, 2.0)
        if p or t:
            square = sum((p[i] - placed[j]) ** 2 for i, j in pairs) / 4
            assert got[k].nfound == len(pairs)
            assert got[k].distance == pytest.approx(len(p) + len(t) - 2 * len(pairs) + square if pairs else len(p) + len(t) + 1)
            assert got[k].bias_slope == pytest.approx(-2 * sum(p[i] - placed[j] for i, j in pairs) / 4)
            assert got[k].stretch_slope == pytest.approx(-2 * sum(t[j] * (p[i] - placed[j]) for i, j in pairs) / 4)


def test_series_between_frames(spark):
    """Values before, between and after a bead's frames count, also at frames that it lacks."""
    frames = spark.createDataFrame([("t", b, f, 0.5) for b, fs in ((1, range(10, 13)), (2, [0, 5, 19, 20, 300])) for f in fs] + [("u", 1, 7, 0.1)], "track string, bead int, frame int, z double")
    series = spark.createDataFrame([("t", "x", 5, 1.0), ("t", "x", 20, 2.0), ("t", "y", 11, 9.0), ("t", "x", 150, -1.0), ("t", "x", 12, None), ("t", "x", 150, -3.0)], "track string, name string, frame int, value double")
    got = {(r.track, r.bead, r.frame): (r.latest, r.interpolated) for r in selection.as_of(frames, series, "x", width=4).collect()}
    want = {("t", 1, f): (1.0, 1 + (f - 5) / 15) for f in (10, 11, 12)}
    want |= {("t", 2, 0): (None, 1.0), ("t", 2, 5): (1.0, 1.0), ("t", 2, 19): (1.0, 1 + 14 / 15), ("t", 2, 20): (2.0, 2.0), ("t", 2, 300): (-1.0, -1.0), ("u", 1, 7): (None, None)}
    assert got.keys() == want.keys()
    for k, (latest, interpolated) in want.items():
        assert got[k][0] == latest and got[k][1] == (None if interpolated is None else pytest.approx(interpolated))
    assert selection.as_of(frames, series.where("false"), "x").where("latest is null and interpolated is null").count() == 9
