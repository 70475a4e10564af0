"""Phases in another clock, by planted clocks."""

import numpy as np
import pytest

from cyclarium import catalog
from cyclarium.functions import clocks
from cyclarium.queries import clocks as queries

DURATIONS = np.array([3, 12, 4, 11, 5, 40, 3, 12])


def planted(rate, lengths, missed=(), lead=17, seed=0):
    """(phases of the first clock, signal of the second) of cycles with the given stretches of phase 5."""
    rng = np.random.default_rng(seed)
    durations = np.tile(DURATIONS, (len(lengths), 1))
    durations[:, 5] += lengths
    starts = np.cumsum(np.concatenate([[0], durations.ravel()]))
    phases = starts[:-1].reshape(-1, 8)
    n = int(lead + starts[-1] * rate) + 5
    z = rng.normal(0, 0.02, n)
    for c, p in enumerate(phases):
        a, b = (int(round(lead + x * rate)) for x in (p[2], p[5]))
        if c not in missed:
            z[a:b] += 10.0
    return phases, z, lead


@pytest.mark.parametrize("rate", [1.0, 2.5])
def test_same_cycles(rate):
    phases, z, lead = planted(rate, np.random.default_rng(1).integers(0, 15, 12))
    got = clocks.synchronized(phases, z)
    assert got.shape == phases.shape
    assert np.abs(got - (lead + phases * rate)).max() <= 2


def test_missed_steps_are_filled():
    phases, z, lead = planted(2.0, np.zeros(14, int), missed=(4, 9))
    got = clocks.synchronized(phases, z)
    assert np.abs(got - (lead + phases * 2)).max() <= 2


def test_cycles_of_one_clock_alone():
    lengths = np.random.default_rng(3).integers(0, 25, 15)
    phases, z, lead = planted(2.0, lengths, lead=0)
    start = int(phases[4, 0] * 2 - 1)
    late = clocks.synchronized(phases, z[start:])
    off = np.abs(late - (phases[4:] * 2 - start))
    assert off[:-1].max() <= 2 and off[-1].max() <= 8  # the last cycle's length is the median one
    early = clocks.synchronized(phases[3:], z)
    off = np.abs(early - phases[3:] * 2)
    assert off[:-1].max() <= 2 and off[-1].max() <= 8


def test_steps_down_where_there_are_more_of_them():
    z = np.zeros(400)
    for k in range(8):
        z[20 + 45 * k : 40 + 45 * k] = np.linspace(0, 10, 20)  # slow rises, sharp falls
    up, down = clocks.rises(z, 8), clocks.rises(-z, 8)
    assert down.tolist() == [40 + 45 * k for k in range(8)]
    assert clocks.marks_of(z, 8).tolist() == (down if up is None or len(up) < len(down) else up).tolist()


def test_no_rhythm():
    phases, z, _ = planted(1.0, np.zeros(5, int))
    assert len(clocks.synchronized(phases, z[:3])) == 0 and len(clocks.synchronized(phases[:1], z)) == 0
    assert len(clocks.synchronized(phases, np.full(400, 1.0))) == 0
    assert clocks.rises(z, 0) is None


def test_query(spark, sf_dir):
    """The cycles that the later clock has, at twice their frames."""
    got = {}
    for r in catalog.queries()["synchronize"](spark, sf_dir).collect():
        got.setdefault(r.track, {})[r.cycle, r.phase] = r.start
    want = {}
    for r in queries._phases(spark, sf_dir).collect():
        want.setdefault(r.track, {})[r.cycle, r.phase] = r.start * 2 - 90
    assert len(got) > 0.8 * len(want)
    for track, starts in got.items():
        first = min(c for c, p in want[track] if p == 2 and want[track][c, p] > 0 and want[track][c, 0] >= 0)
        assert all(abs(x - want[track][c + first, p]) <= 2 for (c, p), x in starts.items())
        assert max(c for c, _ in starts) + first == max(c for c, _ in want[track])
