"""The drift task on planted drifts."""

import numpy as np
import pytest

from cyclarium.plans import tasks as plan

SCHEMA = "track string, bead bigint, frame bigint, cycle int, cycleframe bigint, phase int, z double"


def planted(spark, per_bead=True):
    """Flat levels with a drift along each cycle: a bead's own, or one that a cycle's beads share."""
    rng = np.random.default_rng(3)
    x = np.arange(60)
    rows, drift = [], {}
    for bead in range(6):
        for cycle in range(14):
            key = bead if per_bead else cycle
            drift.setdefault(key, rng.uniform(0.02, 0.05) * np.exp(-x / rng.uniform(10, 25)))
            level = 0.5 if rng.random() < 0.5 else 0.2
            z = np.where(x < 40, level, 0.0) + drift[key] + rng.normal(0, 5e-4, 60)
            rows += [("t", bead, cycle * 60 + int(i), cycle, int(i), 5, float(v)) for i, v in zip(x, z)]
    return spark.createDataFrame(rows, SCHEMA)


def spread(rows):
    """The largest spread of a bead's cycle within its first level, where it is flat but for the drift."""
    return rows.where("cycleframe < 38").groupBy("bead", "cycle").agg({"z": "stddev"}).agg({"stddev(z)": "avg"}).first()[0]


@pytest.mark.parametrize("task", [plan.DriftTask(), plan.DriftTask(collapse="mean"), plan.DriftTask(collapse="derivate"), plan.DriftTask(onbeads=False, least=3)])
def test_drifts_are_removed(spark, task):
    frames = planted(spark, task.onbeads).cache()
    out = plan.run([plan.InMemoryTrackTask(), task], frames)
    assert out.columns == frames.columns and out.count() == frames.count()
    assert spread(out) < 0.4 * spread(frames)


def test_signals_without_frames(spark):
    assert plan.run([plan.InMemoryTrackTask(), plan.DriftTask()], spark.createDataFrame([], SCHEMA)).count() == 0
