"""Whole plans of one task each, held against the SQL of the operator that the task runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.plans import tasks as plan
from cyclarium.queries import alignment, cleaning, ramps, selection
from cyclarium.sources.fixtures import FRAMES_SQL, frames


def _after(s, d, *tasks):
    return plan.run([plan.InMemoryTrackTask(), *tasks], frames(s, d))


def _z(df):
    return df.select("track", "bead", "frame", round9(F.col("z")).alias("z"))


def _ramp_plan(s, d, task, power: int):
    rows = ramps._ramps(s, d)
    rows = rows.withColumn("z", F.pow("z", power) / 1e15) if power > 1 else rows
    return plan.run([plan.InMemoryTrackTask(), task], rows)


QUERIES = {
    "plan_measure_end": lambda s, d: _z(_after(s, d, plan.MeasureEndAlignmentTask(length=10, distance=20.0))),
    "plan_bias_removal": lambda s, d: _z(_after(s, d, plan.BiasRemovalTask(length=10, binsize=2.0, delta=10.0))),
    "plan_cycles": lambda s, d: _after(s, d, plan.CycleCreatorTask(first=1, last=5)),
    "plan_sampling": lambda s, d: _after(s, d, plan.CycleSamplingTask(cycles=(2, 3, 7))),
    "plan_subtraction": lambda s, d: _z(_after(s, d, plan.BeadSubtractionTask(beads=(1, 2, 3)))),
    "plan_ramp_events": lambda s, d: _ramp_plan(s, d, plan.RampStatsTask(events=True), 9).withColumns({c: round9(F.col(c)) for c in ("zmag", "dz")}),
    "plan_ramp_consensus": lambda s, d: _ramp_plan(s, d, plan.RampConsensusBeadTask(), 1).withColumn("z", round9(F.col("z"))),
    "plan_projection": lambda s, d: _after(s, d, plan.PeakProjectorTask()),
}
_W = "WITH " + FRAMES_SQL
SQL = {
    "plan_measure_end": alignment.SQL["measure_end"],
    "plan_bias_removal": f"{_W} SELECT frames.track, frames.bead, frame, round(z - coalesce(bias, 0), 9) AS z FROM frames LEFT JOIN ({alignment.SQL['mode_bias'].replace("round(arg_max(p + (bin + 0.5) * 2, (n, -bin)), 9)", "arg_max(p + (bin + 0.5) * 2, (n, -bin))")}) AS b ON frames.bead = b.bead",
    "plan_cycles": f"{_W} SELECT * FROM frames WHERE phase BETWEEN 1 AND 5",
    "plan_sampling": selection.SQL["sample_cycles"],
    "plan_subtraction": cleaning.SQL["subtract_median"],
    "plan_ramp_events": ramps.SQL["ramp_events"],
    "plan_ramp_consensus": ramps.SQL["ramp_consensus"],
}
