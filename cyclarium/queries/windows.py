"""Queries on time windows, the batch side of the streaming operators, and whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.plans import tasks as plan
from cyclarium.sources.fixtures import FRAMES_SQL, SIGNALS_SQL, frames, short_signals
from cyclarium.streaming import cycles as op


def _plan(s, d):
    tasks = [plan.InMemoryTrackTask(), plan.DataSelectionTask(discarded=(3, 4), phases=(1, 5)), plan.DataFrameTask(by=("track", "bead", "cycle"), measures={"mean": "mean", "extent": "extent", "n": "count"})]
    return plan.run(tasks, frames(s, d))


QUERIES = {
    "windowed": lambda s, d: op.windowed(short_signals(s, d), "7 days").select("track", "bead", F.col("window.start").alias("start"), "n", round9(F.col("mean")).alias("mean"), "low", "high"),
    "gap_cycles": lambda s, d: op.gap_cycles(short_signals(s, d), "12 hours").select("track", "bead", F.col("session_window.start").alias("start"), "n", round9(F.col("mean")).alias("mean")),
    "task_plan": lambda s, d: _plan(s, d).withColumns({"mean": round9(F.col("mean")), "extent": round9(F.col("extent"))}),
}
SQL = {
    "windowed": f"WITH {SIGNALS_SQL} SELECT track, bead, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS start, count(z) AS n, round(avg(z), 9) AS mean, min(z) AS low, max(z) AS high FROM signals GROUP BY ALL",
    "gap_cycles": f"""WITH {SIGNALS_SQL}, e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS edge FROM signals WINDOW w AS (PARTITION BY track, bead ORDER BY ts)), g AS (SELECT *, sum(edge) OVER (PARTITION BY track, bead ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT track, bead, min(ts) AS start, count(z) AS n, round(avg(z), 9) AS mean FROM g GROUP BY track, bead, g""",
    "task_plan": f"WITH {FRAMES_SQL} SELECT track, bead, cycle, round(avg(z), 9) AS mean, round(quantile_cont(z, 0.95) - quantile_cont(z, 0.05), 9) AS extent, count(z) AS n FROM frames WHERE bead NOT IN (3, 4) AND phase BETWEEN 1 AND 5 GROUP BY ALL",
}
