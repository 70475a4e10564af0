"""Queries on ramps; the magnet moves up and down within each cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import ramps as op
from cyclarium.operators.cleaning import Rules
from cyclarium.sources.fixtures import FRAMES_SQL, frames


def _r(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


def _ramps(s, d):
    return frames(s, d).withColumn("zmag", -F.abs(F.col("cycleframe") - 20) / 20.0)


#: Bounds under which some cycles, but not all, pass, and the same status as in ramp_status.
ANALYSIS = op.RampAnalysis(Rules(hfsigma=(None, None), population=(70.0, None), extent=(0.0, 88.0), pingpong=(None, None), phasejump=(None, None), saturation=(None, None), min_population=0.0, tests=("population", "extent")), {"population": 70.0, "extension": (62.0, 80.0, 89.0), "hfsigma": (12.0, 40.0), "fixed_share": 60.0})

QUERIES = {
    "ramp_analysis": lambda s, d: _r(ANALYSIS.dataframe(_ramps(s, d)), "population", "correlation", "extent", "maxdeltaz", "hfsigma", "zmagopen", "zmagclose"),
    "ramp_analysis_consensus": lambda s, d: _r(ANALYSIS.consensus(_ramps(s, d)), "z"),
    "ramp_stats": lambda s, d: _r(op.ramp_stats(_ramps(s, d).withColumn("z", F.pow("z", 3) / 1000)), "population", "correlation", "extent", "maxdeltaz", "hfsigma", "zmagopen", "zmagclose"),
    "ramp_events": lambda s, d: _r(op.ramp_events(_ramps(s, d).withColumn("z", F.pow("z", 9) / 1e15)), "zmag", "dz"),
    "ramp_status": lambda s, d: op.ramp_status(op.ramp_stats(_ramps(s, d)), population=70.0, extension=(62.0, 80.0, 89.0), hfsigma=(12.0, 40.0), fixed_share=60.0, beads=frames(s, d)),
    "ramp_consensus": lambda s, d: _r(op.ramp_consensus(_ramps(s, d)), "z"),
    "track_consensus": lambda s, d: _r(op.track_consensus(op.ramp_consensus(_ramps(s, d))), "z"),
}


def _steps(z: str) -> str:
    return f"""{FRAMES_SQL}, ramps AS (SELECT track, bead, cycle, frame, cycleframe, {z} AS z, -abs(cycleframe - 20) / 20 AS zmag FROM frames), d AS (SELECT *, lead(z) OVER (PARTITION BY track, bead, cycle ORDER BY frame) - z AS dz FROM ramps),
q AS (SELECT *, quantile_cont(dz, 0.25) OVER c AS q1, quantile_cont(dz, 0.75) OVER c AS q3 FROM d WINDOW c AS (PARTITION BY track, bead, cycle)), s AS (SELECT *, coalesce(dz > q3 + 5 * (q3 - q1), FALSE) AS opens, coalesce(dz < q1 - 5 * (q3 - q1), FALSE) AS closes FROM q)"""


_STATS = """stats AS (SELECT track, bead, cycle, count(z) * 100 / count(*) AS population, corr(z, zmag) AS correlation, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS extent, max(dz) AS maxdeltaz, quantile_cont(abs(dz), 0.5) AS hfsigma,
max(CASE WHEN opens THEN frame END) AS iopen, arg_max(zmag, frame) FILTER (WHERE opens) AS zmagopen, min(CASE WHEN closes THEN frame END) AS iclose, arg_min(zmag, frame) FILTER (WHERE closes) AS zmagclose FROM s GROUP BY ALL)"""
_FOLD = """peak AS (SELECT *, cycleframe - first_value(cycleframe) OVER (PARTITION BY track, bead, cycle ORDER BY zmag DESC) AS d FROM ramps), fold AS (SELECT track, bead, abs(d) AS "offset", CASE WHEN d <= 0 THEN 'up' ELSE 'down' END AS way, avg(z) AS z FROM peak GROUP BY ALL),
con AS (SELECT track, bead, "offset", way, (z - min(z) OVER b) * 100 / nullif(max(z) OVER b - min(z) OVER b, 0) AS z FROM fold WINDOW b AS (PARTITION BY track, bead))"""
SQL = {
    "ramp_stats": f"WITH {_steps('power(z, 3) / 1000')}, {_STATS} SELECT track, bead, cycle, round(population, 9) AS population, round(correlation, 9) AS correlation, round(extent, 9) AS extent, round(maxdeltaz, 9) AS maxdeltaz, round(hfsigma, 9) AS hfsigma, iopen, round(zmagopen, 9) AS zmagopen, iclose, round(zmagclose, 9) AS zmagclose FROM stats",
    "ramp_events": f"WITH {_steps('power(z, 9) / 1e15')}, o AS (SELECT *, lag(frame) OVER (PARTITION BY track, bead, cycle ORDER BY frame) AS before FROM s WHERE (opens OR closes) AND zmag > -0.8) SELECT track, bead, cycle, frame, round(zmag, 9) AS zmag, round(dz, 9) AS dz, CASE WHEN opens THEN 'open' ELSE 'close' END AS kind FROM o WHERE coalesce(frame - before > 1, TRUE)",
    "ramp_status": f"""WITH {_steps('z')}, {_STATS}, c AS (SELECT *, maxdeltaz < 62 OR (maxdeltaz < 80 AND zmagopen IS NULL AND zmagclose IS NULL) AS fixed, hfsigma > 12 AND hfsigma < 40 AND population > 70 AS good FROM stats WHERE extent IS NOT NULL AND maxdeltaz IS NOT NULL AND hfsigma IS NOT NULL),
b AS (SELECT track, bead, quantile_cont(extent, 0.5) AS extent, avg(CAST(good AS INTEGER)) AS good, count_if(fixed) AS fixed, count(*) AS n FROM c GROUP BY ALL)
SELECT track, bead, CASE WHEN good > 0.7 AND fixed >= least(good * n * 0.6, n - 1) THEN 'fixed' WHEN good > 0.7 AND extent > 62 AND extent < 89 THEN 'ok' ELSE 'bad' END AS status FROM (SELECT DISTINCT track, bead FROM frames) AS every LEFT JOIN b USING (track, bead)""",
    "ramp_consensus": f"WITH {_steps('z')}, {_FOLD} SELECT track, bead, \"offset\", way, round(z, 9) AS z FROM con",
    "track_consensus": f"WITH {_steps('z')}, {_FOLD} SELECT track, \"offset\", way, round(quantile_cont(z, 0.5), 9) AS z, count(z) AS beads FROM con GROUP BY ALL",
}
_CLEAN = """fine AS (SELECT track, bead, cycle FROM frames GROUP BY ALL HAVING count(z) * 100 / count(*) >= 70 AND quantile_cont(z, 0.95) - quantile_cont(z, 0.05) BETWEEN 0 AND 88)"""
_OWN = f"""WITH {_steps('z').replace("FROM frames), d AS", "FROM frames SEMI JOIN fine USING (track, bead, cycle)), d AS").replace("ramps AS (", _CLEAN + ", ramps AS (")}, {_STATS},
c AS (SELECT *, maxdeltaz < 62 OR (maxdeltaz < 80 AND zmagopen IS NULL AND zmagclose IS NULL) AS fixed, hfsigma > 12 AND hfsigma < 40 AND population > 70 AS good FROM stats WHERE extent IS NOT NULL AND maxdeltaz IS NOT NULL AND hfsigma IS NOT NULL),
b AS (SELECT track, bead, quantile_cont(extent, 0.5) AS extent, avg(CAST(good AS INTEGER)) AS good, count_if(fixed) AS fixed, count(*) AS n FROM c GROUP BY ALL),
judged AS (SELECT track, bead, CASE WHEN good > 0.7 AND fixed >= least(good * n * 0.6, n - 1) THEN 'fixed' WHEN good > 0.7 AND extent > 62 AND extent < 89 THEN 'ok' ELSE 'bad' END AS status FROM (SELECT DISTINCT track, bead FROM frames) AS every LEFT JOIN b USING (track, bead))"""
SQL["ramp_analysis"] = f"{_OWN} SELECT track, bead, status, cycle, round(population, 9) AS population, round(correlation, 9) AS correlation, round(stats.extent, 9) AS extent, round(maxdeltaz, 9) AS maxdeltaz, round(hfsigma, 9) AS hfsigma, iopen, round(zmagopen, 9) AS zmagopen, iclose, round(zmagclose, 9) AS zmagclose FROM judged LEFT JOIN stats USING (track, bead)"
SQL["ramp_analysis_consensus"] = f"""{_OWN}, {_FOLD.replace("FROM ramps)", "FROM ramps SEMI JOIN (SELECT track, bead FROM judged WHERE status = 'ok') USING (track, bead))")} SELECT track, "offset", way, round(quantile_cont(z, 0.5), 9) AS z, count(z) AS beads FROM con GROUP BY ALL"""
