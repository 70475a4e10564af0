"""Queries on events, filters, histograms and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import events as op
from cyclarium.operators.statistics import raw_precision
from cyclarium.sources.fixtures import FRAMES_SQL, frames

KERNEL = [0.1, 0.2, 0.4, 0.2, 0.1]


def _r(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


def _flat(s, d):
    return op.flat_events(frames(s, d).where("phase = 5"), 5.0, 3)


def _detected(s, d, **options):
    return op.detect(frames(s, d), raw_precision(frames(s, d)).withColumn("precision", F.col("precision") / 4), least=3, **options)


QUERIES = {
    "derivate_grades": lambda s, d: _r(op.derivate_grades(frames(s, d).where("phase = 5"), F.lit(5.0)), "grade").select("track", "bead", "frame", "grade"),
    "flat_events": lambda s, d: _r(_flat(s, d), "avg", "std"),
    "event_detection": lambda s, d: _r(op.event_table(_detected(s, d)), "avg", "std", "integral"),
    "event_detection_extended": lambda s, d: _r(op.event_table(_detected(s, d, grade="derivate", eroded=True, around="range")), "avg", "std", "integral"),
    "event_frames": lambda s, d: op.event_frames(_flat(s, d)),
    "event_swap": lambda s, d: op.swap(_flat(s, d), frames(s, d).withColumn("z", F.col("z") + 1)),
    "concatenated": lambda s, d: op.concatenated(frames(s, d).where("phase = 5"), _flat(s, d)).select("track", "bead", "frame", "z"),
    "hold": lambda s, d: op.hold(frames(s, d), 20.0, 80.0).select("track", "bead", "frame", "z"),
    "rolling_filter": lambda s, d: _r(op.rolling_filter(frames(s, d), 5), "z").select("track", "bead", "frame", "z"),
    "rolling_median": lambda s, d: _r(op.rolling_filter(frames(s, d), 5, "median"), "z").select("track", "bead", "frame", "z"),
    "slopes": lambda s, d: _r(op.slopes(frames(s, d)), "slope").select("track", "bead", "frame", "slope"),
    "forward_backward": lambda s, d: _r(op.forward_backward(frames(s, d), precision=10.0, power=2.0), "z").select("track", "bead", "frame", "z"),
    "non_linear": lambda s, d: _r(op.non_linear(frames(s, d), precision=10.0, power=2.0), "z").select("track", "bead", "frame", "z"),
    "histogram": lambda s, d: op.histogram(_flat(s, d), 3.0),
    "smoothed_histogram": lambda s, d: _r(op.smooth(op.histogram(frames(s, d), 7.0, column="z"), KERNEL), "density"),
    "cycle_histogram": lambda s, d: op.cycle_histogram(frames(s, d), 10.0),
    "drift_by_derivate": lambda s, d: _r(op.drift_by_derivate(frames(s, d)), "profile"),
    "drift_profile": lambda s, d: _r(op.drift_profile(_detected(s, d), 20, "sock", least=3), "profile"),
    "occupation": lambda s, d: op.occupation(_flat(s, d).withColumn("start", F.col("start") % 40)),
}
_W = "WITH " + FRAMES_SQL
_FLAT = """good AS (SELECT * FROM frames WHERE phase = 5 AND z IS NOT NULL), st AS (SELECT *, abs(avg(z) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) - coalesce(avg(z) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), z)) AS step FROM good WINDOW w AS (PARTITION BY track, bead, cycle ORDER BY frame)),
gr AS (SELECT *, step / (quantile_cont(step, 0.75) OVER (PARTITION BY track, bead, cycle) + 10) AS grade FROM st), isl AS (SELECT *, sum(CAST(grade >= 1 AS INTEGER)) OVER (PARTITION BY track, bead, cycle ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM gr),
parts AS (SELECT track, bead, cycle, k, min(frame) AS start, max(frame) - min(frame) + 1 AS length, avg(z) AS avg, stddev_pop(z) AS std FROM isl GROUP BY ALL HAVING max(frame) - min(frame) + 1 >= 3),
flat AS (SELECT track, bead, cycle, row_number() OVER (PARTITION BY track, bead, cycle ORDER BY start) - 1 AS event, start, length, avg, std FROM parts)"""
SQL = {
    "derivate_grades": f"{_W}, {_FLAT} SELECT track, bead, frame, round(grade, 9) AS grade FROM gr",
    "flat_events": f"{_W}, {_FLAT} SELECT track, bead, cycle, event, start, length, round(avg, 9) AS avg, round(std, 9) AS std FROM flat",
    "event_frames": f"{_W}, {_FLAT} SELECT track, bead, cycle, event, unnest(range(start, start + length)) AS frame FROM flat",
    "event_swap": f"{_W}, {_FLAT}, e AS (SELECT track, bead, cycle, event, unnest(range(start, start + length)) AS frame FROM flat) SELECT track, bead, cycle, event, min(frame) AS start, count(*) AS length, list(z + 1 ORDER BY frame) AS data FROM e LEFT JOIN frames USING (track, bead, cycle, frame) GROUP BY ALL",
    "concatenated": f"{_W}, {_FLAT}, own AS (SELECT * FROM frames WHERE phase = 5) SELECT own.track, own.bead, own.frame, CASE WHEN own.cycle = e.cycle AND own.frame < e.start + e.length THEN z END AS z FROM own ASOF LEFT JOIN flat e ON own.bead = e.bead AND own.frame >= e.start",
    "hold": f"{_W} SELECT track, bead, frame, last_value(CASE WHEN z BETWEEN 20 AND 80 THEN z END IGNORE NULLS) OVER (PARTITION BY track, bead ORDER BY frame ROWS UNBOUNDED PRECEDING) AS z FROM frames",
    "rolling_filter": f"{_W} SELECT track, bead, frame, round(avg(z) OVER (PARTITION BY track, bead ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS z FROM frames",
    "rolling_median": f"{_W} SELECT track, bead, frame, round(quantile_cont(z, 0.5) OVER (PARTITION BY track, bead ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS z FROM frames",
    "slopes": f"{_W}, x AS (SELECT *, CASE WHEN z IS NOT NULL THEN frame END AS x FROM frames) SELECT track, bead, frame, round(covar_pop(x, z) OVER w / nullif(var_pop(x) OVER w, 0), 9) AS slope FROM x WINDOW w AS (PARTITION BY track, bead ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "histogram": f"{_W}, {_FLAT}, b AS (SELECT track, bead, round_even((avg - min(avg) OVER (PARTITION BY track, bead)) / 3, 0)::BIGINT AS bin FROM flat) SELECT track, bead, bin, count(*) AS count FROM b GROUP BY ALL",
    "smoothed_histogram": f"""{_W}, b AS (SELECT track, bead, round_even((z - min(z) OVER (PARTITION BY track, bead)) / 7, 0)::BIGINT AS bin FROM frames WHERE z IS NOT NULL), h AS (SELECT track, bead, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT track, bead, bin + k AS bin, round(sum(n * w), 9) AS density FROM h, (VALUES (-2, 0.1::DOUBLE), (-1, 0.2::DOUBLE), (0, 0.4::DOUBLE), (1, 0.2::DOUBLE), (2, 0.1::DOUBLE)) AS kernel(k, w) GROUP BY track, bead, bin + k""",
    "cycle_histogram": f"{_W}, b AS (SELECT track, bead, cycle, CAST(floor(z / 10) AS BIGINT) AS bin, count(*) AS n FROM frames WHERE z IS NOT NULL GROUP BY ALL) SELECT track, bead, bin, sum(n) AS frames, count_if(n >= 2) AS cycles FROM b GROUP BY ALL",
    "drift_by_derivate": f"""{_W}, s AS (SELECT *, lead(z) OVER (PARTITION BY track, bead, cycle ORDER BY frame) - z AS s FROM frames), e AS (SELECT track, bead, cycleframe, quantile_cont(s, 0.5) AS s, count(s) AS n FROM s GROUP BY ALL)
SELECT track, bead, cycleframe, round(-sum(coalesce(s, 0)) OVER (PARTITION BY track, bead ORDER BY cycleframe ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS profile, n AS count FROM e""",
    "occupation": f"{_W}, {_FLAT}, e AS (SELECT track, bead, unnest(range(start % 40, start % 40 + length)) AS cycleframe FROM flat) SELECT track, bead, cycleframe, count(*) AS count FROM e GROUP BY ALL",
}
