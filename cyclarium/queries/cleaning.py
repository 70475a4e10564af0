"""Queries on cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import cleaning as op
from cyclarium.operators.statistics import raw_precision
from cyclarium.queries.statistics import _STEPS
from cyclarium.sources.fixtures import FRAMES_SQL, frames

#: Bounds that suit the fixture's scale.
RULES = op.Rules(hfsigma=(0.1, 26.0), population=(85.0, None), extent=(55.0, 64.0), pingpong=(None, 14.0), phasejump=(None, 2), saturation=(None, 12.0), jump=(14.0, 3.0), pingpong_difference=0.01, min_population=3.0)
#: Wider bounds, within which some cycles of most beads pass.
WIDE = op.Rules(hfsigma=(0.1, 36.0), population=(75.0, None), extent=(80.0, 95.0), pingpong=(None, 7.0), phasejump=(None, 5), saturation=(None, 40.0), jump=(14.0, 3.0), saturated_cycles=60.0, min_population=20.0)
BEADS = [1, 2, 3]


def _r(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


def _keys(df, *columns):
    return df.select("track", "bead", "frame", *columns)


QUERIES = {
    "ping_pong": lambda s, d: _r(op.ping_pong(frames(s, d)), "pingpong"),
    "phase_jump": lambda s, d: op.phase_jump(frames(s, d), 14.0, 3.0),
    "saturation": lambda s, d: _r(op.saturation(frames(s, d)), "saturation"),
    "cycle_tests": lambda s, d: _r(op.cycle_tests(frames(s, d), RULES), "testvalue"),
    "extent_outliers": lambda s, d: _r(op.extent_outliers(frames(s, d)), "testvalue"),
    "bead_status": lambda s, d: op.bead_status(op.cycle_tests(frames(s, d), RULES), frames(s, d), RULES),
    "data_cleaning": lambda s, d: op.clean(frames(s, d), WIDE),
    "suppress_derivate": lambda s, d: _keys(op.suppress_derivate(frames(s, d), 30.0, 25.0), "z"),
    "suppress_local": lambda s, d: _keys(op.suppress_local(frames(s, d), 5, 20.0), "z"),
    "suppress_constants": lambda s, d: _keys(op.suppress_constants(frames(s, d).withColumn("z", F.floor(F.col("z") / 20).cast("double")), 2), "z"),
    "suppress_aberrant": lambda s, d: _keys(op.suppress_aberrant(frames(s, d)), "z"),
    "subtract_mean": lambda s, d: _r(_keys(op.subtract(frames(s, d), BEADS, "mean"), "z"), "z"),
    "subtract_median": lambda s, d: _r(_keys(op.subtract(frames(s, d), BEADS, "median"), "z"), "z"),
    "reduce_stddev": lambda s, d: _r(op.reduce_signals(frames(s, d), "stddev"), "signal"),
    "weighted_signal": lambda s, d: _r(op.weighted_signal(frames(s, d).withColumn("z", F.col("z") / 5000)), "signal"),
    "measure_drops": lambda s, d: op.drops(frames(s, d).where("phase = 5"), -10.0),
    "fixed_beads": lambda s, d: _r(op.fixed_beads(frames(s, d), max_extent=63.0, max_noise=25.0, max_spread=80.0), "extent", "hfsigma", "population", "spread"),
    "clipping": lambda s, d: _keys(op.clip_measure(frames(s, d), raw_precision(frames(s, d)), 1.0, 0.5, 50.0), "z"),
}

_W = "WITH " + FRAMES_SQL
_P4 = "abs((z - lag(z, 4) OVER w) / 12 + 2.0::DOUBLE / 3 * (lag(z, 3) OVER w - lag(z, 1) OVER w))"
_PING = f"ping AS (SELECT track, bead, cycle, coalesce(sum(d) FILTER (WHERE d > 0.01), 0) / nullif(quantile_cont(z, 0.95) - quantile_cont(z, 0.05), 0) AS pingpong FROM (SELECT *, {_P4} AS d FROM frames WINDOW w AS (PARTITION BY track, bead, cycle ORDER BY frame)) GROUP BY ALL)"
_JUMP = "jump AS (SELECT track, bead, cycle, count(*) FILTER (WHERE step > 11 AND step < 17) AS phasejump FROM (SELECT *, abs(z - lag(z) OVER (PARTITION BY track, bead, cycle ORDER BY frame)) AS step FROM frames) GROUP BY ALL)"
_SAT = "sat AS (SELECT track, bead, cycle, quantile_cont(z, 0.5) FILTER (WHERE phase = 5 AND back <= 10) - quantile_cont(z, 0.5) FILTER (WHERE phase = 1) AS saturation FROM (SELECT *, row_number() OVER (PARTITION BY track, bead, cycle, phase ORDER BY frame DESC) AS back FROM frames WHERE phase IN (1, 5)) GROUP BY ALL)"


def _tests_sql(rules: op.Rules) -> str:
    """Tests of all cycles as common table expressions, and the status of beads."""
    sides = {side: " ".join(f"WHEN '{t}' THEN testvalue {sign} {getattr(rules, t)[k]}" for t in rules.tests if getattr(rules, t)[k] is not None) for k, (side, sign) in enumerate((("low", "<"), ("high", ">")))}
    return f"""{_STEPS}, {_PING}, {_JUMP}, {_SAT},
per AS (SELECT track, bead, cycle, count(z) * 100 / count(*) AS population, quantile_cont(abs(dz), 0.5) AS hfsigma, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS extent FROM steps GROUP BY ALL),
wide AS (SELECT * FROM per JOIN ping USING (track, bead, cycle) JOIN jump USING (track, bead, cycle) JOIN sat USING (track, bead, cycle)),
long AS (SELECT track, bead, cycle, unnest(['population', 'hfsigma', 'extent', 'pingpong', 'phasejump', 'saturation']) AS testtype, unnest([population, hfsigma, extent, pingpong, CAST(phasejump AS DOUBLE), saturation]) AS testvalue FROM wide),
judged AS (SELECT *, coalesce(CASE testtype {sides["low"]} END, FALSE) AS testtoolow, coalesce(CASE testtype {sides["high"]} END, FALSE) AS high FROM long),
tests AS (SELECT track, bead, cycle, testtype, testvalue, testtoolow, CASE WHEN testtype = 'saturation' THEN avg(CAST(high AS INTEGER)) OVER (PARTITION BY track, bead, testtype) * 100 > {rules.saturated_cycles} ELSE high END AS testtoohigh FROM judged)"""


def _status_sql(rules: op.Rules) -> str:
    return f"""{_tests_sql(rules)}, bad AS (SELECT * FROM tests WHERE testtoolow OR testtoohigh), badcycles AS (SELECT DISTINCT track, bead, cycle FROM bad),
kept AS (SELECT track, bead, count(z) AS rest FROM frames ANTI JOIN badcycles USING (track, bead, cycle) GROUP BY ALL), total AS (SELECT track, bead, count(*) AS total FROM frames GROUP BY ALL),
counts AS (SELECT track, bead, testtype, count(*) AS n, count_if(testtoolow) AS low, count_if(testtoohigh) AS high FROM bad GROUP BY ALL),
worst AS (SELECT track, bead, arg_max(testtype, (n, testtype)) AS errkey, array_to_string(list_sort(list(format('{{}}: {{}} low, {{}} high', testtype, low, high))), '; ') AS message FROM counts GROUP BY ALL),
poor AS (SELECT *, coalesce(rest, 0) * 100 < {rules.min_population} * total AS poor FROM total LEFT JOIN kept USING (track, bead)),
status AS (SELECT track, bead, CASE WHEN poor THEN coalesce(errkey, 'population') ELSE 'ok' END AS errkey, CASE WHEN poor THEN coalesce(message, 'population') ELSE '' END AS message FROM poor LEFT JOIN worst USING (track, bead))"""


_TESTS, _STATUS = _tests_sql(RULES), _status_sql(RULES)
_LAST = "last_value(z IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NEXT = "first_value(z IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_OTHERS = "SELECT track, bead, frame, round(z - coalesce(signal, 0), 9) AS z FROM frames LEFT JOIN signals USING (track, frame) WHERE bead NOT IN (1, 2, 3)"
SQL = {
    "ping_pong": f"{_W}, {_PING} SELECT track, bead, cycle, round(pingpong, 9) AS pingpong FROM ping",
    "phase_jump": f"{_W}, {_STEPS}, {_JUMP} SELECT * FROM jump",
    "saturation": f"{_W}, {_SAT} SELECT track, bead, cycle, round(saturation, 9) AS saturation FROM sat",
    "cycle_tests": f"{_W}, {_TESTS} SELECT track, bead, cycle, testtype, round(testvalue, 9) AS testvalue, testtoolow, testtoohigh FROM tests",
    "extent_outliers": f"""{_W}, per AS (SELECT track, bead, cycle, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS extent FROM frames GROUP BY ALL), v AS (SELECT *, extent / quantile_cont(extent, 0.9) OVER b AS value, count(*) OVER b > 2 AS many FROM per WINDOW b AS (PARTITION BY track, bead))
SELECT track, bead, cycle, round(value, 9) AS testvalue, many AND value < 0.9 AS testtoolow, many AND value > 1.1 AS testtoohigh FROM v""",
    "bead_status": f"{_W}, {_STATUS} SELECT track, bead, errkey, message FROM status",
    "data_cleaning": f"{_W}, {_status_sql(WIDE)} SELECT track, bead, frame, cycle, cycleframe, phase, z FROM frames ANTI JOIN badcycles USING (track, bead, cycle) ANTI JOIN (SELECT track, bead FROM status WHERE errkey <> 'ok') AS failed USING (track, bead)",
    "suppress_derivate": f"""{_W}, n AS (SELECT *, {_LAST} AS a, {_NEXT} AS b, quantile_cont(z, 0.5) OVER (PARTITION BY track, bead) AS m FROM frames WINDOW w AS (PARTITION BY track, bead ORDER BY frame))
SELECT track, bead, frame, CASE WHEN NOT (abs(z - m) > 30 OR coalesce(abs(z - 0.5 * (coalesce(a, b) + coalesce(b, a))) > 25, FALSE)) THEN z END AS z FROM n""",
    "suppress_local": f"""{_W}, n AS (SELECT *, count_if(z IS NULL) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, count_if(z IS NULL) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY track, bead) AS n FROM frames WINDOW w AS (PARTITION BY track, bead ORDER BY frame))
SELECT track, bead, frame, CASE WHEN NOT (i >= 5 AND i < n - 6 AND a >= 2 AND b >= 2) THEN z END AS z FROM n""",
    "suppress_constants": f"""{_W}, v AS (SELECT track, bead, frame, floor(z / 20) AS z FROM frames), e AS (SELECT *, CASE WHEN z IS NULL OR z = last_value(z IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS edge FROM v WINDOW w AS (PARTITION BY track, bead ORDER BY frame)), r AS (SELECT *, sum(edge) OVER (PARTITION BY track, bead ORDER BY frame) AS run FROM e)
SELECT track, bead, frame, CASE WHEN edge = 1 OR count(*) OVER (PARTITION BY track, bead, run) < 2 THEN z END AS z FROM r""",
    "subtract_mean": f"{_W}, signals AS (SELECT track, frame, avg(z) AS signal FROM frames WHERE bead IN (1, 2, 3) GROUP BY ALL) {_OTHERS}",
    "subtract_median": f"""{_W}, chosen AS (SELECT * FROM frames WHERE bead IN (1, 2, 3)), bias AS (SELECT track, bead, cycle, quantile_cont(z, 0.5) AS bias FROM chosen WHERE phase = 5 GROUP BY ALL), centred AS (SELECT track, bead, cycle, bias - quantile_cont(bias, 0.5) OVER (PARTITION BY track, cycle) AS bias FROM bias),
signals AS (SELECT track, frame, quantile_cont(z - bias, 0.5) AS signal FROM chosen JOIN centred USING (track, bead, cycle) GROUP BY ALL) {_OTHERS}""",
    "reduce_stddev": f"{_W} SELECT track, frame, round(stddev_pop(z), 9) AS signal FROM frames GROUP BY ALL",
    "weighted_signal": f"""{_W}, scaled AS (SELECT track, bead, frame, z / 5000 AS z FROM frames), d AS (SELECT *, z - {_LAST} AS dz FROM scaled WINDOW w AS (PARTITION BY track, bead ORDER BY frame)), weight AS (SELECT track, bead, 0.01 - least(greatest(quantile_cont(abs(dz), 0.5), 5e-4), 1e-2) AS w FROM d GROUP BY ALL)
SELECT track, frame, round(sum(z * w) / nullif(sum(w), 0), 9) AS signal FROM scaled JOIN weight USING (track, bead) WHERE z IS NOT NULL GROUP BY ALL""",
    "measure_drops": f"{_W}, d AS (SELECT *, (lead(z, 1) OVER w + lead(z, 2) OVER w) / 2 < z - 10 AS fall FROM frames WHERE phase = 5 WINDOW w AS (PARTITION BY track, bead, cycle ORDER BY frame)) SELECT track, bead, cycle, count_if(fall) AS drops FROM d GROUP BY ALL",
    "fixed_beads": f"""{_W}, {_STEPS}, per AS (SELECT track, bead, cycle, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS extent, quantile_cont(abs(dz), 0.5) AS hfsigma FROM steps GROUP BY ALL), b AS (SELECT track, bead, quantile_cont(extent, 0.5) AS extent, quantile_cont(hfsigma, 0.5) AS hfsigma FROM per GROUP BY ALL),
f AS (SELECT track, bead, count(z) * 100 / count(*) AS population FROM frames GROUP BY ALL), c AS (SELECT *, z - quantile_cont(z, 0.5) OVER (PARTITION BY track, bead, cycle) AS c FROM frames), s AS (SELECT track, bead, cycleframe, quantile_cont(c, 0.95) - quantile_cont(c, 0.05) AS s FROM c GROUP BY ALL), k AS (SELECT track, bead, quantile_cont(s, 0.5) AS spread FROM s GROUP BY ALL)
SELECT track, bead, round(extent, 9) AS extent, round(hfsigma, 9) AS hfsigma, round(population, 9) AS population, round(spread, 9) AS spread, coalesce(extent <= 63 AND hfsigma <= 25 AND population >= 80 AND spread <= 80, FALSE) AS fixed FROM b JOIN f USING (track, bead) JOIN k USING (track, bead)""",
    "clipping": f"""{_W}, strided AS (SELECT *, z - last_value(z IGNORE NULLS) OVER (PARTITION BY track, bead, cycle, frame % 3 ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dz FROM frames WHERE phase BETWEEN 1 AND 5),
per AS (SELECT track, bead, cycle, frame % 3 AS stride, quantile_cont(abs(dz), 0.5) AS h FROM strided GROUP BY ALL), cyc AS (SELECT track, bead, cycle, avg(h) AS h FROM per GROUP BY ALL), prec AS (SELECT track, bead, greatest(5e-4, quantile_cont(h, 0.5)) AS p FROM cyc GROUP BY ALL),
places AS (SELECT track, bead, cycle, quantile_cont(z, 0.5) FILTER (WHERE phase = 1) AS lo, quantile_cont(z, 0.5) FILTER (WHERE phase = 3) AS hi FROM frames GROUP BY ALL), bound AS (SELECT track, bead, quantile_cont(lo, 0.5) AS lo, quantile_cont(hi, 0.5) AS hi FROM places GROUP BY ALL),
cut AS (SELECT frames.*, CASE WHEN phase <> 5 OR frames.z BETWEEN lo - p AND hi + 0.5 * p THEN frames.z END AS y FROM frames JOIN bound USING (track, bead) JOIN prec USING (track, bead)), share AS (SELECT *, avg(CAST(y IS NOT NULL AS INTEGER)) FILTER (WHERE phase = 5) OVER (PARTITION BY track, bead) * 100 AS share FROM cut)
SELECT track, bead, frame, y AS z FROM share WHERE share >= 50""",
}
