"""Queries on alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import alignment as op
from cyclarium.sources.fixtures import FRAMES_SQL, frames


def _r(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


QUERIES = {
    "extremum_alignment": lambda s, d: _r(op.extremum_bias(frames(s, d)), "bias"),
    "edge_alignment": lambda s, d: _r(op.centred(op.edge_bias(frames(s, d), 5, "right")), "bias"),
    "translate": lambda s, d: _r(op.translate(frames(s, d), op.edge_bias(frames(s, d), 1).where("cycle % 3 <> 0"), False), "z").select("track", "bead", "frame", "z"),
    "relax_outliers": lambda s, d: _r(op.relax_outliers(frames(s, d), op.edge_bias(frames(s, d), 5), 2.0), "bias"),
    "best_bias_pull": lambda s, d: _r(op.best_bias(frames(s, d), "pull", delta=2.0, pull=1.0), "bias"),
    "best_bias_initial": lambda s, d: _r(op.best_bias(frames(s, d), "initial", opening=10.0), "bias"),
    "measure_end": lambda s, d: _r(op.measure_end(frames(s, d), max_distance=20.0), "z").select("track", "bead", "frame", "z"),
    "mode_bias": lambda s, d: _r(op.mode_bias(frames(s, d), 2.0), "bias"),
}


def _edge(name: str, phase: int, order: str, p: float) -> str:
    return f"{name} AS (SELECT track, bead, cycle, -quantile_cont(z, {p}) AS bias FROM (SELECT *, row_number() OVER (PARTITION BY track, bead, cycle ORDER BY frame {order}) AS i FROM frames WHERE phase = {phase}) WHERE i <= 15 GROUP BY ALL)"


_W = "WITH " + FRAMES_SQL
_BEST = f"""{_edge("ini", 1, "", 0.75)}, {_edge("pul", 3, "DESC", 0.25)}, {_edge("mea", 5, "", 0.75)},
stats AS (SELECT track, bead, cycle, ini.bias AS initial, pul.bias AS pull, mea.bias AS measure FROM (SELECT DISTINCT track, bead, cycle FROM frames) LEFT JOIN ini USING (track, bead, cycle) LEFT JOIN pul USING (track, bead, cycle) LEFT JOIN mea USING (track, bead, cycle)),
own AS (SELECT *, initial - pull AS extent, initial - quantile_cont(initial, 0.5) OVER b AS ci, pull - quantile_cont(pull, 0.5) OVER b AS cp, measure - quantile_cont(measure, 0.5) OVER b AS cm, quantile_cont(initial - pull, 0.25) OVER b AS usual FROM stats WINDOW b AS (PARTITION BY track, bead))"""


def _best(tactic: str) -> str:
    return f"""{_W}, {_BEST}, t AS (SELECT *, {tactic} AS tactic FROM own), v AS (SELECT *, CASE tactic WHEN 'initial' THEN ci WHEN 'pull' THEN cp WHEN 'measure' THEN cm END AS v FROM t)
SELECT track, bead, cycle, round(v, 9) AS bias, tactic, count(v) OVER b * 100 / count(*) OVER b >= 80 AS enough FROM v WINDOW b AS (PARTITION BY track, bead)"""


SQL = {
    "extremum_alignment": f"{_W}, per AS (SELECT track, bead, cycle, cycleframe // 15 AS bin, quantile_cont(z, 0.5) AS z FROM frames GROUP BY ALL) SELECT track, bead, cycle, round(-min(z), 9) AS bias FROM per GROUP BY ALL",
    "edge_alignment": f"{_W}, {_edge('e', 5, 'DESC', 0.75)} SELECT track, bead, cycle, round(bias - quantile_cont(bias, 0.5) OVER (PARTITION BY track, bead), 9) AS bias FROM e",
    "translate": f"{_W}, {_edge('e', 1, '', 0.75)} SELECT track, bead, frame, round(z + coalesce(bias, -quantile_cont(z, 0.5) OVER (PARTITION BY track, bead)), 9) AS z FROM frames LEFT JOIN (SELECT * FROM e WHERE cycle % 3 <> 0) AS e USING (track, bead, cycle)",
    "relax_outliers": f"""{_W}, {_edge('e', 5, '', 0.75)}, per AS (SELECT track, bead, cycle, quantile_cont(z, 0.5) AS m FROM frames WHERE phase = 7 GROUP BY ALL), c AS (SELECT *, quantile_cont(m, 0.5) OVER (PARTITION BY track, bead) AS c FROM per), d AS (SELECT *, quantile_cont(abs(m - c), 0.5) OVER (PARTITION BY track, bead) AS d FROM c)
SELECT track, bead, cycle, round(CASE WHEN NOT coalesce(m < c - d - 2, FALSE) THEN bias END, 9) AS bias FROM e LEFT JOIN d USING (track, bead, cycle)""",
    "best_bias_pull": _best("CASE WHEN coalesce(cp > 1 + abs(usual), FALSE) THEN 'drop' WHEN coalesce(extent < usual - 2, TRUE) THEN 'initial' ELSE 'pull' END"),
    "best_bias_initial": _best("CASE WHEN coalesce(abs(ci) > 10, TRUE) THEN 'pull' ELSE 'initial' END"),
    "measure_end": f"""{_W}, tail AS (SELECT track, bead, cycle, avg(z) AS m FROM (SELECT *, row_number() OVER (PARTITION BY track, bead, cycle, phase ORDER BY frame DESC) AS i FROM frames) WHERE phase = 5 AND i <= 10 GROUP BY ALL), moved AS (SELECT track, bead, cycle, phase, frame, z - m AS z FROM frames JOIN tail USING (track, bead, cycle)),
relax AS (SELECT track, bead, cycle, quantile_cont(z, 0.5) AS r FROM moved WHERE phase = 7 GROUP BY ALL), far AS (SELECT *, abs(r - quantile_cont(r, 0.5) OVER (PARTITION BY track, bead)) AS d FROM relax)
SELECT track, bead, frame, round(z, 9) AS z FROM moved SEMI JOIN (SELECT * FROM far WHERE d <= 20) AS near USING (track, bead, cycle)""",
    "mode_bias": f"""{_W}, tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, bead, cycle, phase ORDER BY frame DESC) AS i FROM frames) WHERE phase = 5 AND i <= 10 AND z IS NOT NULL), p AS (SELECT *, quantile_cont(z, 0.05) OVER (PARTITION BY track, bead) AS p FROM tail),
n AS (SELECT track, bead, p, floor((z - p) / 2) AS bin, count(*) AS n FROM p WHERE abs(floor((z - p) / 2)) <= 5 GROUP BY ALL) SELECT track, bead, round(arg_max(p + (bin + 0.5) * 2, (n, -bin)), 9) AS bias FROM n GROUP BY ALL""",
}
