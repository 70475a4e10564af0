"""Queries on densities of peaks and fits to references."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import references as op
from cyclarium.queries.peaks import _BINNED, _peaks
from cyclarium.sources.fixtures import FRAMES_SQL

STEP, EDGE, LEAST = 0.5, 20, 1e-3
GRID = op.Grid((1.0, 0.04, 0.02), (0.0, 4.0, 1.0))


def _own(s, d):
    """Peaks with a spread, which some of them lack."""
    spread = F.when(F.col("peak") % 5 != 0, 0.5 + (F.col("peak") % 4) * 0.5)
    return _peaks(s, d).select("track", "bead", "peakposition", spread.alias("resolution"))


def _reference(s, d):
    """Some of the same peaks, stretched and moved."""
    return _peaks(s, d).where(F.col("peak") % 3 != F.col("bead") % 3).select("bead", (F.col("peakposition") * 1.02 + 1.5).alias("peakposition"), F.lit(1.0).alias("resolution"))


def _density(s, d):
    return op.peak_density(_own(s, d), STEP, edge=EDGE)


def _r(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


def _fit(s, d, rounds=0, **options):
    return _r(op.fit_to_reference(_reference(s, d), _own(s, d), STEP, GRID, rounds=rounds, **options), "cost", "stretch", "bias")


QUERIES = {
    "peak_density": lambda s, d: _r(_density(s, d), "low", "density"),
    "interpolator": lambda s, d: _r(op.interpolator(_density(s, d)), "density"),
    "density_profile": lambda s, d: _r(op.profile(_density(s, d), STEP), "x", "zero", "start", "y", "ahead"),
    "fit_histogram": _fit,
    "fit_histogram_left": lambda s, d: _fit(s, d, symmetry="left", pivot="top"),
    "fit_histogram_corrected": lambda s, d: _fit(s, d, 1, method="corrected", window=3.0, first=0),
    "fit_histogram_chisquare": lambda s, d: _fit(s, d, method="chisquare", window=3.0, first=0),
}


def density_sql(name: str, peaks: str, key: str) -> str:
    """Common tables up to ``name`` (key, bin, low, density) of ``peaks`` (key, p, r)."""
    return f"""{name}_w AS (SELECT *, CAST(round_even(r / {STEP}, 0) AS INTEGER) AS w0 FROM {peaks}),
{name}_b AS (SELECT {key}, min(p) - {EDGE} * {STEP} AS low, floor(((max(p) + {EDGE} * {STEP}) - (min(p) - {EDGE} * {STEP})) / {STEP}) + 1 AS size, CAST(floor(quantile_cont(CASE WHEN w0 > 0 THEN w0 END, 0.75)) AS INTEGER) AS usual FROM {name}_w GROUP BY ALL),
{name}_p AS (SELECT {key}, p, size, round_even((p - low) / {STEP}, 0) AS spot, CASE WHEN w0 > 0 THEN w0 ELSE coalesce(usual, 4) END AS w FROM {name}_w JOIN {name}_b USING ({key})),
{name}_k AS (SELECT {key}, p, spot, w, list_sum(list_transform(range(-2 * w, 2 * w + 1), lambda d: exp(-0.5 * power(d / w, 2)))) AS total, unnest(range(CAST(greatest(spot - 2 * w, 0) AS BIGINT), CAST(least(spot + 2 * w, size - 1) AS BIGINT) + 1)) AS bin FROM {name}_p),
{name}_m AS (SELECT {key}, bin, arg_max(exp(-0.5 * power((bin - spot) / w, 2)) / total, (w, p)) AS density FROM {name}_k GROUP BY ALL),
{name} AS (SELECT {key}, bin, low, coalesce(density, 0) AS density FROM (SELECT {key}, low, unnest(range(CAST(size AS BIGINT))) AS bin FROM {name}_b) LEFT JOIN {name}_m USING ({key}, bin))"""


def profile_sql(name: str, density: str, key: str, pivot: str = "bottom") -> str:
    """Common tables up to ``name`` (key, bin, x, zero, start, kept, y, ahead) of ``density``."""
    zero = {"bottom": "low", "top": f"low + max(bin) OVER (PARTITION BY {key}) * {STEP}"}[pivot]
    return f"""{name}_n AS (SELECT *, density >= {LEAST} OR coalesce(lag(density) OVER w >= {LEAST}, TRUE) OR coalesce(lead(density) OVER w >= {LEAST}, TRUE) AS kept FROM {density} WINDOW w AS (PARTITION BY {key} ORDER BY bin)),
{name}_t AS (SELECT *, lag(density) OVER w < density AND lead(density) OVER w < density AS top FROM {name}_n WHERE kept WINDOW w AS (PARTITION BY {key} ORDER BY bin)), {name}_r AS (SELECT {key}, quantile_cont(density, 0.5) FILTER (WHERE top) AS roof FROM {name}_t GROUP BY ALL),
{name}_c AS (SELECT *, CASE WHEN kept THEN least(density, roof) END AS v, CASE WHEN kept THEN bin END AS b FROM {name}_n LEFT JOIN {name}_r USING ({key})),
{name}_l AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS y0, last_value(b IGNORE NULLS) OVER p AS b0, first_value(v IGNORE NULLS) OVER n AS y1, first_value(b IGNORE NULLS) OVER n AS b1 FROM {name}_c WINDOW p AS (PARTITION BY {key} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY {key} ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name}_z AS (SELECT *, {zero} AS zero, CASE WHEN b0 = b1 THEN y0 ELSE y0 + (y1 - y0) * (bin - b0) / (b1 - b0) END AS y FROM {name}_l),
{name} AS MATERIALIZED (SELECT {key}, bin, low - zero + bin * {STEP} AS x, zero, low - zero AS start, kept, y, lead(y) OVER (PARTITION BY {key} ORDER BY bin) AS ahead FROM {name}_z)"""


def fit_sql(symmetry: str = "both", pivot: str = "bottom") -> str:
    """The best node of the grid for each bead."""
    nodes = ", ".join(f"({s!r}::DOUBLE, {b!r}::DOUBLE)" for s, b in GRID.nodes())
    value = f"CASE WHEN v = floor(v) THEN f.y ELSE coalesce(f.y + (f.ahead - f.y) * (v - floor(v)), 0) END"
    left = f"SELECT q.track, q.bead, s, b, {value} * q.y AS score FROM (SELECT r.track, r.bead, s, b, r.y, ((r.x - b) * s - l.start) / {STEP} AS v FROM r, nodes, (SELECT DISTINCT bead, start FROM l) l WHERE r.kept AND l.bead = r.bead) q JOIN l f ON q.bead = f.bead AND floor(v) = f.bin"
    right = f"SELECT q.track, q.bead, s, b, {value} * q.y AS score FROM (SELECT r.track, r.bead, s, b, l.y, ((l.x / s + b) - r.start) / {STEP} AS v FROM l, nodes, (SELECT DISTINCT track, bead, start FROM r) r WHERE l.kept AND l.bead = r.bead) q JOIN r f ON q.track = f.track AND q.bead = f.bead AND floor(v) = f.bin"
    scores = " UNION ALL ".join(x for x, of in ((left, "left"), (right, "right")) if symmetry in ("both", of))
    return f"""{_OWN}, {density_sql('rd', 'own', 'track, bead')}, {density_sql('ld', 'ref', 'bead')}, {profile_sql('r', 'rd', 'track, bead', pivot)}, {profile_sql('l', 'ld', 'bead', pivot)}, nodes(s, b) AS (VALUES {nodes}),
total AS (SELECT track, bead, s, b, sum(score) AS score FROM ({scores}) GROUP BY ALL), every AS (SELECT k.track, k.bead, n.s, n.b, round(-coalesce(score, 0), 9) + 0 AS cost FROM (SELECT DISTINCT r.track, r.bead FROM r SEMI JOIN l ON r.bead = l.bead) k CROSS JOIN nodes n LEFT JOIN total t ON k.track = t.track AND k.bead = t.bead AND n.s = t.s AND n.b = t.b),
best AS (SELECT track, bead, min((cost, s, b)) AS m FROM every GROUP BY ALL)
SELECT best.track, best.bead, m[1] AS cost, m[2] AS stretch, round(m[3] + (SELECT any_value(zero) FROM r WHERE r.track = best.track AND r.bead = best.bead) - (SELECT any_value(zero) FROM l WHERE l.bead = best.bead) / m[2], 9) AS bias FROM best"""


_OWN = f"""WITH {FRAMES_SQL}, {_BINNED}, own AS (SELECT DISTINCT track, bead, peakposition AS p, CASE WHEN peak % 5 <> 0 THEN 0.5 + (peak % 4) * 0.5 END AS r FROM binned), ref AS (SELECT DISTINCT bead, peakposition * 1.02::DOUBLE + 1.5 AS p, 1.0::DOUBLE AS r FROM binned WHERE peak % 3 <> bead % 3)"""
_DENSITY = f"{_OWN}, {density_sql('rd', 'own', 'track, bead')}"
SQL = {
    "peak_density": f"{_DENSITY} SELECT track, bead, bin, round(low, 9) AS low, round(density, 9) AS density FROM rd",
    "interpolator": f"""{_DENSITY}, cut AS (SELECT track, bead, bin, CASE WHEN density < 1e-3 THEN 0 ELSE density END AS density FROM rd), k AS (SELECT *, coalesce(abs(density - lag(density) OVER w) > 1e-5, FALSE) OR coalesce(abs(density - lead(density) OVER w) > 1e-5, FALSE) AS kept FROM cut WINDOW w AS (PARTITION BY track, bead ORDER BY bin))
SELECT track, bead, bin, round(density, 9) AS density FROM k QUALIFY kept OR count_if(kept) OVER (PARTITION BY track, bead) < 2""",
    "density_profile": f"{_DENSITY}, {profile_sql('r', 'rd', 'track, bead')} SELECT track, bead, bin, round(x, 9) AS x, round(zero, 9) AS zero, round(start, 9) AS start, kept, round(y, 9) AS y, round(ahead, 9) AS ahead FROM r",
    "fit_histogram": fit_sql(),
    "fit_histogram_left": fit_sql("left", "top"),
}
