"""Queries on cycles that are moved onto one another or onto a hairpin."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import correlation as op
from cyclarium.queries.events import _FLAT, _flat
from cyclarium.queries.peaks import HAIRPINS, PLACES, _hairpins, _placed
from cyclarium.sources.fixtures import FRAMES_SQL, read

PRECISION = 3.0
#: A round of an alignment of cycles, and one to a hairpin, as the queries have them.
ROUND, ONTO = op.Move(), op.Move(factor=1.0, least=1, most=2, refine=True)


def _events(s, d):
    return _flat(s, d).select("track", "bead", "cycle", "avg")


def _precision(s, d):
    """The same for all beads, also those without events, which need not be found for it."""
    return read(s, d, "lineitem").select(F.lit("lineitem").alias("track"), F.col("l_suppkey").alias("bead")).distinct().withColumn("precision", F.lit(PRECISION))


def _r(df):
    return df.withColumn("bias", round9(F.col("bias")))


def _onto(s, d):
    fits = _placed(s, d).where("hpin = 'GF1'")
    return op.align_to_hairpin(_events(s, d), _precision(s, d), fits, _hairpins(s), (ONTO,))


QUERIES = {
    "cycle_correlation": lambda s, d: _r(op.align_cycles(_events(s, d), _precision(s, d), (ROUND,))),
    "cycle_alignment": lambda s, d: _r(op.align_cycles(_events(s, d), _precision(s, d))),
    "hairpin_cycles": lambda s, d: _r(_onto(s, d)),
}


def round_sql(move: op.Move, positions: str | None = None, osamp: int = op.OVERSAMPLING) -> str:
    """Common tables up to moved(track, bead, cycle, bias) for one round from no bias on, over ev(track, bead, cycle, z)."""
    step, half = PRECISION * move.factor / osamp, move.most * osamp
    edge = (move.most + op.WIDTH) * 2 * osamp
    weights = op.kernel(osamp)
    kernel = ", ".join(f"({i - len(weights) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(weights))
    spots = f"ref AS (SELECT o.track, o.bead, o.bin, sum(o.d) / any_value(b.cycles) AS r FROM own o JOIN bounds b USING (track, bead) GROUP BY ALL)"
    if positions:
        spots = f"spots AS (SELECT p.track, p.bead, CAST(round_even((p.position - low) / {step!r}::DOUBLE, 0) AS BIGINT) AS bin, size FROM {positions} p JOIN bounds USING (track, bead)), ref AS (SELECT track, bead, bin + d AS bin, sum(w) AS r FROM spots, kern WHERE bin >= 0 AND bin < size GROUP BY ALL)"
    place = "t"
    if move.refine:
        place = "t + CASE WHEN a - 2 * s + c < 0 THEN 0.5 * (a - c) / (a - 2 * s + c) ELSE 0 END"
    centred = "bias" if positions else "bias - quantile_cont(bias, 0.5) OVER (PARTITION BY track, bead)"
    return f"""kern(d, w) AS (VALUES {kernel}), enough AS (SELECT * FROM ev WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY track, bead, cycle) >= {move.least}),
ends AS (SELECT track, bead, min(z) - {edge!r}::DOUBLE * {step!r}::DOUBLE AS low, max(z) + {edge!r}::DOUBLE * {step!r}::DOUBLE AS high, count(DISTINCT cycle) AS cycles FROM enough GROUP BY ALL), bounds AS (SELECT *, floor((high - low) / {step!r}::DOUBLE) + 1 AS size FROM ends),
binned AS (SELECT track, bead, cycle, CAST(round_even((z - low) / {step!r}::DOUBLE, 0) AS BIGINT) AS bin, count(*) AS n FROM enough JOIN bounds USING (track, bead) GROUP BY ALL),
own AS (SELECT track, bead, cycle, bin + d AS bin, sum(n * w) AS d FROM binned, kern GROUP BY ALL), {spots},
sums AS (SELECT o.track, o.bead, o.cycle, o.bin - r.bin AS t, sum(o.d * r.r) AS s FROM own o JOIN ref r ON o.track = r.track AND o.bead = r.bead AND o.bin - r.bin BETWEEN -{half} AND {half - 1} JOIN bounds b ON o.track = b.track AND o.bead = b.bead WHERE r.bin >= {half} AND r.bin < b.size - {half} GROUP BY ALL),
scores AS (SELECT track, bead, cycle, t, round(s * (1 - {move.cost / osamp!r}::DOUBLE * CASE WHEN t < 0 THEN -t - 1 ELSE t END), 9) AS s FROM sums),
best AS (SELECT track, bead, cycle, arg_max(t, (s, -t)) AS t, max(s) AS s FROM scores GROUP BY ALL), near AS (SELECT b.*, (SELECT max(x.s) FROM scores x WHERE x.track = b.track AND x.bead = b.bead AND x.cycle = b.cycle AND x.t = b.t - 1) AS a, (SELECT max(x.s) FROM scores x WHERE x.track = b.track AND x.bead = b.bead AND x.cycle = b.cycle AND x.t = b.t + 1) AS c FROM best b),
shifted AS (SELECT e.track, e.bead, e.cycle, coalesce(-({place}) * {step!r}::DOUBLE, 0) AS bias FROM (SELECT DISTINCT track, bead, cycle FROM ev) e LEFT JOIN near USING (track, bead, cycle)), moved AS (SELECT track, bead, cycle, round({centred}, 9) + 0 AS bias FROM shifted)"""


_EV = f"WITH {FRAMES_SQL}, {_FLAT}, ev AS (SELECT track, bead, cycle, avg AS z FROM flat)"
_PLACES = f"""places AS (SELECT DISTINCT track, bead, p / {PLACES[0][1]} + bead % 5 + {PLACES[0][2]} AS position FROM frames, (SELECT unnest({HAIRPINS["GF1"]}::DOUBLE[]) AS p))"""
SQL = {
    "cycle_correlation": f"{_EV}, {round_sql(ROUND)} SELECT * FROM moved",
    "hairpin_cycles": f"{_EV}, {_PLACES}, {round_sql(ONTO, 'places')} SELECT * FROM moved",
}
