"""Queries on experiments laid over one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import experiments as op
from cyclarium.operators import peaks
from cyclarium.operators.references import Grid
from cyclarium.queries.peaks import _BINNED, _binned, _cycles
from cyclarium.sources.fixtures import FRAMES_SQL

#: Masks and moves of some beads.
MASKS = {1: 3, 2: -2, 3: [0, 2], 4: [-1], 5: 99, 6: [99]}
BUMP = {1: 0.5, 7: -2.0}


def _rows(s, d):
    """Peaks of each bead; the rate is that of the peak's own cycles."""
    return peaks.peak_table(_binned(s, d), _cycles(s, d)).select("bead", "peakposition", "hybridisationrate", (F.col("peakposition") + 0.25).alias("avg"), F.lit(1.0).alias("resolution"))


def _r(df):
    return df.select("bead", *[round9(F.col(c)).alias(c) for c in ("peakposition", "hybridisationrate", "avg")])


def _aligned(s, d):
    rows = op.align_experiments(_rows(s, d), 1, "bead", 0.5, pivot="min", zero=False, grid=Grid((1.0, 0.1, 0.05), (0.0, 8.0, 2.0)), window=4.0, rounds=1)
    return _r(rows)


QUERIES = {
    "find_zero": lambda s, d: _r(op.find_zero(_rows(s, d), ["bead"], 0.75, 0.3)),
    "mask_peaks": lambda s, d: _r(op.mask_peaks(_rows(s, d), MASKS, ["bead"])),
    "set_pivot": lambda s, d: _r(op.set_pivot(_rows(s, d), ["bead"], "max", BUMP)),
    "align_experiments": _aligned,
}
_ROWS = f"WITH {FRAMES_SQL}, {_BINNED}, r AS (SELECT bead, first(peakposition) AS peakposition, count(DISTINCT cycle) / first(ncycles) AS hybridisationrate FROM binned JOIN cycles USING (track, bead) GROUP BY bead, peak), rows_ AS (SELECT *, peakposition + 0.25 AS avg FROM r)"
_OUT = "SELECT bead, round(peakposition, 9) AS peakposition, round(hybridisationrate, 9) AS hybridisationrate, round(avg, 9) AS avg"
_MASK = " OR ".join(f"bead = {k} AND i >= {v} + CASE WHEN {v} < 0 THEN n ELSE 0 END AND {v} < n" if isinstance(v, int) else f"bead = {k} AND (" + " OR ".join(f"i = {x} + CASE WHEN {x} < 0 THEN n ELSE 0 END" for x in v) + ")" for k, v in MASKS.items())
SQL = {
    "find_zero": f"""{_ROWS}, z AS (SELECT bead, min(peakposition) FILTER (WHERE hybridisationrate > 0.3) AS zero FROM rows_ GROUP BY bead), t AS (SELECT x.*, zero, (SELECT max(y.hybridisationrate) FROM rows_ y WHERE y.bead = x.bead AND y.peakposition = zero) AS top FROM rows_ x JOIN z USING (bead)),
s AS (SELECT bead, min(peakposition) AS strong FROM t WHERE peakposition < zero AND hybridisationrate >= 0.75 * top GROUP BY bead)
{_OUT} FROM t LEFT JOIN s USING (bead) WHERE NOT coalesce(peakposition < zero AND hybridisationrate < 0.75 * top AND peakposition < coalesce(strong, 1e9), FALSE)""",
    "mask_peaks": f"{_ROWS}, i AS (SELECT *, row_number() OVER (PARTITION BY bead ORDER BY peakposition) - 1 AS i, count(*) OVER (PARTITION BY bead) AS n FROM rows_) {_OUT} FROM i WHERE NOT ({_MASK})",
    "set_pivot": f"{_ROWS}, m AS (SELECT bead, hybridisationrate, peakposition - max(peakposition) OVER w + b AS peakposition, avg - max(peakposition) OVER w + b AS avg FROM (SELECT *, CASE bead {' '.join(f'WHEN {k} THEN {v}' for k, v in BUMP.items())} ELSE 0 END AS b FROM rows_) WINDOW w AS (PARTITION BY bead)) {_OUT} FROM m",
}
