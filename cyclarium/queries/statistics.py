"""Queries on signal statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import reference_percentile, round9
from cyclarium.operators import statistics as op
from cyclarium.sources.fixtures import FRAMES_SQL, frames

_STEPS = "steps AS (SELECT *, z - last_value(z IGNORE NULLS) OVER (PARTITION BY track, bead, cycle ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dz FROM frames)"
QUALITY = {"noise": (0.1, 30.0), "population": 80, "extents": (10.0, 70.0)}


def _rounded(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


QUERIES = {
    "bead_quality": lambda s, d: _rounded(op.good_beads(frames(s, d), **QUALITY), "hfsigma", "population", "extent"),
    "hf_sigma": lambda s, d: _rounded(op.hf_sigma(frames(s, d)), "hfsigma"),
    "sampled_hf_sigma": lambda s, d: _rounded(op.sampled_hf_sigma(frames(s, d), 3), "hfsigma"),
    "raw_precision_range": lambda s, d: _rounded(op.raw_precision(frames(s, d)), "precision"),
    "raw_precision_normalized": lambda s, d: _rounded(op.raw_precision(frames(s, d), "normalized"), "precision"),
    "bead_extension": lambda s, d: _rounded(op.bead_extension(frames(s, d)), "extension"),
    "phase_position": lambda s, d: _rounded(op.phase_position(frames(s, d), 1), "position"),
    "experimental_length": lambda s, d: _rounded(op.experimental_length(frames(s, d)), "length"),
    "qc_extensions": lambda s, d: _rounded(op.extensions(frames(s, d)), "extension", "centred"),
    "rolling_accumulators": lambda s, d: _rounded(op.rolling(frames(s, d), 2, 2), "mean").drop("cycleframe", "phase", "cycle"),
    "missing_counts": lambda s, d: op.missing_counts(frames(s, d), 3).select("track", "bead", "frame", "nancount", "nanthreshold"),
    "undersample_mean": lambda s, d: _rounded(op.undersample(frames(s, d), op.bin_width(30, 8)), "z"),
    "undersample_first": lambda s, d: op.undersample(frames(s, d), 3, None),
    "measures": lambda s, d: _rounded(op.measures(frames(s, d), ["track", "bead"], mean="mean", spread="std", cycles="median|std", deviation="mediandeviation"), "mean", "spread", "cycles", "deviation"),
    "reference_percentile": lambda s, d: frames(s, d).groupBy("track", "bead", "cycle").agg(F.collect_list("z").alias("v")).select("track", "bead", "cycle", round9(reference_percentile(F.col("v"), 0.5)).alias("nanmedian")),
}

_W = "WITH " + FRAMES_SQL
_SIGMA = "quantile_cont(abs(dz), 0.5)"
SQL = {
    "bead_quality": f"""{_W}, {_STEPS}, per AS (SELECT track, bead, cycle, {_SIGMA} AS hfsigma, count(z) * 100 / count(*) AS population, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS extent FROM steps GROUP BY ALL),
bead AS (SELECT track, bead, quantile_cont(hfsigma, 0.5) AS hfsigma, quantile_cont(population, 0.5) AS population, quantile_cont(extent, 0.5) AS extent, count(*) AS cycles FROM per GROUP BY ALL)
SELECT track, bead, round(hfsigma, 9) AS hfsigma, round(population, 9) AS population, round(extent, 9) AS extent, cycles, CASE WHEN NOT coalesce(hfsigma BETWEEN 0.1 AND 30, FALSE) THEN 'hfsigma' WHEN population < 80 THEN 'population' WHEN NOT coalesce(extent BETWEEN 10 AND 70, FALSE) THEN 'extent' ELSE 'ok' END AS status FROM bead""",
    "hf_sigma": f"{_W}, {_STEPS} SELECT track, bead, cycle, round({_SIGMA}, 9) AS hfsigma FROM steps GROUP BY ALL",
    "sampled_hf_sigma": f"""{_W}, strided AS (SELECT *, z - last_value(z IGNORE NULLS) OVER (PARTITION BY track, bead, cycle, frame % 3 ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dz FROM frames),
per AS (SELECT track, bead, cycle, frame % 3 AS stride, {_SIGMA} AS hfsigma FROM strided GROUP BY ALL) SELECT track, bead, cycle, round(avg(hfsigma), 9) AS hfsigma FROM per GROUP BY ALL""",
    "raw_precision_range": f"""{_W}, strided AS (SELECT *, z - last_value(z IGNORE NULLS) OVER (PARTITION BY track, bead, cycle, frame % 3 ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dz FROM frames WHERE phase BETWEEN 1 AND 5),
per AS (SELECT track, bead, cycle, frame % 3 AS stride, {_SIGMA} AS hfsigma FROM strided GROUP BY ALL), cycles AS (SELECT track, bead, cycle, avg(hfsigma) AS hfsigma FROM per GROUP BY ALL)
SELECT track, bead, round(greatest(5e-4, quantile_cont(hfsigma, 0.5)), 9) AS precision FROM cycles GROUP BY ALL""",
    "raw_precision_normalized": f"""{_W}, own AS (SELECT *, z - last_value(z IGNORE NULLS) OVER (PARTITION BY track, bead, cycle, phase ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dz FROM frames WHERE phase IN (1, 3, 5)),
per AS (SELECT track, bead, cycle, phase, {_SIGMA} AS hfsigma FROM own GROUP BY ALL), phases AS (SELECT track, bead, phase, quantile_cont(hfsigma, 0.5) AS hfsigma FROM per GROUP BY ALL)
SELECT track, bead, round(greatest(5e-4, sum(hfsigma * (1.0::DOUBLE / 3))), 9) AS precision FROM phases GROUP BY ALL""",
    "bead_extension": f"{_W}, per AS (SELECT track, bead, cycle, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS e FROM frames WHERE phase BETWEEN 1 AND 3 GROUP BY ALL) SELECT track, bead, round(quantile_cont(e, 0.5), 9) AS extension FROM per GROUP BY ALL",
    "phase_position": f"{_W}, per AS (SELECT track, bead, cycle, quantile_cont(z, 0.5) AS z FROM frames WHERE phase = 1 GROUP BY ALL) SELECT track, bead, round(quantile_cont(z, 0.5), 9) AS position FROM per GROUP BY ALL",
    "experimental_length": f"{_W}, per AS (SELECT track, bead, cycle, quantile_cont(z, 0.99) - quantile_cont(z, 0.01) AS e FROM frames WHERE phase BETWEEN 1 AND 3 GROUP BY ALL) SELECT track, bead, round(quantile_cont(e, 0.5), 9) AS length FROM per GROUP BY ALL",
    "qc_extensions": f"""{_W}, per AS (SELECT track, bead, cycle, quantile_cont(z, 0.5) FILTER (WHERE phase = 3) - quantile_cont(z, 0.5) FILTER (WHERE phase = 1) AS extension FROM frames WHERE phase IN (1, 3) GROUP BY ALL)
SELECT track, bead, cycle, round(extension, 9) AS extension, round(extension - quantile_cont(extension, 0.5) OVER (PARTITION BY track, bead), 9) AS centred FROM per""",
    "rolling_accumulators": f"""{_W} SELECT track, bead, frame, z, round(avg(z) OVER w, 9) AS mean, min(z) OVER w AS low, max(z) OVER w AS high, arg_min(CASE WHEN z IS NOT NULL THEN frame END, z) OVER w AS low_at, arg_max(CASE WHEN z IS NOT NULL THEN frame END, z) OVER w AS high_at
FROM frames WINDOW w AS (PARTITION BY track, bead ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "missing_counts": f"{_W} SELECT track, bead, frame, 3 - count(z) OVER w AS nancount, 3 - count(z) OVER w >= 1 AS nanthreshold FROM frames WINDOW w AS (PARTITION BY track, bead ORDER BY frame ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)",
    "undersample_mean": f"{_W} SELECT track, bead, frame // 4 AS frame, arg_min(cycle, frames.frame) AS cycle, arg_min(phase, frames.frame) AS phase, round(avg(z), 9) AS z FROM frames GROUP BY track, bead, frames.frame // 4 HAVING count(*) = 4",
    "undersample_first": f"{_W} SELECT track, bead, frame // 3 AS frame, arg_min(cycle, frames.frame) AS cycle, arg_min(phase, frames.frame) AS phase, arg_min_null(z, frames.frame) AS z FROM frames GROUP BY track, bead, frames.frame // 3",
    "measures": f"""{_W}, per AS (SELECT track, bead, cycle, stddev_pop(z) AS s FROM frames GROUP BY ALL), nested AS (SELECT track, bead, quantile_cont(s, 0.5) AS cycles FROM per GROUP BY ALL),
plain AS (SELECT track, bead, avg(z) AS mean, stddev_pop(z) AS spread, (quantile_cont(z, 2.0::DOUBLE / 3) - quantile_cont(z, 1.0::DOUBLE / 3)) / 2 AS deviation FROM frames GROUP BY ALL)
SELECT track, bead, round(mean, 9) AS mean, round(spread, 9) AS spread, round(cycles, 9) AS cycles, round(deviation, 9) AS deviation FROM plain JOIN nested USING (track, bead)""",
    "reference_percentile": f"""{_W}, lists AS (SELECT track, bead, cycle, list_sort(list(z) FILTER (WHERE z IS NOT NULL)) AS v FROM frames GROUP BY ALL)
SELECT track, bead, cycle, round(CASE WHEN len(v) % 2 = 0 THEN v[len(v) // 2 + 1] ELSE (v[len(v) // 2 + 1] + v[least(len(v) // 2 + 2, len(v))]) / 2 END, 9) AS nanmedian FROM lists""",
}
