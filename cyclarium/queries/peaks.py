"""Queries on peaks and calling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import events as ev
from cyclarium.operators import calling
from cyclarium.operators import peaks as op
from cyclarium.operators.statistics import hf_sigma
from cyclarium.queries.events import KERNEL, _flat
from cyclarium.queries.events import _FLAT
from cyclarium.sources.fixtures import FRAMES_SQL, frames, read


def _r(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


def _small(df, *columns):
    """The same, but for values that stand for none."""
    return df.withColumns({c: F.when(F.col(c) < 1e30, round9(F.col(c))) for c in columns})


def _selected(s, d, **options):
    return op.select_peaks(_flat(s, d), 1.5, base=8.0, **options)


def _binned(s, d):
    """Events put into peaks by fixed bins, which SQL can do as well."""
    rows = _flat(s, d).withColumn("peak", F.floor(F.col("avg") / 8).cast("int"))
    return rows.withColumn("peakposition", (F.col("peak") + 0.5) * 8.0)


def _cycles(s, d):
    return frames(s, d).groupBy("track", "bead").agg(F.countDistinct("cycle").alias("ncycles"))


def _bounds(s, d):
    return frames(s, d).where("phase = 5").groupBy("track", "bead", "cycle").agg(F.min("frame").alias("phase_start"), (F.max("frame") + 1).alias("stop"))


def _sequences(s, d):
    """Letters of the parts' names as bases."""
    names = read(s, d, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("hpin"), F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz ", "acgtacgtacgtacgtacgtacgtaca").alias("sequence"))


def _fits(s, d):
    rows = read(s, d, "lineitem")
    return rows.groupBy(F.lit("lineitem").alias("track"), F.col("l_suppkey").alias("bead"), F.concat(F.lit("GF"), F.col("l_linenumber") % 4).alias("hpin")).agg(F.round(F.median("l_quantity") + F.count("*") / 100, 6).alias("cost"), F.lit(1.0).alias("stretch"), F.lit(0.0).alias("bias"))


def _initial(s, d):
    return frames(s, d).where("phase = 1").groupBy("track", "bead").agg(F.median("z").alias("position"))


def _baseline(s, d):
    return op.baseline_peaks(_binned(s, d), _cycles(s, d), _bounds(s, d).select("track", "bead", "cycle", "stop"), _initial(s, d), reach=5.0, within=5, share=0.05)


def _strand(s, d):
    return op.single_strand_peaks(_binned(s, d), frames(s, d).where("cycle % 2 = 0").select("track", "bead", "cycle").distinct(), _bounds(s, d).select("track", "bead", "cycle", "phase_start"), within=12, share=0.4)


def _peaks(s, d):
    return _binned(s, d).select("track", "bead", "peak", "peakposition").distinct()


HAIRPINS = {"GF1": [5.0, 20.0, 33.0, 60.0], "GF2": [12.0, 30.0, 55.0]}

#: Lowest and highest positions of hairpins, and hairpins in two pieces, with the options of their fits.
ENDS = {"GF1": ([5.0, 20.0, 33.0], [60.0, 75.0]), "GF2": ([12.0, 30.0], [52.0, 68.0])}
FITTED = {"stretch": 1.0, "spread": 0.2, "slack": 8.0, "window": 5.0}
PIECES = {"GF1": [[5.0, 20.0], [40.0, 55.0]]}
PIECED = {"stretch": 1.0, "spread": 0.2, "bias": (-10.0, 10.0), "window": 5.0, "stretch_step": 0.2, "bias_step": 10.0}


def _hairpins(s):
    return s.createDataFrame([(h, 70, int(p), i % 2 == 0) for h, x in HAIRPINS.items() for i, p in enumerate(x)], "hpin string, strandsize int, position int, orientation boolean")


def _placed(s, d):
    """A fit of each bead to each hairpin."""
    beads = frames(s, d).select("track", "bead").distinct()
    kinds = F.explode(F.array(*[F.struct(F.lit(h).alias("hpin"), F.lit(a).alias("stretch"), F.lit(b).alias("shift")) for h, a, b in PLACES])).alias("k")
    return beads.select("track", "bead", kinds).select("track", "bead", "k.hpin", F.lit(1.0).alias("cost"), "k.stretch", (F.col("bead") % 5 + F.col("k.shift")).alias("bias"))


def _measured(s, d):
    return op.peak_table(_binned(s, d), _cycles(s, d)).drop("events").withColumn("status", F.when(F.col("peak") < 3, "< baseline").otherwise(""))


def _calling(s, d):
    return _measured(s, d), _placed(s, d), _hairpins(s)


#: Stretch and least bias of each hairpin's fits.
PLACES = (("GF1", 1.0, 0.5), ("GF2", 0.75, -2.25))
_NESTED = ("tpaverageduration", "tphybridisationrate", "fpaverageduration", "fphybridisationrate", "expresiduals", "hpinresiduals", "hfsigma")

QUERIES = {
    "identified_peaks": lambda s, d: _r(calling.identified_peaks(*_calling(s, d), window=4.0), "baseposition", "distance", "hybridisationrate", "averageduration"),
    "missing_bindings": lambda s, d: _r(calling.missing_bindings(calling.identified_peaks(*_calling(s, d), window=4.0), _placed(s, d), _hairpins(s)), "peakposition"),
    "fits_table": lambda s, d: _r(calling.fits_table(*_calling(s, d), hf_sigma(frames(s, d), ["track", "bead"]), 4.0, oligos=["ctg"]), *_NESTED),
    "group_consensus": lambda s, d: _r(calling.group_consensus(calling.identified_peaks(*_calling(s, d), window=4.0), 2.0, KERNEL, 2, 6.0), "position", "share", *(f"{c}{n}" for c in ("baseposition", *calling.MEASURED) for n in ("mean", "std"))),
    "density_maxima": lambda s, d: _r(op.density_maxima(_r(ev.smooth(ev.histogram(frames(s, d), 7.0, column="z"), KERNEL), "density"), 2), "vertex", "density"),
    "select_peaks": lambda s, d: _r(_selected(s, d), "avg", "peakposition", "bias"),
    "select_peaks_aligned": lambda s, d: _r(_selected(s, d, align=True), "avg", "peakposition", "bias"),
    "select_peaks_em": lambda s, d: _r(_selected(s, d, method="em"), "avg", "peakposition", "bias"),
    "select_peaks_em_full": lambda s, d: _r(_selected(s, d, method="em_full"), "avg", "peakposition", "bias"),
    "select_peaks_em_random": lambda s, d: _r(_selected(s, d, method="em_random"), "avg", "peakposition", "bias"),
    "select_peaks_wavelets": lambda s, d: _r(_selected(s, d, finder="wavelets"), "avg", "peakposition", "bias"),
    "expected_biases": lambda s, d: _r(op.expected_biases(_flat(s, d), 3.0), "bias"),
    "expected_biases_symmetric": lambda s, d: _r(op.expected_biases(_flat(s, d), 3.0, symmetric=True, rounds=1, average=0.5), "bias"),
    "probabilities": lambda s, d: _small(op.probabilities(_binned(s, d), _cycles(s, d), _bounds(s, d).withColumn("stop", F.col("stop") - 2), least=3), "hybridisationrate", "averageduration", "likelyduration", "probability", "stddev", "saturation", "uncertainty"),
    "resolution": lambda s, d: _r(op.resolution(_binned(s, d)).withColumn("skew", F.when(F.col("resolution") > 1e-9, F.round("skew", 6))), "resolution", "positionprecision"),
    "peak_noise": lambda s, d: op.peak_noise(op.peak_values(_binned(s, d), frames(s, d))).withColumns({"skew": F.round("skew", 6), "peakhfsigma": round9(F.col("peakhfsigma"))}),
    "peak_table": lambda s, d: _r(op.peak_table(_binned(s, d), _cycles(s, d)), "hybridisationrate", "averageduration").withColumn("events", F.to_json("events")),
    "baseline_peaks": _baseline,
    "single_strand_peaks": _strand,
    "peak_status": lambda s, d: op.peak_status(_peaks(s, d), _baseline(s, d), _strand(s, d)),
    "keep_above_baseline": lambda s, d: op.keep_above_baseline(_peaks(s, d), _baseline(s, d), True),
    "oligo_positions": lambda s, d: op.oligo_positions(_sequences(s, d), ["ctg", "gta", "singlestrand"]),
    "silhouettes": lambda s, d: _r(op.silhouettes(_fits(s, d)), "silhouette"),
    "beads_by_hairpin": lambda s, d: _r(op.beads_by_hairpin(_fits(s, d), -0.5), "silhouette"),
    "fit_hairpins": lambda s, d: _r(op.fit_hairpins(_peaks(s, d).withColumn("peakposition", F.col("peakposition") * 8.8e-4), HAIRPINS), "cost", "stretch", "bias"),
    "fit_ends": lambda s, d: _small(_r(op.fit_ends(_peaks(s, d), ENDS, **FITTED), "stretch", "bias", "topbias"), "cost"),
    "fit_pieces": lambda s, d: _small(_r(op.fit_pieces(_peaks(s, d), PIECES, **PIECED), "stretch", "bias"), "cost"),
    "fit_reference": lambda s, d: _r(op.fit_reference(_peaks(s, d), _peaks(s, d).withColumn("peakposition", F.col("peakposition") * 1.02 + 1).select("bead", "peakposition")), "cost", "stretch", "bias"),
    "peak_biases": lambda s, d: _r(op.peak_biases(_binned(s, d)), "bias"),
    "peak_biases_gels": lambda s, d: _r(op.peak_biases(_binned(s, d), "gels"), "bias"),
}
_W = "WITH " + FRAMES_SQL
_BINNED = f"""{_FLAT}, binned AS (SELECT *, CAST(floor(avg / 8) AS INTEGER) AS peak, (floor(avg / 8) + 0.5) * 8 AS peakposition FROM flat), cycles AS (SELECT track, bead, count(DISTINCT cycle) AS ncycles FROM frames GROUP BY ALL)"""
_EDGES = f"""{_BINNED}, bounds AS (SELECT track, bead, cycle, min(frame) AS first, max(frame) + 1 AS stop FROM frames WHERE phase = 5 GROUP BY ALL), initial AS (SELECT track, bead, quantile_cont(z, 0.5) AS position FROM frames WHERE phase = 1 GROUP BY ALL),
low AS (SELECT track, bead, peak, first(peakposition) AS z, first(position) AS p, first(ncycles) AS n, count(*) FILTER (WHERE ends > stop - 5) AS late FROM (SELECT track, bead, peak, cycle, first(peakposition) AS peakposition, arg_max(start + length, start) AS ends FROM binned GROUP BY ALL) JOIN bounds USING (track, bead, cycle) JOIN initial USING (track, bead) JOIN cycles USING (track, bead) GROUP BY track, bead, peak),
baseline AS (SELECT track, bead, min(z) AS baseline FROM low WHERE z <= p + 5 AND late > 0.05 * n GROUP BY ALL),
early AS (SELECT track, bead, peak, first(peakposition) AS z, avg(CAST(start - bounds.first < 12 AS INTEGER)) AS early FROM binned JOIN bounds USING (track, bead, cycle) WHERE cycle % 2 = 0 GROUP BY track, bead, peak),
cut AS (SELECT *, max(CAST(early <= 0.4 AS INTEGER)) OVER (PARTITION BY track, bead ORDER BY z DESC ROWS UNBOUNDED PRECEDING) AS broken FROM early), strand AS (SELECT track, bead, min(z) AS singlestrand FROM cut WHERE broken = 0 GROUP BY ALL),
own AS (SELECT DISTINCT track, bead, peak, peakposition FROM binned)"""
_FITS = "fits AS (SELECT 'lineitem' AS track, l_suppkey AS bead, 'GF' || (l_linenumber % 4) AS hpin, round(quantile_cont(l_quantity, 0.5) + count(*) / 100, 6) AS cost, 1.0::DOUBLE AS stretch, 0.0::DOUBLE AS bias FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS i, lead(cost) OVER w AS other FROM fits WINDOW w AS (PARTITION BY track, bead ORDER BY cost, hpin)), best AS (SELECT track, bead, hpin, cost, stretch, bias, CASE WHEN other IS NULL THEN 1 ELSE coalesce(((other - cost) / nullif(greatest(cost, other), 0) - 0.5) * 2, -1) END AS silhouette FROM r WHERE i = 1)"""
_HP = "hp(hpin, position, plus) AS (VALUES " + ", ".join(f"('{h}', {p}::DOUBLE, {str(i % 2 == 0).upper()})" for h, x in HAIRPINS.items() for i, p in enumerate(x)) + ")"
_CALLED = f"""{_BINNED}, {_HP}, placed AS (SELECT track, bead, hpin, a AS stretch, bead % 5 + b AS bias FROM (SELECT DISTINCT track, bead FROM frames) AS beads, (VALUES {", ".join(f"('{h}', {a}::DOUBLE, {b}::DOUBLE)" for h, a, b in PLACES)}) AS k(hpin, a, b)),
pk AS (SELECT track, bead, peak, first(peakposition) AS peakposition, count(*) AS eventcount, least(1, count(DISTINCT cycle) / first(ncycles)) AS hybridisationrate, avg(length) / 30 AS averageduration, CASE WHEN peak < 3 THEN '< baseline' ELSE '' END AS own FROM binned JOIN cycles USING (track, bead) GROUP BY track, bead, peak),
based AS (SELECT *, (peakposition - bias) * stretch AS baseposition FROM pk JOIN placed USING (track, bead)),
met AS (SELECT based.*, position AS closest, plus, row_number() OVER (PARTITION BY track, bead, hpin, peak ORDER BY abs(position - baseposition), position DESC) AS i FROM based JOIN hp USING (hpin)),
called AS (SELECT * EXCLUDE (i, own, plus), closest - baseposition AS distance, CASE WHEN plus THEN '+' ELSE '-' END AS orientation, CASE WHEN own <> '' THEN own WHEN abs(closest - baseposition) < 4 THEN 'truepos' ELSE 'falsepos' END AS status FROM met WHERE i = 1)"""
SQL = {
    "identified_peaks": f"{_W}, {_CALLED} SELECT * REPLACE (round(baseposition, 9) AS baseposition, round(distance, 9) AS distance, round(hybridisationrate, 9) AS hybridisationrate, round(averageduration, 9) AS averageduration) FROM called",
    "missing_bindings": f"{_W}, {_CALLED} SELECT track, bead, hpin, round(position / stretch + bias, 9) AS peakposition, position AS baseposition, position AS closest, CASE WHEN plus THEN '+' ELSE '-' END AS orientation, 0 AS eventcount, 0.0::DOUBLE AS hybridisationrate, 'falseneg' AS status FROM placed JOIN hp USING (hpin) ANTI JOIN (SELECT track, bead, hpin, closest AS position FROM called WHERE status = 'truepos') AS seen USING (track, bead, hpin, position)",
    "fits_table": f"""{_W}, {_CALLED}, dz AS (SELECT *, z - last_value(z IGNORE NULLS) OVER (PARTITION BY track, bead ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dz FROM frames), noise AS (SELECT track, bead, quantile_cont(abs(dz), 0.5) AS hfsigma FROM dz GROUP BY ALL),
ex AS (SELECT track, bead, hpin, count(*) AS nblockages, count_if(abs(distance) < 4) AS expaffected, count_if(abs(distance) >= 4) AS expnonaffected, count(DISTINCT closest) FILTER (WHERE abs(distance) < 4) AS exptruepos, quantile_cont(distance * distance, 0.5) FILTER (WHERE abs(distance) < 4) AS expresiduals,
{", ".join(f"quantile_cont({c}, 0.5) FILTER (WHERE status = '{t}') AS {k}{c}" for k, t in (("tp", "truepos"), ("fp", "falsepos")) for c in calling.MEASURED)} FROM called GROUP BY ALL),
back AS (SELECT p.track, p.bead, hpin, position, baseposition, row_number() OVER (PARTITION BY p.track, p.bead, hpin, position ORDER BY abs(position - baseposition), baseposition DESC) AS i FROM placed p JOIN hp USING (hpin) LEFT JOIN called USING (track, bead, hpin)),
hs AS (SELECT track, bead, hpin, count_if(abs(position - baseposition) < 4) AS hpinaffected, count_if(NOT coalesce(abs(position - baseposition) < 4, FALSE)) AS hpinnonaffected, count(*) - count(DISTINCT baseposition) FILTER (WHERE abs(position - baseposition) < 4) AS hpinduplicates, count(DISTINCT baseposition) FILTER (WHERE abs(position - baseposition) < 4) AS hpintruepos, quantile_cont(power(position - baseposition, 2), 0.5) FILTER (WHERE abs(position - baseposition) < 4) AS hpinresiduals FROM back WHERE i = 1 GROUP BY ALL),
size AS (SELECT hpin, 70 AS strandsize, count(DISTINCT position) AS nbindings FROM hp GROUP BY hpin)
SELECT track, bead, hpin, 1.0::DOUBLE AS cost, stretch, bias, strandsize, nbindings, round(hfsigma, 9) AS hfsigma, expaffected, expnonaffected, nblockages - exptruepos AS expduplicates, exptruepos, round(expresiduals, 9) AS expresiduals, coalesce(nblockages, 0) AS nblockages, nbindings - coalesce(exptruepos, 0) AS expfalseneg,
round(tpaverageduration, 9) AS tpaverageduration, round(tphybridisationrate, 9) AS tphybridisationrate, tpeventcount, round(fpaverageduration, 9) AS fpaverageduration, round(fphybridisationrate, 9) AS fphybridisationrate, fpeventcount, hpinaffected, hpinnonaffected, hpinduplicates, hpintruepos, round(hpinresiduals, 9) AS hpinresiduals, 'ctg' AS oligo
FROM placed JOIN size USING (hpin) LEFT JOIN noise USING (track, bead) LEFT JOIN ex USING (track, bead, hpin) LEFT JOIN hs USING (track, bead, hpin)""",
    "group_consensus": f"""{_W}, {_CALLED}, lo AS (SELECT track, hpin, min(baseposition) AS low, count(DISTINCT bead) AS n_all FROM called GROUP BY ALL), h AS (SELECT track, hpin, CAST(round_even((baseposition - low) / 2, 0) AS BIGINT) AS bin, count(*) AS n FROM called JOIN lo USING (track, hpin) GROUP BY ALL),
sm AS (SELECT track, hpin, bin + k AS bin, round(sum(n * w), 9) AS density FROM h, (VALUES (-2, 0.1::DOUBLE), (-1, 0.2::DOUBLE), (0, 0.4::DOUBLE), (1, 0.2::DOUBLE), (2, 0.1::DOUBLE)) AS kernel(k, w) GROUP BY track, hpin, bin + k),
mx AS (SELECT *, max(density) OVER (w RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, coalesce(max(density) OVER (w RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS earlier, max(density) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS a, max(density) OVER (w RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS c FROM sm WINDOW w AS (PARTITION BY track, hpin ORDER BY bin)),
sp AS (SELECT track, hpin, coalesce(bin + CASE WHEN a - 2 * density + c < 0 THEN 0.5 * (a - c) / (a - 2 * density + c) ELSE 0 END, bin) * 2 + low AS spot FROM mx JOIN lo USING (track, hpin) WHERE density = top AND density > earlier),
nr AS (SELECT c.track, c.hpin, c.bead, c.peak, arg_min(spot, (abs(baseposition - spot), spot)) AS spot FROM called c JOIN sp ON c.track = sp.track AND c.hpin = sp.hpin WHERE abs(baseposition - spot) < 6 GROUP BY ALL)
SELECT track, hpin, round(spot, 9) AS position, count(DISTINCT bead) AS beads, {", ".join(f"round({f}({c}), 9) AS {c}{n}" for c in ("baseposition", *calling.MEASURED) for f, n in (("avg", "mean"), ("stddev_pop", "std")))}, row_number() OVER (PARTITION BY track, hpin ORDER BY spot) - 1 AS consensus, round(count(DISTINCT bead) * 100 / any_value(n_all), 9) AS share
FROM nr JOIN called USING (track, hpin, bead, peak) JOIN lo USING (track, hpin) GROUP BY track, hpin, spot""",
    "density_maxima": f"""{_W}, b AS (SELECT track, bead, round_even((z - min(z) OVER (PARTITION BY track, bead)) / 7, 0)::BIGINT AS bin FROM frames WHERE z IS NOT NULL), h AS (SELECT track, bead, bin, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT track, bead, bin + k AS bin, round(sum(n * w), 9) AS density FROM h, (VALUES (-2, 0.1::DOUBLE), (-1, 0.2::DOUBLE), (0, 0.4::DOUBLE), (1, 0.2::DOUBLE), (2, 0.1::DOUBLE)) AS kernel(k, w) GROUP BY track, bead, bin + k),
m AS (SELECT *, max(density) OVER (w RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, coalesce(max(density) OVER (w RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS earlier, max(density) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS a, max(density) OVER (w RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS c FROM s WINDOW w AS (PARTITION BY track, bead ORDER BY bin))
SELECT track, bead, bin, density, round(coalesce(bin + CASE WHEN a - 2 * density + c < 0 THEN 0.5 * (a - c) / (a - 2 * density + c) ELSE 0 END, bin), 9) AS vertex FROM m WHERE density = top AND density > earlier""",
    "probabilities": f"""{_W}, {_BINNED}, spans AS (SELECT track, bead, peak, cycle, min(start) AS a, max(start + length) AS b FROM binned GROUP BY ALL), limits AS (SELECT track, bead, cycle, max(frame) - 1 AS stop FROM frames WHERE phase = 5 GROUP BY ALL),
per AS (SELECT track, bead, peak, count(*) AS nevents, count_if(b > stop) AS ntoolong, sum(b - a) AS totalduration FROM spans LEFT JOIN limits USING (track, bead, cycle) GROUP BY ALL),
x AS (SELECT *, 1 - ntoolong / nevents AS rest, 1 - ntoolong / nevents + totalduration / nevents - 3 AS beyond FROM per JOIN cycles USING (track, bead)),
p AS (SELECT *, CASE WHEN nevents > ntoolong AND beyond > 0 THEN rest / beyond ELSE 0 END AS p, CASE WHEN beyond > 0 THEN sqrt(1 - rest / beyond) / beyond ELSE 0 END AS sd FROM x),
t AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN 1 / (-ln(1 - p) * 30) END AS likely FROM p)
SELECT track, bead, peak, nevents, ncycles, ntoolong, totalduration, round(least(1, nevents / ncycles), 9) AS hybridisationrate, round(totalduration / nevents / 30, 9) AS averageduration, round(likely, 9) AS likelyduration, round(p, 9) AS probability, round(sd, 9) AS stddev,
round(least(100, 100 * ntoolong / nevents), 9) AS saturation, CASE WHEN nevents > ntoolong THEN round(likely / sqrt(nevents - ntoolong), 9) END AS uncertainty, 3 < 1 + (totalduration - ntoolong) / nevents AS good FROM t""",
    "resolution": f"""{_W}, {_BINNED}, m AS (SELECT track, bead, peak, cycle, sum(avg * length) / sum(length) AS m FROM binned GROUP BY ALL), c AS (SELECT *, m - avg(m) OVER (PARTITION BY track, bead, peak) AS d FROM m)
SELECT track, bead, peak, round(stddev_pop(m), 9) AS resolution, round(stddev_pop(m) / sqrt(count(*)), 9) AS positionprecision, CASE WHEN stddev_pop(m) > 1e-9 THEN round(avg(d * d * d) / power(avg(d * d), 1.5::DOUBLE), 6) END AS skew FROM c GROUP BY ALL""",
    "peak_noise": f"""{_W}, {_BINNED}, v AS (SELECT b.track, b.bead, b.peak, b.cycle, f.frame, f.z FROM binned b JOIN frames f ON b.track = f.track AND b.bead = f.bead AND b.cycle = f.cycle AND f.frame BETWEEN b.start AND b.start + b.length - 1 WHERE f.z IS NOT NULL),
w AS (SELECT *, z - avg(z) OVER c AS d, abs(z - lag(z) OVER (c ORDER BY frame)) AS step FROM v WINDOW c AS (PARTITION BY track, bead, peak, cycle)),
p AS (SELECT track, bead, peak, cycle, CASE WHEN stddev_pop(z) > 1e-12 THEN avg(d * d * d) / power(avg(d * d), 1.5::DOUBLE) END AS skew, quantile_cont(step, 0.5) AS sigma FROM w GROUP BY ALL)
SELECT track, bead, peak, round(quantile_cont(skew, 0.5), 6) AS skew, round(quantile_cont(sigma, 0.5), 9) AS peakhfsigma FROM p GROUP BY ALL""",
    "peak_table": f"{_W}, {_BINNED} SELECT track, bead, peak, first(peakposition) AS peakposition, count(*) AS eventcount, round(count(DISTINCT cycle) / first(ncycles), 9) AS hybridisationrate, round(avg(length) / 30, 9) AS averageduration, CAST(to_json(list({{'cycle': cycle, 'start': start, 'length': length, 'avg': avg}} ORDER BY cycle, start)) AS VARCHAR) AS events FROM binned JOIN cycles USING (track, bead) GROUP BY track, bead, peak",
    "baseline_peaks": f"{_W}, {_EDGES} SELECT * FROM baseline",
    "single_strand_peaks": f"{_W}, {_EDGES} SELECT * FROM strand",
    "peak_status": f"{_W}, {_EDGES} SELECT track, bead, peak, peakposition, CASE WHEN peakposition < baseline THEN '< baseline' WHEN peakposition = baseline THEN 'baseline' WHEN peakposition = singlestrand THEN 'singlestrand' WHEN peakposition > singlestrand THEN '> singlestrand' ELSE '' END AS status FROM own LEFT JOIN baseline USING (track, bead) LEFT JOIN strand USING (track, bead)",
    "keep_above_baseline": f"{_W}, {_EDGES} SELECT track, bead, peak, peakposition FROM own LEFT JOIN baseline USING (track, bead) WHERE baseline IS NULL OR peakposition >= baseline",
    "oligo_positions": """WITH s AS (SELECT DISTINCT p_name AS hpin, translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtaca') AS t FROM part), i AS (SELECT *, unnest(range(1, length(t) - 1)) AS i FROM s), o(oligo, other) AS (VALUES ('ctg', 'cag'), ('gta', 'tac'))
SELECT DISTINCT hpin, length(t) AS strandsize, oligo, i + 2 AS position, substr(t, i, 3) = oligo AS orientation FROM i, o WHERE substr(t, i, 3) IN (oligo, other) UNION SELECT hpin, length(t), 'singlestrand', length(t), TRUE FROM s""",
    "silhouettes": f"WITH {_FITS} SELECT track, bead, hpin, cost, stretch, bias, round(silhouette, 9) AS silhouette FROM best",
    "beads_by_hairpin": f"WITH {_FITS}, g AS (SELECT track, bead, CASE WHEN silhouette < -0.5 THEN '✗' ELSE hpin END AS hpin, cost, stretch, bias, silhouette FROM best) SELECT track, bead, hpin, cost, stretch, bias, round(silhouette, 9) AS silhouette, row_number() OVER (PARTITION BY track, hpin ORDER BY silhouette DESC, bead) AS rank FROM g",
}
