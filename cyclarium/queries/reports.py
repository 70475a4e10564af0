"""Queries on reports and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import cleaning, statistics
from cyclarium.operators import reports as op
from cyclarium.queries.cleaning import _TESTS, RULES
from cyclarium.queries.peaks import _BINNED, _binned, _cycles
from cyclarium.queries.selection import _NEAR, _points, _targets
from cyclarium.queries.statistics import _STEPS, QUALITY
from cyclarium.operators.peaks import peak_table
from cyclarium.sources.fixtures import FRAMES_SQL, frames, read


def _r(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


def _status(s, d):
    """Statuses of beads over experiments: orders' priorities over their dates."""
    rows = read(s, d, "orders").select((F.col("o_custkey") % 40).alias("bead"), F.substring("o_orderpriority", 1, 1).alias("status"), F.date_trunc("quarter", "o_orderdate").alias("modification"), F.col("o_orderkey"))
    per = rows.groupBy("bead", "modification").agg(F.max_by("status", "o_orderkey").alias("status"))
    return per.withColumn("track", F.date_format("modification", "yyyy-MM"))


def _experiments(s, d):
    rows = read(s, d, "orders")
    oligo = F.translate(F.lower(F.substring("o_orderpriority", 3, 4)), "abcdefghijklmnopqrstuvwxyz .", "acgtacgtacgtacgtacgtacgtacac")
    return rows.select((F.col("o_custkey") % 20).alias("bead"), F.date_format("o_orderdate", "yyyy-MM").alias("track"), oligo.alias("oligo"), F.date_trunc("month", "o_orderdate").alias("modification"), (F.floor(F.col("o_totalprice") / 10) / 100).alias("position"), (F.col("o_orderkey") % 17).alias("count"), (F.col("o_orderstatus") != "P").alias("keep"))


def _called(s, d):
    """Events of peaks, and the positions of both strands."""
    peaks = read(s, d, "orders").select((F.col("o_custkey") % 50).alias("track"), (F.floor(F.col("o_totalprice") / 5000) * 50).cast("double").alias("peakposition"), (F.floor(F.col("o_totalprice") / 10) / 10).alias("avg"))
    theory = read(s, d, "part").select((F.col("p_partkey") % 50).alias("track"), F.when(F.col("p_size") > 25, "positive").otherwise("negative").alias("strand"), (F.floor(F.col("p_retailprice") * 10) / 10).alias("theopos")).distinct()
    return peaks, theory


def _identified(s, d):
    rows = read(s, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "truepos").when(F.col("l_returnflag") == "N", "falseneg").otherwise("falsepos")
    return rows.select(F.col("l_suppkey").alias("bead"), F.col("l_linestatus").alias("strand"), status.alias("status"), F.col("l_quantity").alias("size"))


QUERIES = {
    "track_table": lambda s, d: op.track_table(frames(s, d), statistics.good_beads(frames(s, d), **QUALITY)).drop("good", "fixed", "bad"),
    "stats_count": lambda s, d: _r(op.shares(_identified(s, d), "strand", "status"), "percent"),
    "stats_box": lambda s, d: _r(op.box(frames(s, d), "bead", "z"), "q25", "median", "q75"),
    "binned_z": lambda s, d: _r(op.binned(frames(s, d).where("phase = 3"), ["track", "bead"], "z", 2.5), "binned").select("track", "bead", "frame", "binned"),
    "ordered_categories": lambda s, d: _r(op.ordered_categories(frames(s, d), "bead", "z"), "median"),
    "less_reference": lambda s, d: _r(op.less_reference(frames(s, d).withColumn("track", F.concat(F.lit("t"), F.col("bead") % 3)), ["frame"], "t0", "z"), "z").select("track", "bead", "frame", "z"),
    "identification_rates": lambda s, d: _r(op.identification_rates(_identified(s, d), ["bead", "strand"], "size"), "found_percent", "falsepos_per_base"),
    "quality_table": lambda s, d: _r(op.quality_table(cleaning.cycle_tests(frames(s, d), RULES)), "population", "hfsigma", "extent", "pingpong", "phasejump", "saturation"),
    "missing_beads": lambda s, d: op.missing_beads(cleaning.cycle_tests(frames(s, d), RULES), 40.0, 60.0),
    "status_pivot": lambda s, d: op.status_pivot(_status(s, d), ["1", "2", "3", "4", "5"]).select("track", *[F.col(x).alias(f"s{x}") for x in "12345"]),
    "status_flow": lambda s, d: op.status_flow(_status(s, d)),
    "status_evolution": lambda s, d: _r(op.status_evolution(_status(s, d)), "percent").select("track", "status", "beads", "percent", "label"),
    "carry_over": lambda s, d: op.carry_over(_experiments(s, d), 20.0).withColumns({c: F.date_format(c, "yyyy-MM") for c in ("modification", "next_modification")}),
    "confusion": lambda s, d: op.confusion(*_called(s, d), within=2.0, tolerance=(0.6, 0.4), brother=3.0),
    "detections": lambda s, d: _r(op.detections(*_called(s, d), within=2.0, tolerance=(0.6, 0.4), brother=3.0), "dist"),
    "summary_sheet": lambda s, d: _r(op.summary_sheet(peak_table(_binned(s, d), _cycles(s, d)), statistics.hf_sigma(frames(s, d), ["track", "bead"]), _cycles(s, d)), "hfsigma", "downtime", "events_per_cycle"),
}
_W = "WITH " + FRAMES_SQL
_ST = "st AS (SELECT o_custkey % 40 AS bead, date_trunc('quarter', o_orderdate) AS modification, arg_max(substr(o_orderpriority, 1, 1), o_orderkey) AS status FROM orders GROUP BY ALL), status AS (SELECT *, strftime(modification, '%Y-%m') AS track FROM st)"
_ID = "ident AS (SELECT l_suppkey AS bead, l_linestatus AS strand, CASE l_returnflag WHEN 'A' THEN 'truepos' WHEN 'N' THEN 'falseneg' ELSE 'falsepos' END AS status, l_quantity AS size FROM lineitem)"
_CALLED = """called AS (SELECT o_custkey % 50 AS track, CAST(floor(o_totalprice / 5000) * 50 AS DOUBLE) AS peakposition, floor(o_totalprice / 10) / 10 AS avg FROM orders), theory AS (SELECT DISTINCT p_partkey % 50 AS track, CASE WHEN p_size > 25 THEN 'positive' ELSE 'negative' END AS strand, floor(p_retailprice * 10) / 10 AS theopos FROM part),
met AS (SELECT g.track, strand, theopos, peakposition, n, row_number() OVER (PARTITION BY g.track, peakposition, strand ORDER BY abs(theopos - peakposition), theopos DESC) AS i FROM (SELECT track, peakposition, count(*) AS n FROM called GROUP BY ALL) g JOIN theory ON g.track = theory.track),
near AS (SELECT * FROM met WHERE i = 1), hits AS (SELECT near.track, strand, near.peakposition, count_if(abs(avg - theopos) <= 2) AS k FROM near JOIN called ON near.track = called.track AND near.peakposition = called.peakposition GROUP BY ALL),
judged AS (SELECT track, strand, theopos, peakposition, n AS estimators, EXISTS (SELECT 1 FROM theory o WHERE o.track = near.track AND o.strand <> near.strand AND abs(o.theopos - near.theopos) < 3) AS doublebinding, k / n >= CASE WHEN strand = 'positive' THEN 0.4 ELSE 0.6 END AS detection FROM near JOIN hits USING (track, strand, peakposition))"""
_FAIL = "avg(CAST(testtoolow OR testtoohigh AS INTEGER)) * 100"
SQL = {
    "track_table": f"""{_W}, {_STEPS}, per AS (SELECT track, bead, cycle, quantile_cont(abs(dz), 0.5) AS h, count(z) * 100 / count(*) AS p, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS e FROM steps GROUP BY ALL), b AS (SELECT track, bead, quantile_cont(h, 0.5) AS h, quantile_cont(p, 0.5) AS p, quantile_cont(e, 0.5) AS e FROM per GROUP BY ALL),
s AS (SELECT track, count_if(coalesce(h BETWEEN 0.1 AND 30 AND p >= 80 AND e BETWEEN 10 AND 70, FALSE)) AS ok, count(*) AS n FROM b GROUP BY ALL) SELECT f.track, count(DISTINCT bead) AS beads, max(frame) + 1 AS nframes, first(ok) AS ngood, 0 AS nfixed, first(n - ok) AS nbad FROM frames f JOIN s ON s.track = f.track GROUP BY f.track""",
    "stats_count": f"WITH {_ID}, n AS (SELECT strand, status, count(*) AS count FROM ident GROUP BY ALL) SELECT strand, status, count, round(count * 100 / sum(count) OVER (PARTITION BY strand), 9) AS percent FROM n",
    "stats_box": f"""{_W}, q AS (SELECT bead, z, quantile_cont(z, 0.25) OVER b AS q25, quantile_cont(z, 0.5) OVER b AS m, quantile_cont(z, 0.75) OVER b AS q75 FROM frames WHERE z IS NOT NULL WINDOW b AS (PARTITION BY bead)), i AS (SELECT *, z BETWEEN q25 - 1.5::DOUBLE * (q75 - q25) AND q75 + 1.5::DOUBLE * (q75 - q25) AS inside FROM q)
SELECT bead, round(first(q25), 9) AS q25, round(first(m), 9) AS median, round(first(q75), 9) AS q75, min(z) FILTER (WHERE inside) AS low, max(z) FILTER (WHERE inside) AS high, count_if(NOT inside) AS outliers, count(*) AS count FROM i GROUP BY bead""",
    "binned_z": f"{_W}, m AS (SELECT *, quantile_cont(z, 0.5) OVER (PARTITION BY track, bead) AS m FROM frames WHERE phase = 3) SELECT track, bead, frame, round(round_even((z - m) / 2.5::DOUBLE - 0.5::DOUBLE, 0) * 2.5::DOUBLE + m, 9) AS binned FROM m",
    "ordered_categories": f"{_W}, m AS (SELECT bead, quantile_cont(z, 0.5) AS m FROM frames GROUP BY bead) SELECT bead, round(m, 9) AS median, row_number() OVER (ORDER BY m, bead) AS rank FROM m",
    "less_reference": f"{_W}, t AS (SELECT 't' || (bead % 3) AS track, bead, frame, z FROM frames), r AS (SELECT frame, avg(z) AS r FROM t WHERE track = 't0' GROUP BY frame) SELECT track, bead, frame, round(z - coalesce(r, 0), 9) AS z FROM t LEFT JOIN r USING (frame) WHERE track <> 't0'",
    "identification_rates": f"WITH {_ID} SELECT bead, strand, count_if(status = 'truepos') AS truepos, count_if(status = 'falseneg') AS falseneg, count_if(status = 'falsepos') AS falsepos, round(count_if(status = 'truepos') * 100 / nullif(count_if(status <> 'falsepos'), 0), 9) AS found_percent, round(count_if(status = 'falsepos') / nullif(max(size), 0), 9) AS falsepos_per_base FROM ident GROUP BY ALL",
    "quality_table": f"""{_W}, {_TESTS}, p AS (SELECT track, bead, testtype, {_FAIL} AS p FROM tests GROUP BY ALL) SELECT track, bead, {", ".join(f"round(max(p) FILTER (WHERE testtype = '{t}'), 9) AS {t}" for t in RULES.tests)}, CASE WHEN max(p) > 0 THEN arg_max(testtype, (p, testtype)) END AS mostcommonerror FROM p GROUP BY ALL""",
    "missing_beads": f"{_W}, {_TESTS}, p AS (SELECT track, bead, testtype, {_FAIL} AS p FROM tests GROUP BY ALL) SELECT track, bead, bool_or((testtype IN ('hfsigma', 'population') AND p >= 40) OR (testtype = 'pingpong' AND p >= 60)) AS missing FROM p GROUP BY ALL",
    "status_pivot": f"WITH {_ST} SELECT track, {', '.join(f'''count_if(status = '{x}') AS s{x}''' for x in '12345')} FROM status GROUP BY track",
    "status_flow": f"WITH {_ST}, n AS (SELECT *, lead(track) OVER w AS next_track, lead(status) OVER w AS next_status FROM status WINDOW w AS (PARTITION BY bead ORDER BY modification, track)) SELECT track, status, next_track, next_status, count(*) AS beads FROM n WHERE next_track IS NOT NULL GROUP BY ALL",
    "status_evolution": f"WITH {_ST}, n AS (SELECT modification, track, status, count(*) AS beads FROM status GROUP BY ALL) SELECT track, status, beads, round(beads * 100 / sum(beads) OVER (PARTITION BY modification, track), 9) AS percent, strftime(modification, '%d %H:%M') AS label FROM n",
    "carry_over": """WITH x AS (SELECT DISTINCT o_custkey % 20 AS bead, strftime(o_orderdate, '%Y-%m') AS track, translate(lower(substr(o_orderpriority, 3, 4)), 'abcdefghijklmnopqrstuvwxyz .', 'acgtacgtacgtacgtacgtacgtacac') AS oligo, date_trunc('month', o_orderdate) AS modification, floor(o_totalprice / 10) / 100 AS position, o_orderkey % 17 AS count, o_orderstatus <> 'P' AS keep FROM orders),
t AS (SELECT *, dense_rank() OVER (PARTITION BY bead ORDER BY modification) AS t FROM x), g AS (SELECT *, unnest([t - 1, t]) AS pair FROM t),
n AS (SELECT *, lead(track) OVER w AS next_track, lead(oligo) OVER w AS next_oligo, lead(modification) OVER w AS next_modification, lead(position) OVER w AS next_position, lead(count) OVER w AS next_count, lead(keep) OVER w AS next_keep FROM g WINDOW w AS (PARTITION BY bead, pair ORDER BY position, modification, track, oligo, count))
SELECT bead, track, oligo, strftime(modification, '%Y-%m') AS modification, position, count, next_track, next_oligo, strftime(next_modification, '%Y-%m') AS next_modification, next_position, next_count FROM n
WHERE next_position - position < 20 AND next_modification <> modification AND next_count <= 0.5::DOUBLE * count AND next_keep AND oligo <> next_oligo AND right(oligo, 3) <> left(next_oligo, 3) AND left(oligo, 3) <> right(next_oligo, 3) AND oligo <> next_oligo""",
    "detections": f"WITH {_CALLED} SELECT track, strand, theopos, peakposition, round(peakposition - theopos, 9) AS dist, estimators, doublebinding, detection FROM judged",
    "confusion": f"""WITH {_CALLED}, per AS (SELECT track, strand, theopos, bool_or(detection) AS hit, bool_or(detection AND doublebinding) AS twice FROM judged GROUP BY ALL), states AS (SELECT track, CASE WHEN strand = 'positive' THEN CASE WHEN coalesce(hit, FALSE) THEN 'TP' ELSE 'FN' END WHEN coalesce(hit, FALSE) AND NOT coalesce(twice, FALSE) THEN 'FP' ELSE 'TN' END AS state FROM theory LEFT JOIN per USING (track, strand, theopos))
SELECT track, count_if(state = 'TP') AS TP, count_if(state = 'FP') AS FP, count_if(state = 'TN') AS TN, count_if(state = 'FN') AS FN FROM states GROUP BY track""",
    "summary_sheet": f"""{_W}, {_BINNED}, p AS (SELECT track, bead, peak, count(*) AS n, avg(length) / 30 AS d FROM binned GROUP BY ALL), k AS (SELECT track, bead, count(*) AS peaks, sum(n) AS events, sum(d * n) / sum(n) AS downtime FROM p GROUP BY ALL),
dz AS (SELECT *, z - last_value(z IGNORE NULLS) OVER (PARTITION BY track, bead ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dz FROM frames), h AS (SELECT track, bead, quantile_cont(abs(dz), 0.5) AS hfsigma FROM dz GROUP BY ALL)
SELECT track, bead, ncycles, round(hfsigma, 9) AS hfsigma, coalesce(peaks, 0) AS peaks, coalesce(events, 0) AS events, round(downtime, 9) AS downtime, round(coalesce(events, 0) / ncycles, 9) AS events_per_cycle FROM cycles JOIN h USING (track, bead) LEFT JOIN k USING (track, bead)""",
}
