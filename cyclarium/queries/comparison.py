"""Queries on comparisons of beads, hairpins and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import calling, cleaning
from cyclarium.operators import comparison as op
from cyclarium.operators.selection import phase_table
from cyclarium.queries.cleaning import RULES, _STATUS
from cyclarium.queries.peaks import _BINNED, _CALLED, _binned, _calling, _fits, _peaks, _sequences
from cyclarium.queries.selection import _points, _targets, matched_sql
from cyclarium.sources.fixtures import FRAMES_SQL, frames, read


def _r(df, *columns):
    return df.withColumns({c: round9(F.col(c)) for c in columns})


def _identified(s, d):
    return calling.identified_peaks(*_calling(s, d), window=4.0)


def _history(s, d):
    return read(s, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("key"), F.date_trunc("month", "o_orderdate").alias("time")).distinct()


def _tracks(s, d):
    return read(s, d, "part").select(F.translate(F.lower(F.split("p_name", " ")[0]), "bdefhijklmnopqrsuvwxyz", "acgtacgtacgtacgtacgtac").alias("track")).union(read(s, d, "nation").select(F.lower("n_name"))).distinct()


def _series(s, d):
    rows = read(s, d, "events").select(F.lit("lineitem").alias("track"), F.when(F.col("event_type") == "click", "tsample").when(F.col("event_type") == "view", "tsink").otherwise("other").alias("name"), (F.col("event_id") * 3).alias("frame"), "value")
    magnet = read(s, d, "orders").groupBy((F.col("o_orderkey") * 2).alias("frame")).agg(F.max("o_totalprice").alias("zmag"), F.min("o_custkey").cast("double").alias("vcap"))
    cycles = phase_table(frames(s, d)).groupBy("track", "cycle").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return rows.where("name <> 'other'"), magnet.withColumn("track", F.lit("lineitem")), cycles


QUERIES = {
    "match_distance": lambda s, d: _r(op.match_distance(_points(s, d), _targets(s, d), ["bead"], 2.0, 1.0, 0.25), "distance", "stretch_slope", "bias_slope"),
    "select_best": lambda s, d: op.select_best(_fits(s, d), ["GF3"]),
    "reset_status": lambda s, d: _r(op.reset_status(_identified(s, d), 2.0), "baseposition", "distance").select("track", "bead", "hpin", "peak", "baseposition", "distance", "closest", "status"),
    "axis_order": lambda s, d: _r(op.axis_order(_fits(s, d)), "hcost", "tcost", "bcost"),
    "bead_statuses": lambda s, d: op.bead_statuses(frames(s, d), cleaning.bead_status(cleaning.cycle_tests(frames(s, d), RULES), frames(s, d), RULES), _peaks(s, d)),
    "duplicate_history": lambda s, d: op.duplicate_history(read(s, d, "nation").select(F.col("n_name").alias("track"), (F.col("n_nationkey") % 6).cast("string").alias("k")), _history(s, d), "k").withColumn("modification", F.date_format("modification", "yyyy-MM")),
    "track_oligos": lambda s, d: op.track_oligos(_tracks(s, d)),
    "reference_track": lambda s, d: op.reference_track(_tracks(s, d)),
    "expected_positions": lambda s, d: op.expected_positions(_sequences(s, d), ["ctg", "gta"], "gtac"),
    "track_order": lambda s, d: op.track_order(_tracks(s, d), "acgtacgtactgacagt"),
    "identify_references": lambda s, d: _r(op.identify_references(_points(s, d).select(F.col("bead").alias("track"), F.col("position").alias("peakposition")), _targets(s, d).select(F.col("bead").alias("track"), F.col("target").alias("position")), 3.0), "delta"),
    "false_positives": lambda s, d: op.false_positives(op.identify_references(_points(s, d).select(F.col("bead").alias("track"), F.col("position").alias("peakposition")), _targets(s, d).select(F.col("bead").alias("track"), F.col("target").alias("position")), 3.0)),
    "positions_per_peak": lambda s, d: _r(op.positions_per_peak(_binned(s, d)), "position"),
    "thresholds": lambda s, d: _r(frames(s, d).groupBy("track", "bead").agg(op.median_threshold(F.col("z"), F.lit(3.0)).alias("median"), op.population_threshold(F.col("z")).alias("population")), "median", "population"),
    "quality_series": lambda s, d: op.quality_series(*_series(s, d), ["tsample", "tsink"]),
}
_W = "WITH " + FRAMES_SQL
_FIT = "fits AS (SELECT 'lineitem' AS track, l_suppkey AS bead, 'GF' || (l_linenumber % 4) AS hpin, round(quantile_cont(l_quantity, 0.5) + count(*) / 100, 6) AS cost, 1.0::DOUBLE AS stretch, 0.0::DOUBLE AS bias FROM lineitem GROUP BY ALL)"
_PT = "pts AS (SELECT DISTINCT o_custkey % 50 AS bead, floor(o_totalprice / 10) / 100 AS position FROM orders), tgs AS (SELECT DISTINCT p_partkey % 50 AS bead, floor(p_retailprice * 20) / 100 AS raw FROM part)"
_TR = "tr AS (SELECT DISTINCT translate(lower(split_part(p_name, ' ', 1)), 'bdefhijklmnopqrsuvwxyz', 'acgtacgtacgtacgtacgtac') AS track FROM part UNION SELECT lower(n_name) FROM nation)"
_SEQ = "s AS (SELECT DISTINCT p_name AS hpin, translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtaca') AS t FROM part)"
_REF = f"{_PT}, near AS (SELECT bead, position, raw, row_number() OVER (PARTITION BY bead, position ORDER BY abs(position - raw), raw) AS i FROM pts JOIN tgs USING (bead) WHERE abs(position - raw) < 3), ids AS (SELECT pts.bead AS track, pts.position AS peakposition, raw AS reference, round(pts.position - raw, 9) AS delta FROM pts LEFT JOIN (SELECT * FROM near WHERE i = 1) AS n USING (bead, position))"
SQL = {
    "match_distance": f"""WITH {_PT}, placed AS (SELECT bead, raw, raw + 0.25 AS x FROM tgs), points AS (SELECT bead, position AS x FROM pts), {matched_sql('points', 'placed', 'bead', 2.0)},
found AS (SELECT m.bead, count(*) AS n, sum(power(a - b, 2)) AS sq, sum(-raw * (a - b)) AS sl, sum(b - a) AS sh FROM matched m JOIN placed p ON m.bead = p.bead AND m.b = p.x GROUP BY m.bead), sizes AS (SELECT bead, coalesce(a, 0) + coalesce(b, 0) AS n FROM (SELECT bead, count(*) AS a FROM pts GROUP BY bead) FULL JOIN (SELECT bead, count(*) AS b FROM tgs GROUP BY bead) USING (bead))
SELECT bead, coalesce(found.n, 0) AS nfound, round(CASE WHEN found.n > 0 THEN sizes.n - 2 * found.n + sq / 4 ELSE sizes.n + 1 END, 9) AS distance, round(coalesce(sl / 2, 0), 9) AS stretch_slope, round(coalesce(sh / 2, 0), 9) AS bias_slope FROM sizes LEFT JOIN found USING (bead)""",
    "select_best": f"WITH {_FIT}, r AS (SELECT *, row_number() OVER (PARTITION BY track, bead ORDER BY cost, hpin) AS i FROM fits) SELECT track, bead, hpin, cost, stretch, bias FROM r WHERE i = 1 AND hpin <> 'GF3'",
    "reset_status": f"{_W}, {_CALLED} SELECT track, bead, hpin, peak, round(baseposition, 9) AS baseposition, round(distance, 9) AS distance, CASE WHEN status = 'truepos' THEN closest END AS closest, CASE WHEN status = 'truepos' THEN CASE WHEN abs(distance) < 2 THEN 'truepos' ELSE 'falsepos' END ELSE status END AS status FROM called",
    "axis_order": f"""WITH {_FIT}, m AS (SELECT *, quantile_cont(cost, 0.5) OVER (PARTITION BY hpin) AS hcost, quantile_cont(cost, 0.5) OVER (PARTITION BY hpin, track) AS tcost, quantile_cont(cost, 0.5) OVER (PARTITION BY hpin, track, bead) AS bcost FROM fits)
SELECT track, bead, hpin, cost, stretch, bias, round(hcost, 9) AS hcost, round(tcost, 9) AS tcost, round(bcost, 9) AS bcost, row_number() OVER (PARTITION BY hpin ORDER BY hcost, hpin, tcost, track, bcost, bead) AS "order" FROM m""",
    "bead_statuses": f"{_W}, {_STATUS}, {_BINNED.split('WITH ')[-1]}, has AS (SELECT DISTINCT track, bead, TRUE AS has FROM binned) SELECT status.track, CASE WHEN errkey <> 'ok' THEN errkey WHEN has THEN 'ok' ELSE 'empty' END AS beadstatus, count(*) AS beads FROM status LEFT JOIN has ON status.bead = has.bead GROUP BY ALL",
    "duplicate_history": "WITH h AS (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS k, date_trunc('month', o_orderdate) AS time FROM orders) SELECT n_name AS track, h.k AS k, strftime(time, '%Y-%m') AS modification, TRUE AS keep FROM nation JOIN h ON CAST(n_nationkey % 6 AS VARCHAR) = h.k",
    "track_oligos": f"WITH {_TR} SELECT track, reverse(translate(track, 'atcg', 'tagc')) AS oligo FROM tr WHERE regexp_full_match(track, '[atcg]+')",
    "reference_track": f"WITH {_TR} SELECT min(track) AS track FROM tr WHERE NOT regexp_full_match(track, '[atcg]+')",
    "expected_positions": f"""WITH {_SEQ}, i AS (SELECT *, unnest(range(1, length(t) - 1)) AS i FROM s), o(oligo, other) AS (VALUES ('ctg', 'cag'), ('gta', 'tac')), f AS (SELECT DISTINCT hpin, oligo, i + 2 AS position, substr(t, i, 3) = oligo AS strand FROM i, o WHERE substr(t, i, 3) IN (oligo, other)),
e AS (SELECT hpin, min(i + 3) AS e FROM (SELECT hpin, t, unnest(range(1, length(t) - 2)) AS i FROM s) WHERE substr(t, i, 4) = 'gtac' GROUP BY hpin)
SELECT hpin, oligo, position, strand, coalesce(position <= e AND position > e - 4, FALSE) AS target, coalesce(position <= e AND position > e - 4, FALSE) AND strand AS expected FROM f LEFT JOIN e USING (hpin)""",
    "track_order": f"WITH {_TR}, p AS (SELECT track, CASE WHEN regexp_full_match(track, '[atcg]+') THEN instr(reverse(translate('acgtacgtactgacagt', 'atcg', 'tagc')), track) ELSE 0 END AS p, regexp_full_match(track, '[atcg]+') AS pure FROM tr) SELECT track, row_number() OVER (ORDER BY p, track) - 1 AS trackorder FROM p WHERE p > 0 OR NOT pure",
    "identify_references": f"WITH {_REF} SELECT * FROM ids",
    "false_positives": f"WITH {_REF} SELECT track, peakposition FROM ids WHERE reference IS NULL",
    "positions_per_peak": f"{_W}, {_BINNED} SELECT track, bead, peak, cycle, round(avg(avg), 9) AS position, count(*) AS events FROM binned GROUP BY ALL",
    "thresholds": f"{_W} SELECT track, bead, round(quantile_cont(z, 0.75) + 6, 9) AS median, round(quantile_cont(z, 0.75) + 2 * (quantile_cont(z, 0.66) - quantile_cont(z, 0.33)), 9) AS population FROM frames GROUP BY ALL",
    "quality_series": f"""{_W}, t AS (SELECT event_id * 3 AS frame, max(value) FILTER (WHERE event_type = 'click') AS tsample, max(value) FILTER (WHERE event_type = 'view') AS tsink FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL), m AS (SELECT o_orderkey * 2 AS frame, max(o_totalprice) AS zmag, CAST(min(o_custkey) AS DOUBLE) AS vcap FROM orders GROUP BY ALL),
c AS (SELECT cycle, min(frame) AS a, max(frame) + 1 AS b FROM frames GROUP BY cycle), j AS (SELECT coalesce(t.frame, m.frame) AS frame, tsample, tsink, zmag, vcap FROM t FULL JOIN m ON t.frame = m.frame)
SELECT 'lineitem' AS track, coalesce(c.cycle, -1) AS cycle, j.frame, tsample, tsink, zmag, vcap FROM j LEFT JOIN c ON j.frame >= c.a AND j.frame < c.b""",
}
