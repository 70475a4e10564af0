"""Queries on selections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.functions.signal import round9
from cyclarium.operators import selection as op
from cyclarium.queries.events import _FLAT, _flat
from cyclarium.sources.fixtures import FRAMES_SQL, SIGNALS_SQL, frames, read, short_signals

_K = ["track", "bead", "frame", "cycle", "cycleframe", "phase", "z"]


def _pairs(s, d):
    return read(s, d, "orders").select((F.col("o_custkey") % 100 + 1).alias("bead"), F.lit("lineitem").alias("track"), (F.col("o_orderkey") % 12).cast("int").alias("cycle")).distinct()


def _names(s, d):
    return read(s, d, "part").select(F.concat_ws("_", F.lit("exp"), F.regexp_replace("p_name", " ", "_")).alias("track")).distinct()


def _points(s, d):
    return read(s, d, "orders").select((F.col("o_custkey") % 50).alias("bead"), (F.floor(F.col("o_totalprice") / 10) / 100).alias("position")).distinct()


def _targets(s, d):
    return read(s, d, "part").select((F.col("p_partkey") % 50).alias("bead"), (F.floor(F.col("p_retailprice") * 20) / 100).alias("target")).distinct()


def _secondaries(s, d):
    return read(s, d, "events").select(F.lit("lineitem").alias("track"), F.lit("tsample").alias("name"), (F.col("event_id") * 7).alias("frame"), F.col("value"))


def _overrides(s, d):
    """One value per user and frame: the bead of that number has these alone."""
    rows = read(s, d, "events").groupBy(F.col("user_id").alias("bead"), (F.col("event_id") % 600).alias("frame")).agg(F.max("value").alias("z"))
    return rows.select(F.lit("lineitem").alias("track"), "bead", "frame", "z")


QUERIES = {
    "selecting": lambda s, d: op.selecting(frames(s, d), [1, 5, 7]),
    "selecting_pairs": lambda s, d: op.selecting(frames(s, d), _pairs(s, d), ["track", "bead", "cycle"]),
    "discarding_pairs": lambda s, d: op.discarding(frames(s, d), _pairs(s, d), ["track", "bead", "cycle"]),
    "with_phases_cycles_samples": lambda s, d: op.with_samples(op.with_cycles(op.with_phases(frames(s, d), 3, 5), 2, 9), 1, 3),
    "assign_phases": lambda s, d: op.assign_phases(frames(s, d).select("track", "bead", "frame", "z"), op.phase_table(frames(s, d))),
    "sample_cycles": lambda s, d: op.sample_cycles(frames(s, d), [2, 3, 7]),
    "rename_beads": lambda s, d: op.rename_beads(frames(s, d), {1: 1001, 2: 1002}).select("track", "bead", "frame", "z"),
    "concatenate": lambda s, d: op.concatenate(frames(s, d), frames(s, d).withColumn("bead", F.col("bead") + 5)),
    "common_beads": lambda s, d: op.common_beads(short_signals(s, d)),
    "available_beads": lambda s, d: op.available_beads(short_signals(s, d)),
    "common_tracks": lambda s, d: op.common_tracks(short_signals(s, d), [1, 2, 3]),
    "track_counts": lambda s, d: op.track_counts(short_signals(s, d)),
    "least_common_names": lambda s, d: op.least_common_names(_names(s, d)),
    "matching_names": lambda s, d: op.matching_names(_names(s, d), "^exp_", weak=3),
    "override_cycles": lambda s, d: op.override_cycles(frames(s, d), _overrides(s, d)),
    "as_of": lambda s, d: op.as_of(frames(s, d), _secondaries(s, d), "tsample").select("track", "bead", "frame", "latest", round9(F.col("interpolated")).alias("interpolated")),
    "wide_beads": lambda s, d: op.wide_beads(frames(s, d), [1, 2, 3]),
    "nearest_target": lambda s, d: op.nearest(_points(s, d), _targets(s, d), ["bead"], 2.0).withColumn("delta", round9(F.col("delta"))),
    "exclusive_target": lambda s, d: op.exclusive(op.nearest(_points(s, d), _targets(s, d), ["bead"], 2.0), ["bead"]).withColumn("delta", round9(F.col("delta"))),
    "mutual_matches": lambda s, d: op.mutual(_points(s, d), _targets(s, d), ["bead"], 2.0),
    "matched_lists": lambda s, d: op.matched(_points(s, d), _targets(s, d), ["bead"], 2.0),
    "missed_targets": lambda s, d: op.missed(_targets(s, d), op.mutual(_points(s, d), _targets(s, d), ["bead"], 2.0), ["bead"]),
    "compare_events": lambda s, d: op.compare_events(_flat(s, d), (F.col("avg") > 60) & (F.col("length") >= 6)),
}

_W = "WITH " + FRAMES_SQL
_C = ", ".join(_K)
_PAIRS = "pairs AS (SELECT DISTINCT o_custkey % 100 + 1 AS bead, 'lineitem' AS track, o_orderkey % 12 AS cycle FROM orders)"
_NAMES = "names AS (SELECT DISTINCT 'exp_' || replace(p_name, ' ', '_') AS track FROM part)"
_NEAR = """points AS (SELECT DISTINCT o_custkey % 50 AS bead, floor(o_totalprice / 10) / 100 AS position FROM orders), targets AS (SELECT DISTINCT p_partkey % 50 AS bead, floor(p_retailprice * 20) / 100 AS target FROM part),
near AS (SELECT bead, position, arg_min(target, (abs(position - target), target)) AS closest FROM points JOIN targets USING (bead) WHERE abs(position - target) < 2 GROUP BY ALL),
back AS (SELECT bead, target, arg_min(position, (abs(target - position), position)) AS position FROM points JOIN targets USING (bead) WHERE abs(target - position) < 2 GROUP BY ALL),
mutual AS (SELECT near.bead, near.position, closest AS target FROM near JOIN back ON near.bead = back.bead AND near.closest = back.target AND near.position = back.position)"""


def matched_sql(first: str, second: str, key: str, window: float) -> str:
    """Common tables up to matched(key, a, b): values of the tables ``first`` and ``second`` (key, x) that match.

    Neighbours in chains are edges; a fold over a key's edges from the shortest on takes those with free ends.
    """
    return f"""side AS (SELECT {key}, x, 0 AS side FROM {first} UNION ALL SELECT {key}, x, 1 FROM {second}), places AS (SELECT {key}, x, min(side) AS lo, max(side) AS hi FROM side GROUP BY ALL),
turn AS (SELECT *, sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN lo <> hi THEN 1 ELSE 0 END AS turns FROM places),
begun AS (SELECT *, coalesce(last_value(CASE WHEN lo = hi THEN lo - turns END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + turns AS start FROM turn),
ordered AS (SELECT s.{key}, s.x, s.side, row_number() OVER (PARTITION BY s.{key} ORDER BY s.x, (s.side + b.start) % 2 <> 0) AS i FROM side s JOIN begun b ON s.{key} = b.{key} AND s.x = b.x),
edge AS (SELECT *, lag(x) OVER w AS px, lag(side) OVER w AS ps FROM ordered WINDOW w AS (PARTITION BY {key} ORDER BY i)),
folded AS (SELECT {key}, unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list([i] ORDER BY x - px, i)), lambda acc, e: CASE WHEN list_contains(acc, e[1] - 1) OR list_contains(acc, e[1] + 1) THEN acc ELSE list_concat(acc, e) END)) AS i FROM edge WHERE ps <> side AND NOT (px < x - {window}) GROUP BY {key}),
matched AS (SELECT {key}, CASE WHEN side = 1 THEN px ELSE x END AS a, CASE WHEN side = 1 THEN x ELSE px END AS b FROM folded JOIN edge USING ({key}, i))"""


_LISTS = "points AS (SELECT DISTINCT o_custkey % 50 AS bead, floor(o_totalprice / 10) / 100 AS x FROM orders), targets AS (SELECT DISTINCT p_partkey % 50 AS bead, floor(p_retailprice * 20) / 100 AS x FROM part)"
SQL = {
    "selecting": f"{_W} SELECT {_C} FROM frames WHERE bead IN (1, 5, 7)",
    "selecting_pairs": f"{_W}, {_PAIRS} SELECT {_C} FROM frames SEMI JOIN pairs USING (track, bead, cycle)",
    "discarding_pairs": f"{_W}, {_PAIRS} SELECT {_C} FROM frames ANTI JOIN pairs USING (track, bead, cycle)",
    "with_phases_cycles_samples": f"{_W} SELECT {_C} FROM frames WHERE phase BETWEEN 3 AND 5 AND cycle BETWEEN 2 AND 8 AND (frame - 1) % 3 = 0",
    "assign_phases": f"{_W} SELECT track, bead, frame, z, cycle, phase FROM frames",
    "sample_cycles": f"{_W} SELECT track, bead, row_number() OVER (PARTITION BY track, bead ORDER BY frame) - 1 AS frame, dense_rank() OVER (PARTITION BY track, bead ORDER BY cycle) - 1 AS cycle, cycleframe, phase, z FROM frames WHERE cycle IN (2, 3, 7)",
    "rename_beads": f"{_W} SELECT track, CASE bead WHEN 1 THEN 1001 WHEN 2 THEN 1002 ELSE bead END AS bead, frame, z FROM frames",
    "concatenate": f"""{_W}, one AS (SELECT * FROM frames), two AS (SELECT * REPLACE (bead + 5 AS bead) FROM frames),
united AS (SELECT * FROM one UNION ALL SELECT track, bead, frame - (SELECT min(frame) FROM two) + (SELECT max(frame) + 1 FROM one) AS frame, cycle + (SELECT max(cycle) + 1 FROM one) AS cycle, cycleframe, phase, z FROM two)
SELECT p.track, b.bead, p.frame, p.cycle, p.cycleframe, p.phase, v.z FROM (SELECT DISTINCT track, frame, cycle, cycleframe, phase FROM united) p JOIN (SELECT DISTINCT bead FROM united) b ON TRUE LEFT JOIN united v ON v.bead = b.bead AND v.frame = p.frame""",
    "common_beads": f"WITH {SIGNALS_SQL} SELECT bead FROM signals GROUP BY bead HAVING count(DISTINCT track) = (SELECT count(DISTINCT track) FROM signals)",
    "available_beads": f"WITH {SIGNALS_SQL} SELECT DISTINCT bead FROM signals",
    "common_tracks": f"WITH {SIGNALS_SQL} SELECT track FROM signals WHERE bead IN (1, 2, 3) GROUP BY track HAVING count(DISTINCT bead) = 3",
    "track_counts": f"WITH {SIGNALS_SQL}, own AS (SELECT DISTINCT track, bead FROM signals) SELECT track, bead, count(*) OVER (PARTITION BY bead) AS trackcount FROM own",
    "least_common_names": f"""WITH {_NAMES}, t AS (SELECT track, unnest(string_split(track, '_')) AS token, generate_subscripts(string_split(track, '_'), 1) AS i FROM names), shared AS (SELECT token FROM t GROUP BY token HAVING count(DISTINCT track) = (SELECT count(*) FROM names))
SELECT names.track AS track, coalesce(name, 'ref') AS name FROM names LEFT JOIN (SELECT track, string_agg(token, '_' ORDER BY i) AS name FROM t WHERE token NOT IN (SELECT token FROM shared) GROUP BY track) AS n ON n.track = names.track""",
    "matching_names": f"WITH {_NAMES} SELECT track FROM names WHERE regexp_matches(track, '^exp_') AND length(track) - length(regexp_replace(track, '[atAT]', '', 'g')) = 3",
    "override_cycles": f"{_W}, ov AS (SELECT user_id AS bead, event_id % 600 AS frame, max(value) AS z FROM events GROUP BY ALL) SELECT f.track, f.bead, f.frame, f.cycle, f.cycleframe, f.phase, CASE WHEN b.bead IS NULL THEN f.z ELSE ov.z END AS z FROM frames f LEFT JOIN (SELECT DISTINCT bead FROM ov) b ON f.bead = b.bead LEFT JOIN ov ON f.bead = ov.bead AND f.frame = ov.frame",
    "as_of": f"""{_W}, sec AS (SELECT event_id * 7 AS frame, value FROM events), j AS (SELECT f.track, f.bead, f.frame, a.value AS v0, a.frame AS f0, b.value AS v1, b.frame AS f1 FROM frames f ASOF LEFT JOIN sec a ON f.frame >= a.frame ASOF LEFT JOIN sec b ON f.frame <= b.frame)
SELECT track, bead, frame, v0 AS latest, round(coalesce(CASE WHEN f0 = f1 THEN v0 ELSE v0 + (v1 - v0) * (frame - f0) / (f1 - f0) END, v0, v1), 9) AS interpolated FROM j""",
    "wide_beads": f"{_W} SELECT track, frame, max(z) FILTER (WHERE bead = 1) AS b1, max(z) FILTER (WHERE bead = 2) AS b2, max(z) FILTER (WHERE bead = 3) AS b3 FROM frames WHERE bead IN (1, 2, 3) GROUP BY ALL",
    "nearest_target": f"WITH {_NEAR} SELECT bead, position, closest, round(position - closest, 9) AS delta FROM points LEFT JOIN near USING (bead, position)",
    "exclusive_target": f"""WITH {_NEAR}, r AS (SELECT *, closest IS NOT NULL AND row_number() OVER (PARTITION BY bead, closest ORDER BY abs(position - closest), position) = 1 AS k FROM points LEFT JOIN near USING (bead, position))
SELECT bead, position, CASE WHEN k THEN closest END AS closest, CASE WHEN k THEN round(position - closest, 9) END AS delta FROM r""",
    "mutual_matches": f"WITH {_NEAR} SELECT bead, position, target FROM mutual",
    "matched_lists": f"WITH {_LISTS}, {matched_sql('targets', 'points', 'bead', 2.0)} SELECT bead, b AS position, a AS target FROM matched",
    "missed_targets": f"WITH {_NEAR} SELECT bead, position, target, 'truepos' AS status FROM mutual UNION ALL SELECT bead, NULL, target, 'falseneg' FROM targets ANTI JOIN mutual USING (bead, target)",
    "compare_events": f"{_W}, {_FLAT} SELECT track, bead, cycle FROM flat GROUP BY ALL HAVING bool_or(avg > 60 AND length >= 6)",
}
