"""Signals made from the star-schema tables, in Spark and in SQL.

``lineitem`` is the signal: a bead is a supplier, its rows in a fixed order are
frames, 40 frames are a cycle of eight phases. Values are missing where
``l_linenumber`` is 7. An incomplete last cycle is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frames of each phase of a cycle, and the phases' names by number.
DURATIONS = (1, 5, 1, 5, 2, 20, 1, 5)
PHASES = {"initial": 1, "pull": 3, "rampdown": 4, "measure": 5, "relax": 7, "count": 8}
STARTS = tuple(sum(DURATIONS[:i]) for i in range(len(DURATIONS)))
CYCLE = sum(DURATIONS)
ORDER = ("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phase_of(cycleframe):
    """Number of the phase that holds a frame of the cycle."""
    out = F.lit(len(STARTS) - 1)
    for i in range(len(STARTS) - 2, -1, -1):
        out = F.when(cycleframe < STARTS[i + 1], i).otherwise(out)
    return out


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(track, bead, frame, cycle, cycleframe, phase, z)."""
    own = W.partitionBy("l_suppkey")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("bead"),
        (F.row_number().over(own.orderBy(*ORDER)) - 1).alias("frame"),
        F.count("*").over(own).alias("n"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 1000).alias("z"),
    )
    rows = rows.withColumns({"cycle": F.floor(F.col("frame") / CYCLE).cast("int"), "cycleframe": F.col("frame") % CYCLE})
    rows = rows.where(F.col("cycle") < F.floor(F.col("n") / CYCLE))
    return rows.select(F.lit("lineitem").alias("track"), "bead", "frame", "cycle", "cycleframe", phase_of(F.col("cycleframe")).cast("int").alias("phase"), "z")


_CASE = " ".join(f"WHEN frame % {CYCLE} < {STARTS[i + 1]} THEN {i}" for i in range(len(STARTS) - 1))
#: The same as a common table expression named frames.
FRAMES_SQL = f"""frames AS (SELECT 'lineitem' AS track, bead, frame, CAST(frame // {CYCLE} AS INTEGER) AS cycle, frame % {CYCLE} AS cycleframe, CASE {_CASE} ELSE {len(STARTS) - 1} END AS phase, z
FROM (SELECT l_suppkey AS bead, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ORDER)}) - 1 AS frame, count(*) OVER (PARTITION BY l_suppkey) AS n, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 1000 END AS z FROM lineitem)
WHERE frame // {CYCLE} < n // {CYCLE})"""


def short_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signals(track, bead, frame, kind, z) from ``events``: a bead is a user, a track an event type."""
    rows = read(spark, sf_dir, "events")
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.select(F.col("event_type").alias("track"), F.col("user_id").alias("bead"), frame.alias("frame"), F.col("ts"), F.col("value").alias("z"))


SIGNALS_SQL = "signals AS (SELECT event_type AS track, user_id AS bead, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, ts, value AS z FROM events)"
