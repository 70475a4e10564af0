"""Queries on clocks of two instruments."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclarium.operators import clocks as op
from cyclarium.sources.fixtures import frames


def _samples(s, d):
    """Each bead's signal as that of an instrument which samples twice as often, begins later and steps up where phase 2 begins."""
    rows = frames(s, d).select(F.concat(F.lit("t"), "bead").alias("track"), F.col("frame"), (F.coalesce("z", F.lit(0.0)) / 50 + F.when(F.col("phase") >= 2, 100.0).otherwise(0.0)).alias("z"))
    twice = rows.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).select("track", (F.col("frame") * 2 + F.col("_k")).alias("frame"), "z")
    return twice.where("frame >= 90").withColumn("frame", F.col("frame") - 90)


def _phases(s, d):
    rows = frames(s, d).withColumn("track", F.concat(F.lit("t"), "bead"))
    return rows.groupBy("track", "cycle", "phase").agg(F.min("frame").alias("start"))


QUERIES = {"synchronize": lambda s, d: op.synchronize(_samples(s, d), _phases(s, d))}
SQL: dict[str, str] = {}
