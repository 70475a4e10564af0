"""Event detection, filters, histograms and drift removal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.functions import events as kernels
from cyclarium.functions import filters
from cyclarium.operators.cleaning import by_bead
from cyclarium.operators.statistics import BEAD, CYCLE
from cyclarium.sources.fixtures import PHASES

EVENTS = "track string, bead bigint, cycle int, event int, start bigint, length bigint, data array<double>"


def detect(frames: DataFrame, precision: DataFrame, *, phase: int = PHASES["measure"], filtered: bool = False, **options) -> DataFrame:
    """events(track, bead, cycle, event, start, length, data) in one phase, with a precision (track, bead, precision) each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cycle, part in rows.sort_values("frame").groupby("cycle"):
            z = part["z"].to_numpy(np.float64, na_value=np.nan)
            value = float(part["precision"].iloc[0])
            source = filters.forward_backward(z, precision=value) if filtered else z
            for k, (a, b) in enumerate(kernels.detect(source, value, **options)):
                out.append((part["track"].iloc[0], part["bead"].iloc[0], cycle, k, a, b - a, z[a:b]))
        return pd.DataFrame(out, columns=["track", "bead", "cycle", "event", "start", "length", "data"])

    rows = frames.where(F.col("phase") == phase).select(*CYCLE, "frame", "z").join(precision.select(*BEAD, "precision"), BEAD)
    return rows.groupBy(*BEAD).applyInPandas(run, EVENTS)


def derivate_grades(frames: DataFrame, precision: Column, width: int = 3, percentile: float = 0.75, factor: float = 2.0, by: list[str] = CYCLE) -> DataFrame:
    """Frames that aren't missing, with the step between the means before and after over its threshold, as window functions."""
    rows = frames.where("z is not null")
    over = W.partitionBy(*by).orderBy("frame")
    step = F.abs(F.avg("z").over(over.rowsBetween(0, width - 1)) - F.coalesce(F.avg("z").over(over.rowsBetween(-width, -1)), F.col("z")))
    rows = rows.withColumn("_step", step)
    return rows.withColumn("grade", F.col("_step") / (F.percentile("_step", F.lit(percentile)).over(W.partitionBy(*by)) + factor * precision)).drop("_step")


def islands(rows: DataFrame, boundary: Column, by: list[str] = CYCLE) -> DataFrame:
    """Rows numbered by the stretch that they lie in; a stretch begins where ``boundary`` holds."""
    return rows.withColumn("event", F.sum(boundary.cast("int")).over(W.partitionBy(*by).orderBy("frame").rowsBetween(W.unboundedPreceding, 0)))


def flat_events(frames: DataFrame, precision: float, least: int = 4, by: list[str] = CYCLE) -> DataFrame:
    """Events between steps by the derivate grade alone, in window functions: start, length, avg of each."""
    graded = derivate_grades(frames, F.lit(precision), by=by)
    parts = islands(graded, F.col("grade") >= 1, by).groupBy(*by, "event").agg(F.min("frame").alias("start"), (F.max("frame") - F.min("frame") + 1).alias("length"), F.avg("z").alias("avg"), F.stddev_pop("z").alias("std"))
    return parts.where(F.col("length") >= least).withColumn("event", F.row_number().over(W.partitionBy(*by).orderBy("start")) - 1)


def event_table(events: DataFrame) -> DataFrame:
    """One row per event: start, length, avg, std and integral of its values."""
    data = F.filter("data", lambda x: x.isNotNull() & ~F.isnan(x))
    total, n = F.aggregate(data, F.lit(0.0), lambda a, x: a + x), F.size(data)
    mean = total / F.nullif(n, F.lit(0))
    square = F.aggregate(data, F.lit(0.0), lambda a, x: a + x * x)
    return events.select(*CYCLE, "event", "start", "length", mean.alias("avg"), F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0))).alias("std"), total.alias("integral"))


def event_frames(events: DataFrame) -> DataFrame:
    """One row per frame of each event."""
    return events.select(*CYCLE, "event", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("frame"))


def concatenated(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Frames whose values outside of events are missing: each frame looks back to the last event's start in its cycle."""
    marks = events.select(*CYCLE, F.col("start").alias("frame"), (F.col("start") + F.col("length")).alias("_stop"))
    both = frames.withColumn("_own", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    back = W.partitionBy(*CYCLE).orderBy("frame", F.col("_own").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    inside = F.col("frame") < F.last("_stop", ignorenulls=True).over(back)
    return both.withColumn("z", F.when(inside, F.col("z"))).where("_own").select(*frames.columns)


def swap(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Events with the values of another table of frames in their places."""
    rows = event_frames(events).join(frames.select(*CYCLE, "frame", "z"), [*CYCLE, "frame"], "left")
    return rows.groupBy(*CYCLE, "event").agg(F.min("frame").alias("start"), F.count("*").alias("length"), F.transform(F.array_sort(F.collect_list(F.struct("frame", "z"))), lambda x: x["z"]).alias("data"))


def forward_backward(frames: DataFrame, **options) -> DataFrame:
    return by_bead(frames, lambda z: filters.forward_backward(z, **options))


def non_linear(frames: DataFrame, **options) -> DataFrame:
    return by_bead(frames, lambda z: filters.non_linear(z, **options))


def rolling_filter(frames: DataFrame, width: int = 5, how: str = "mean") -> DataFrame:
    """Centred moving mean or median."""
    over = W.partitionBy(*BEAD).orderBy("frame").rowsBetween(-(width // 2), width // 2)
    return frames.withColumn("z", {"mean": F.avg, "median": F.median}[how]("z").over(over) if how == "mean" else F.expr("percentile(z, 0.5)").over(over))


def hold(frames: DataFrame, low: float, high: float) -> DataFrame:
    """Values outside the bounds give way to the last good one."""
    over = W.partitionBy(*BEAD).orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("z", F.last(F.when(F.col("z").between(low, high), F.col("z")), ignorenulls=True).over(over))


def slopes(frames: DataFrame, width: int = 5) -> DataFrame:
    """Slope of a line through the last ``width`` values."""
    over = W.partitionBy(*BEAD).orderBy("frame").rowsBetween(-(width - 1), 0)
    x = F.when(F.col("z").isNotNull(), F.col("frame"))
    return frames.withColumn("slope", F.covar_pop(x, "z").over(over) / F.nullif(F.var_pop(x).over(over), F.lit(0.0)))


def histogram(values: DataFrame, width: float, by: list[str] = BEAD, column: str = "avg") -> DataFrame:
    """Counts of values in bins of ``width`` from each key's smallest, rounded half to even."""
    low = F.min(column).over(W.partitionBy(*by))
    return values.where(F.col(column).isNotNull()).withColumn("bin", F.rint((F.col(column) - low) / width).cast("bigint")).groupBy(*by, "bin").agg(F.count("*").alias("count"))


def smooth(bins: DataFrame, weights: list[float], by: list[str] = BEAD, value: str = "count") -> DataFrame:
    """Convolution of a histogram with a centred kernel; each bin spreads over its neighbours before bins are summed."""
    half = len(weights) // 2
    spread = F.explode(F.array(*[F.struct((F.col("bin") + i - half).alias("bin"), (F.col(value) * w).alias("w")) for i, w in enumerate(weights)])).alias("s")
    return bins.select(*by, spread).groupBy(*by, F.col("s.bin").alias("bin")).agg(F.sum("s.w").alias("density"))


def cycle_histogram(frames: DataFrame, width: float, least: int = 2) -> DataFrame:
    """Per bin the frames in it, and the cycles with at least ``least`` of them there."""
    bins = frames.where("z is not null").groupBy(*CYCLE, F.floor(F.col("z") / width).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy(*BEAD, "bin").agg(F.sum("n").alias("frames"), F.count_if(F.col("n") >= least).alias("cycles"))


def drift_by_derivate(frames: DataFrame, by: list[str] = BEAD, mode: str = "median") -> DataFrame:
    """Profile per frame of the cycle: the median step over cycles, summed from the right; also how many cycles have it."""
    step = F.lead("z").over(W.partitionBy(*CYCLE).orderBy("frame")) - F.col("z")
    each = frames.withColumn("_s", step).groupBy(*by, "cycleframe").agg((F.median if mode == "median" else F.avg)("_s").alias("_s"), F.count("_s").alias("count"))
    rest = W.partitionBy(*by).orderBy("cycleframe").rowsBetween(0, W.unboundedFollowing)
    return each.select(*by, "cycleframe", (-F.sum(F.coalesce("_s", F.lit(0.0))).over(rest)).alias("profile"), "count")


def drift_profile(events: DataFrame, size: int, collapse: str = "sock", stitching: str = "interpolation", least: int = 10, by: list[str] = BEAD) -> DataFrame:
    """drift(by..., cycleframe, profile, count) from all events of each key, zero at the end's median."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(s), np.asarray(v, float)) for s, v in zip(rows["start"], rows["data"])]
        profile, count = filters.COLLAPSE[collapse](parts, size)
        profile = filters.stitch(profile, count, least, stitching)
        profile = profile - np.median(profile[-10:])
        return pd.DataFrame({**dict(zip(by, key)), "cycleframe": np.arange(size), "profile": profile, "count": count.astype(np.int64)})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields if f.name in by)
    return events.select(*by, "start", "data").groupBy(*by).applyInPandas(run, f"{kinds}, cycleframe bigint, profile double, count bigint")


def cycle_drift(frames: DataFrame, precision: DataFrame, collapse: str = "sock", stitching: str = "interpolation", least: int = 10, by: list[str] = BEAD, **options) -> DataFrame:
    """drift(by..., cycleframe, profile, count) from the events of all phases, placed by the frame in their cycle."""
    per = frames.withColumns({"frame": F.col("cycleframe"), "phase": F.lit(PHASES["measure"])})
    found = detect(per, precision, **options)
    size = frames.agg(F.max("cycleframe")).first()[0]
    return drift_profile(found, 0 if size is None else int(size) + 1, collapse, stitching, least, by)


def remove_drift(frames: DataFrame, profile: DataFrame, by: list[str] = BEAD) -> DataFrame:
    """Frames less the profile at their place in the cycle."""
    return frames.join(profile.select(*by, "cycleframe", "profile"), [*by, "cycleframe"], "left").withColumn("z", F.col("z") - F.coalesce("profile", F.lit(0.0))).select(*frames.columns)


def occupation(events: DataFrame, by: list[str] = BEAD) -> DataFrame:
    """How many events cover each frame of the cycle."""
    return events.select(*by, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("cycleframe")).groupBy(*by, "cycleframe").agg(F.count("*").alias("count"))
