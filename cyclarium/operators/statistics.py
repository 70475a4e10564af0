"""Signal statistics by bead, cycle and phase."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.functions.signal import MIN_PRECISION, defined, extent, last_defined, median_deviation, percentile
from cyclarium.sources.fixtures import PHASES

BEAD, CYCLE = ["track", "bead"], ["track", "bead", "cycle"]
#: Aggregates by the names that measures go by; each takes a column.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "sum": F.sum,
    "ptp": lambda z: F.max(z) - F.min(z),
    "skew": F.skewness,
    "extent": extent,
    "mediandeviation": median_deviation,
}


def register_measure(name: str, aggregate: Callable[[Column], Column]) -> None:
    """Add an aggregate, built in or a pandas aggregate function, to the measures."""
    MEASURES[name] = aggregate


def measures(frames: DataFrame, by: list[str], **wanted: str) -> DataFrame:
    """One row per key with each named measure of z; "a|b" is a over cycles of b within each cycle."""
    outer, inner = {}, {}
    for name, what in wanted.items():
        first, _, second = what.partition("|")
        if second:
            inner[name] = MEASURES[second](F.col("z"))
            outer[name] = MEASURES[first](F.col(name))
        else:
            outer[name] = None
    if not inner:
        return frames.groupBy(*by).agg(*[MEASURES[w](F.col("z")).alias(n) for n, w in wanted.items()])
    plain = {n: w for n, w in wanted.items() if outer[n] is None}
    nested = frames.groupBy(*dict.fromkeys([*by, "cycle"])).agg(*[c.alias(n) for n, c in inner.items()]).groupBy(*by).agg(*[outer[n].alias(n) for n in inner])
    return nested.join(measures(frames, by, **plain), by) if plain else nested


def steps(frames: DataFrame, by: list[str] = CYCLE) -> DataFrame:
    """Frames with ``dz``, the difference to the last value that isn't missing."""
    frames = frames.withColumn("z", defined(F.col("z")))
    return frames.withColumn("dz", F.col("z") - last_defined("z", W.partitionBy(*by).orderBy("frame")))


def hf_sigma(frames: DataFrame, by: list[str] = CYCLE) -> DataFrame:
    """Median absolute difference of consecutive values: the high-frequency noise."""
    return steps(frames, by).groupBy(*by).agg(F.median(F.abs("dz")).alias("hfsigma"))


def sampled_hf_sigma(frames: DataFrame, sampling: int, by: list[str] = CYCLE) -> DataFrame:
    """Mean over ``sampling`` strided sub-series of their noise."""
    strided = frames.withColumn("stride", F.pmod("frame", F.lit(sampling)))
    return hf_sigma(strided, [*by, "stride"]).groupBy(*by).agg(F.avg("hfsigma").alias("hfsigma"))


def raw_precision(frames: DataFrame, mode: str = "range", *, rate: float = 30.0, first: int = PHASES["initial"], last: int = PHASES["measure"], weights: dict[int, float] | None = None) -> DataFrame:
    """Precision of each bead: over a range of phases, or a weighted sum over single phases (``normalized``)."""
    if mode == "range":
        chosen = frames.where(F.col("phase").between(first, last))
        per = sampled_hf_sigma(chosen, max(1, int(rate / 10 + 0.5)))
        value = F.median("hfsigma")
    else:
        weights = weights or {PHASES["initial"]: 1 / 3, PHASES["pull"]: 1 / 3, PHASES["measure"]: 1 / 3}
        chosen = frames.where(F.col("phase").isin(*weights))
        per = hf_sigma(chosen, [*CYCLE, "phase"]).groupBy(*BEAD, "phase").agg(F.median("hfsigma").alias("hfsigma"))
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        value = F.sum(F.element_at(weight, F.col("phase")) * F.col("hfsigma"))
    return per.groupBy(*BEAD).agg(F.greatest(F.lit(MIN_PRECISION), value).alias("precision"))


def precision(explicit: Column, raw: Column, noise: Column, raw_factor: float = 1.0) -> Column:
    """The explicit precision, else the bead's raw one times a factor, else the data's noise; never below the least."""
    return F.greatest(F.coalesce(explicit, raw * raw_factor, noise), F.lit(MIN_PRECISION))


def bead_extension(frames: DataFrame, first: int = PHASES["initial"], last: int = PHASES["pull"]) -> DataFrame:
    """Median over cycles of the 5-95 % extent in a range of phases."""
    per = frames.where(F.col("phase").between(first, last)).groupBy(*CYCLE).agg(extent("z").alias("extent"))
    return per.groupBy(*BEAD).agg(F.median("extent").alias("extension"))


def phase_position(frames: DataFrame, phase: int) -> DataFrame:
    """Median over cycles of a phase's median."""
    per = frames.where(F.col("phase") == phase).groupBy(*CYCLE).agg(F.median("z").alias("z"))
    return per.groupBy(*BEAD).agg(F.median("z").alias("position"))


def experimental_length(frames: DataFrame) -> DataFrame:
    """Median over cycles of the 1-99 % extent between the phases 1 and 3."""
    per = frames.where(F.col("phase").between(1, 3)).groupBy(*CYCLE).agg((percentile("z", 0.99) - percentile("z", 0.01)).alias("length"))
    return per.groupBy(*BEAD).agg(F.median("length").alias("length"))


def extensions(frames: DataFrame, high: int = PHASES["pull"], low: int = PHASES["initial"]) -> DataFrame:
    """Per cycle the distance between two phases' medians, and centred on its median over the bead."""
    at = lambda p: F.median(F.when(F.col("phase") == p, F.col("z")))
    per = frames.where(F.col("phase").isin(high, low)).groupBy(*CYCLE).agg((at(high) - at(low)).alias("extension"))
    return per.withColumn("centred", F.col("extension") - F.median("extension").over(W.partitionBy(*BEAD)))


def rolling(frames: DataFrame, before: int, after: int, by: list[str] = BEAD) -> DataFrame:
    """Moving mean, extremes and their places, over the given rows before and after; of equal extremes the first is the place."""
    over = W.partitionBy(*by).orderBy("frame").rowsBetween(-before, after)
    known = F.col("z").isNotNull()
    at = lambda f, tie: f(F.when(known, F.col("frame")), F.when(known, F.struct("z", tie))).over(over)
    return frames.withColumns({"mean": F.avg("z").over(over), "low": F.min("z").over(over), "high": F.max("z").over(over), "low_at": at(F.min_by, F.col("frame")), "high_at": at(F.max_by, -F.col("frame"))})


def missing_counts(frames: DataFrame, width: int, by: list[str] = BEAD) -> DataFrame:
    """Missing values among this row and the following ``width - 1``; past the end they count as missing. Also whether there is any."""
    over = W.partitionBy(*by).orderBy("frame").rowsBetween(0, width - 1)
    n = (F.lit(width) - F.count("z").over(over)).cast("bigint")
    return frames.withColumns({"nancount": n, "nanthreshold": n >= 1})


def bin_width(old_rate: float, new_rate: float) -> int:
    """Frames in a bin: the whole number whose rate is nearest to the new one."""
    low = max(1, int(old_rate / new_rate))
    return low + 1 if abs(old_rate / (low + 1) - new_rate) < abs(old_rate / low - new_rate) else low


def undersample(frames: DataFrame, width: int, aggregation: str | None = "mean", cycles: tuple[int, int] | None = None) -> DataFrame:
    """Bins of ``width`` frames: their first value, or an aggregate of the whole bins."""
    if cycles:
        frames = frames.where(F.col("cycle").between(*cycles))
    bins = frames.groupBy(*BEAD, F.floor(F.col("frame") / width).alias("frame"))
    first = F.min_by("cycle", "frame").alias("cycle"), F.min_by("phase", "frame").alias("phase")
    if aggregation is None:
        return bins.agg(*first, F.min_by("z", "frame").alias("z"))
    made = bins.agg(*first, MEASURES[aggregation](F.col("z")).alias("z"), F.count("*").alias("_n"))
    return made.where(F.col("_n") == width).drop("_n")


def good_beads(frames: DataFrame, *, noise: tuple[float, float], population: float, extents: tuple[float, float]) -> DataFrame:
    """Noise, population and extent of each bead, the medians over its cycles, and ok or the first rule that it breaks."""
    per = steps(frames).groupBy(*CYCLE).agg(F.median(F.abs("dz")).alias("hfsigma"), (F.count("z") * 100 / F.count("*")).alias("population"), extent("z").alias("extent"))
    bead = per.groupBy(*BEAD).agg(*[F.median(c).alias(c) for c in ("hfsigma", "population", "extent")], F.count("*").alias("cycles"))
    status = F.when(~F.coalesce(F.col("hfsigma").between(*noise), F.lit(False)), "hfsigma").when(F.col("population") < population, "population").when(~F.coalesce(F.col("extent").between(*extents), F.lit(False)), "extent").otherwise("ok")
    return bead.withColumn("status", status)
