"""Peaks straight from frames, without events first.

Each cycle's values become a histogram in which a position has a height of
about one, however long the cycle stays there. Histograms are moved to agree
with their mean, averaged over the cycles that have the position, and their
maxima are the peaks; frames near a peak are its events. All of it is windows
and aggregates over (track, bead, cycle).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.functions.signal import defined, percentile
from cyclarium.operators.peaks import density_maxima
from cyclarium.operators.statistics import BEAD, CYCLE
from cyclarium.operators.storage import stored
from cyclarium.sources.fixtures import PHASES


@dataclass(frozen=True)
class Projection:
    """Lengths are in units of the precision, but for ``binwidth``'s digits and frames."""

    binwidth: float = 1 / 3
    digits: int = 32
    edges: tuple[float, float] = (0.01, 0.99)
    overshoot: float = 5.0
    step: float = 1.0
    spread: float = 1.0
    least_frames: int = 2
    likeness: float = 1.0
    neighbours: int = 5
    least_cycles: float = 2.0
    smoothing: float = 1.0
    kernel: int = 10
    reach: float = 5.0
    repeats: int = 1
    half: float = 0.8
    threshold: float = 0.05
    distance: float = 2.0
    least_near: int = 2
    density: float = 1.0

    def bins(self, length: float) -> int:
        """A length in bins."""
        return math.floor(length / self.binwidth + 0.5)

    def weights(self) -> list[float]:
        """The smoothing kernel's one side, of sum one with its centre."""
        size = self.bins(self.smoothing)
        raw = [math.exp(-(i**2) / (2 * size**2)) for i in range(self.kernel)]
        return [x / sum(raw) for x in raw]


def digitized(frames: DataFrame, precision: DataFrame, config: Projection = Projection(), phase: int = PHASES["measure"]) -> DataFrame:
    """Frames of the phase with ``digit`` (a fraction of a bin), ``bin``, the bead's ``low`` edge and bin ``width``; null outside."""
    rows = frames.where(F.col("phase") == phase).select(*CYCLE, "frame", defined(F.col("z")).alias("z"))
    per = rows.groupBy(*CYCLE).agg(F.min("z").alias("a"), F.max("z").alias("b"))
    ends = per.groupBy(*BEAD).agg(percentile("a", config.edges[0]).alias("a"), percentile("b", config.edges[1]).alias("b")).join(precision.select(*BEAD, "precision"), BEAD)
    more = config.overshoot * F.col("precision")
    ends = ends.select(*BEAD, "precision", (F.col("a") - more).alias("low"), (F.col("b") - F.col("a") + 2 * more).alias("span"))
    ends = ends.withColumn("nbins", F.floor(F.col("span") / (config.binwidth * F.col("precision")) + 0.5) + 1).withColumn("width", F.col("span") / (F.col("nbins") + 1))
    digit = F.floor((F.col("z") - F.col("low")) / F.col("width") * config.digits + 0.5)
    inside = (digit >= 0) & (F.floor(digit / config.digits) < F.col("nbins"))
    rows = rows.join(ends, BEAD).withColumn("digit", F.when(inside, digit))
    return rows.withColumn("bin", F.floor(F.col("digit") / config.digits)).drop("span")


def cycle_heights(rows: DataFrame, config: Projection = Projection()) -> DataFrame:
    """Per cycle and bin of ``digitized`` frames: the height.

    A frame weighs the inverse of the still frames (those near the mean of
    their neighbours) in its bin and those about it, averaged over the frames
    about it in time by how near their values are.
    """
    order = W.partitionBy(*CYCLE).orderBy("frame")
    before = F.last("digit", True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("digit", True).over(order.rowsBetween(1, W.unboundedFollowing))
    own = F.col("digit")
    still = F.abs(own - (F.coalesce(before, own) + F.coalesce(after, before, own)) / 2) < config.bins(config.step) * config.digits
    size, n = config.bins(config.spread), config.neighbours
    near = F.sum(F.coalesce(F.col("still").cast("int"), F.lit(0))).over(W.partitionBy(*CYCLE).orderBy("bin").rangeBetween(-size, size))
    rows = rows.withColumn("still", still)
    rows = rows.withColumn("weight", F.when(own.isNotNull(), F.when(near >= config.least_frames, 1 / near).otherwise(0.0)))
    place, count = F.row_number().over(order) - 1, F.count(F.lit(1)).over(W.partitionBy(*CYCLE))
    rows = rows.withColumns({"_about": F.collect_list(F.struct("digit", "weight")).over(order.rowsBetween(-n, n)), "_early": F.greatest(F.lit(0), n - place), "_late": F.greatest(F.lit(0), place + n - count + 1)})
    first, last = F.array_repeat(F.element_at("_about", 1), F.col("_early")), F.array_repeat(F.element_at("_about", -1), F.col("_late").cast("int"))
    about = F.filter(F.concat(first, F.col("_about"), last), lambda x: x["digit"].isNotNull())
    like = lambda x: F.exp(-F.pow((x["digit"] - own) * config.bins(config.likeness) / config.digits, 2) / 2)
    total = F.aggregate(about, F.lit(0.0), lambda s, x: s + like(x) * x["weight"]) / F.aggregate(about, F.lit(0.0), lambda s, x: s + like(x))
    return rows.where("digit is not null").withColumn("height", total).groupBy(*CYCLE, "bin").agg(F.sum("height").alias("height"), F.first("low").alias("low"), F.first("width").alias("width"), F.first("precision").alias("precision"))


def mean_heights(heights: DataFrame, config: Projection = Projection(), shifts: DataFrame | None = None) -> DataFrame:
    """Per bead and bin the ``density``: the height over the cycles that have it, both smoothed; cycles moved by (…, cycle, shift) bins."""
    rows = heights.where("height > 0")
    if shifts is not None:
        rows = rows.join(shifts.select(*CYCLE, "shift"), CYCLE, "left").withColumn("bin", F.col("bin") - F.coalesce("shift", F.lit(0)))
    sums = rows.groupBy(*BEAD, "bin").agg(F.sum("height").alias("height"), F.count("*").alias("hits"), F.first("low").alias("low"), F.first("width").alias("width"), F.first("precision").alias("precision"))
    weights = config.weights()
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("by"), F.lit(weights[abs(i)]).alias("w")) for i in range(1 - len(weights), len(weights))])).alias("o")
    keep = ["low", "width", "precision"]
    at = (F.col("bin") + F.col("o.by")).alias("bin")
    ends = [F.first(c).alias(c) for c in keep]
    hits = sums.select(*BEAD, *keep, "bin", "height", "hits", offsets).groupBy(*BEAD, at).agg(F.sum(F.col("hits") * F.col("o.w")).alias("hits"), F.sum(F.when(F.col("o.by") == 0, F.col("height"))).alias("height"), *ends)
    rates = hits.where(F.col("hits") > config.least_cycles).withColumn("rate", F.col("height") / F.col("hits")).where("rate > 0")
    return rates.select(*BEAD, *keep, "bin", "rate", offsets).groupBy(*BEAD, at).agg(F.sum(F.col("rate") * F.col("o.w")).alias("density"), *ends)


def cycle_shifts(heights: DataFrame, means: DataFrame, config: Projection = Projection()) -> DataFrame:
    """shift(track, bead, cycle) in bins at which a cycle's heights agree best with the mean, less the bead's median."""
    hw = config.bins(config.reach)
    moved = heights.select(*CYCLE, "bin", "height", F.explode(F.array(*map(F.lit, range(-hw, hw + 1)))).alias("dx")).withColumn("bin", F.col("bin") - F.col("dx"))
    scores = moved.join(means.select(*BEAD, "bin", "density"), [*BEAD, "bin"]).groupBy(*CYCLE, "dx").agg(F.sum(F.col("height") * F.col("density")).alias("score"))
    best = scores.where("score > 0").groupBy(*CYCLE).agg(F.max_by("dx", F.struct("score", -F.col("dx"))).alias("dx"))
    best = heights.select(*CYCLE).distinct().join(best, CYCLE, "left").withColumn("dx", F.coalesce("dx", F.lit(0)))
    middle = best.groupBy(*BEAD).agg(F.expr("percentile_disc(0.5) within group (order by dx)").alias("middle"))
    return best.join(middle, BEAD).select(*CYCLE, (F.col("dx") - F.col("middle")).cast("int").alias("shift"))


def project(frames: DataFrame, precision: DataFrame, config: Projection = Projection(), phase: int = PHASES["measure"]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mean heights (track, bead, bin, position, density), biases (track, bead, cycle, bias), and peaks (track, bead, peak, peakposition, precision)."""
    # heights are read for each mean, shift and the widths, and shifts for what follows
    heights = stored(cycle_heights(digitized(frames, precision, config, phase), config))
    means, shifts = mean_heights(heights, config), None
    for _ in range(config.repeats):
        shifts = stored(cycle_shifts(heights, means, config))
        means = mean_heights(heights, config, shifts)
    means = stored(means)
    width = heights.groupBy(*CYCLE).agg(F.first("width").alias("width"))
    biases = width.select(*CYCLE, F.lit(0.0).alias("bias")) if shifts is None else shifts.join(width, CYCLE).select(*CYCLE, (F.col("shift") * F.col("width")).alias("bias"))
    position = F.col("bin") * F.col("width") + F.col("low")
    tops = density_maxima(means.withColumn("bin", F.col("bin").cast("int")), config.bins(config.half)).where(F.col("density") > config.threshold)
    peaks = tops.select(*BEAD, (F.row_number().over(W.partitionBy(*BEAD).orderBy("bin")) - 1).alias("peak"), position.alias("peakposition"), "precision")
    return means.select(*BEAD, "bin", position.alias("position"), "density"), biases, peaks


def extract_events(frames: DataFrame, peaks: DataFrame, biases: DataFrame, config: Projection = Projection(), phase: int = PHASES["measure"]) -> DataFrame:
    """peak_events(…, cycle, peak, start, length, avg, bias, peakposition): from the first to the last frame near each peak.

    A frame counts at an end only if ``least_near`` near frames from there on
    span ``density`` times as many frames or more.
    """
    rows = frames.where(F.col("phase") == phase).select(*CYCLE, "frame", defined(F.col("z")).alias("z")).join(biases, CYCLE)
    reach = config.distance * F.col("precision")
    spots = peaks.withColumn("_reach", reach).withColumn("_b", F.explode(F.array(*[F.floor(F.col("peakposition") / F.col("_reach")) + i for i in (-1, 0, 1)])))
    placed = rows.join(peaks.select(*BEAD, reach.alias("_w")).distinct(), BEAD).withColumn("x", F.col("z") - F.col("bias")).withColumn("_b", F.floor(F.col("x") / F.col("_w")))
    near = placed.join(spots, [*BEAD, "_b"]).where(F.abs(F.col("x") - F.col("peakposition")) <= F.col("_reach")).select(*CYCLE, "peak", "peakposition", "bias", "frame")
    order, k = W.partitionBy(*CYCLE, "peak").orderBy("frame"), config.least_near
    wide = lambda a, b: F.coalesce(b - a + 1 >= k * config.density, F.lit(False))
    near = near.withColumns({"_from": wide(F.col("frame"), F.lead("frame", k - 1).over(order)), "_to": wide(F.lag("frame", k - 1).over(order), F.col("frame"))})
    spans = near.groupBy(*CYCLE, "peak").agg(F.min(F.when(F.col("_from"), F.col("frame"))).alias("start"), F.max(F.when(F.col("_to"), F.col("frame"))).alias("_last"), F.first("peakposition").alias("peakposition"), F.first("bias").alias("bias"))
    spans = spans.where("start <= _last")
    inside = rows.drop("bias").join(spans, CYCLE).where(F.col("frame").between(F.col("start"), F.col("_last")))
    return inside.groupBy(*CYCLE, "peak", "peakposition", "bias", "start").agg((F.max("_last") - F.col("start") + 1).alias("length"), F.avg("z").alias("avg")).select(*CYCLE, "peak", "start", "length", "avg", (-F.col("bias")).alias("bias"), "peakposition")


def project_peaks(frames: DataFrame, precision: DataFrame, config: Projection = Projection(), phase: int = PHASES["measure"]) -> DataFrame:
    """Peaks' events by projection."""
    _, biases, peaks = project(frames, precision, config, phase)
    return extract_events(frames, peaks, biases, config, phase)
