"""Ramps: opening and closing of molecules as the magnet moves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.functions.signal import extent
from cyclarium.operators.cleaning import Rules, clean
from cyclarium.operators.statistics import BEAD, CYCLE


def with_steps(frames: DataFrame) -> DataFrame:
    """Frames (…, z, zmag) with the steps of z to the next frame, and each cycle's bounds for outlying ones."""
    over = W.partitionBy(*CYCLE).orderBy("frame")
    rows = frames.withColumn("dz", F.lead("z").over(over) - F.col("z"))
    cycle = W.partitionBy(*CYCLE)
    q1, q3 = (F.percentile("dz", F.lit(p)).over(cycle) for p in (0.25, 0.75))
    rows = rows.withColumns({"_q1": q1, "_q3": q3})
    reach = 5 * (F.col("_q3") - F.col("_q1"))
    return rows.withColumns({"opens": F.coalesce(F.col("dz") > F.col("_q3") + reach, F.lit(False)), "closes": F.coalesce(F.col("dz") < F.col("_q1") - reach, F.lit(False))}).drop("_q1", "_q3")


def ramp_stats(frames: DataFrame) -> DataFrame:
    """Per cycle: population, correlation with the magnet, extent, largest step, noise, last opening and first closing."""
    rows = with_steps(frames)
    at = lambda f, flag, what: f(F.when(F.col(flag), F.col(what)), F.when(F.col(flag), F.col("frame")))
    return rows.groupBy(*CYCLE).agg(
        (F.count("z") * 100 / F.count("*")).alias("population"),
        F.corr("z", "zmag").alias("correlation"),
        extent("z").alias("extent"),
        F.max("dz").alias("maxdeltaz"),
        F.median(F.abs("dz")).alias("hfsigma"),
        at(F.max_by, "opens", "frame").alias("iopen"),
        at(F.max_by, "opens", "zmag").alias("zmagopen"),
        at(F.min_by, "closes", "frame").alias("iclose"),
        at(F.min_by, "closes", "zmag").alias("zmagclose"),
    )


def ramp_events(frames: DataFrame, least_zmag: float = -0.8) -> DataFrame:
    """One row per outlying step; neighbouring ones count once, by their first."""
    rows = with_steps(frames).where((F.col("opens") | F.col("closes")) & (F.col("zmag") > least_zmag))
    before = F.lag("frame").over(W.partitionBy(*CYCLE).orderBy("frame"))
    first = rows.withColumn("_new", F.coalesce(F.col("frame") - before > 1, F.lit(True))).where("_new")
    return first.select(*CYCLE, "frame", "zmag", "dz", F.when(F.col("opens"), "open").otherwise("close").alias("kind"))


def ramp_status(stats: DataFrame, *, population: float = 80.0, extension: tuple[float, float, float] = (0.005, 0.05, 5.0), hfsigma: tuple[float, float] = (1e-4, 5e-3), fixed_share: float = 80.0, beads: DataFrame | None = None) -> DataFrame:
    """status(track, bead, status): ok, fixed or bad, from ``ramp_stats``.

    A cycle is good by its noise and population. It is fixed if its largest step
    is under the first extension, or under the second without any opening or
    closing. A bead with good cycles enough is ok if its median extent lies
    between the first and third extension, and fixed if enough of its cycles
    are. Those of ``beads`` (track, bead) without statistics are bad.
    """
    still = F.col("maxdeltaz")
    fixed = (still < extension[0]) | ((still < extension[1]) & F.col("zmagopen").isNull() & F.col("zmagclose").isNull())
    good = (F.col("hfsigma") > hfsigma[0]) & (F.col("hfsigma") < hfsigma[1]) & (F.col("population") > population)
    per = stats.dropna(subset=["extent", "maxdeltaz", "hfsigma", "population"]).groupBy(*BEAD).agg(F.median("extent").alias("extent"), F.avg(good.cast("int")).alias("good"), F.count_if(fixed).alias("fixed"), F.count("*").alias("cycles"))
    enough = F.col("good") > population / 100
    many = F.col("fixed") >= F.least(F.col("good") * F.col("cycles") * fixed_share / 100, F.col("cycles") - 1)
    ok = (F.col("extent") > extension[0]) & (F.col("extent") < extension[2])
    out = per.select(*BEAD, F.when(enough & many, "fixed").when(enough & ok, "ok").otherwise("bad").alias("status"))
    return out if beads is None else beads.select(*BEAD).distinct().join(out, BEAD, "left").na.fill("bad", ["status"])


def ramp_consensus(frames: DataFrame) -> DataFrame:
    """Per bead the way up and the mirrored way down, averaged over cycles, on a scale of 100 at the extent."""
    cycle = W.partitionBy(*CYCLE)
    peak = F.max_by("cycleframe", "zmag").over(cycle)
    rows = frames.withColumn("_d", F.col("cycleframe") - peak)
    folded = rows.select(*CYCLE, F.abs("_d").alias("offset"), F.when(F.col("_d") <= 0, "up").otherwise("down").alias("way"), "z").groupBy(*BEAD, "offset", "way").agg(F.avg("z").alias("z"))
    bead = W.partitionBy(*BEAD)
    low, high = F.min("z").over(bead), F.max("z").over(bead)
    return folded.withColumn("z", (F.col("z") - low) * 100 / F.nullif(high - low, F.lit(0.0)))


def track_consensus(consensus: DataFrame) -> DataFrame:
    """Median over beads at each offset."""
    return consensus.groupBy("track", "offset", "way").agg(F.median("z").alias("z"), F.count("z").alias("beads"))


@dataclass(frozen=True)
class RampAnalysis:
    """Ramps from cleaning to the consensus: what a track's beads do, which of them are of a status, and their mean way.

    ``rules`` clean the frames (track, bead, cycle, frame, cycleframe, phase, z,
    zmag), ``status`` are the options of ``ramp_status``.
    """

    rules: Rules = Rules(extent=(0.0, 10.0), saturated_cycles=100.0)
    status: dict = field(default_factory=dict)

    def cleaned(self, frames: DataFrame) -> DataFrame:
        """Frames of the cycles that pass the rules."""
        return clean(frames, self.rules)

    def dataframe(self, frames: DataFrame) -> DataFrame:
        """The statistics of each cycle with its bead's status; beads without any cycle have one row."""
        stats = ramp_stats(self.cleaned(frames))
        return ramp_status(stats, beads=frames, **self.status).join(stats, BEAD, "left")

    def beads(self, frames: DataFrame, status: str = "ok") -> DataFrame:
        """(track, bead) of a status."""
        return ramp_status(ramp_stats(self.cleaned(frames)), beads=frames, **self.status).where(F.col("status") == status).select(*BEAD)

    def consensus(self, frames: DataFrame, beads: DataFrame | None = None) -> DataFrame:
        """The way up and down over the beads given, or over those that are ok."""
        own = self.beads(frames) if beads is None else beads
        return track_consensus(ramp_consensus(self.cleaned(frames).join(own, BEAD, "left_semi")))
