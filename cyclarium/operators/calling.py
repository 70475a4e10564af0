"""Beads called against hairpins: which peaks bind where, and how well each hairpin explains a bead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.operators.events import smooth
from cyclarium.operators.peaks import density_maxima
from cyclarium.operators.selection import closest, closest_listed, nearest
from cyclarium.operators.statistics import BEAD

FIT = [*BEAD, "hpin"]
#: Measures of peaks of which the fits table has the medians.
MEASURED = ("averageduration", "hybridisationrate", "eventcount")


def identified_peaks(peaks: DataFrame, fits: DataFrame, hairpins: DataFrame, window: float = 10.0) -> DataFrame:
    """Per bead, hairpin and peak: the position in bases, the nearest binding, the distance to it, its strand and the status.

    ``peaks`` has (track, bead, peak, peakposition, status, ...), ``hairpins``
    (hpin, strandsize, position, orientation). A status that is not empty stays.
    """
    rows = peaks.join(fits.select(*FIT, "stretch", "bias"), BEAD).withColumn("baseposition", (F.col("peakposition") - F.col("bias")) * F.col("stretch"))
    strands = hairpins.groupBy("hpin", F.col("position").cast("double").alias("closest")).agg(F.min("orientation").alias("_plus"))
    found = closest_listed(rows, strands.withColumnRenamed("closest", "target"), ["hpin"], "baseposition").join(strands, ["hpin", "closest"], "left")
    distance = F.col("closest") - F.col("baseposition")
    status = F.when(F.col("status") != "", F.col("status")).when(F.abs(distance) < window, "truepos").otherwise("falsepos")
    strand = F.when(F.col("_plus"), "+").when(~F.col("_plus"), "-").otherwise("")
    return found.withColumns({"distance": distance, "orientation": strand, "status": status}).drop("_plus")


def missing_bindings(identified: DataFrame, fits: DataFrame, hairpins: DataFrame) -> DataFrame:
    """Rows of status falseneg for the bindings of each fit that no true positive has."""
    found = identified.where("status = 'truepos'").select(*FIT, "closest").distinct()
    every = fits.select(*FIT, "stretch", "bias").join(hairpins.select("hpin", F.col("position").cast("double").alias("closest"), F.when(F.col("orientation"), "+").otherwise("-").alias("orientation")).distinct(), "hpin")
    lost = every.join(found, [*FIT, "closest"], "left_anti")
    return lost.select(*FIT, (F.col("closest") / F.col("stretch") + F.col("bias")).alias("peakposition"), F.col("closest").alias("baseposition"), "closest", "orientation", F.lit(0).cast("bigint").alias("eventcount"), F.lit(0.0).alias("hybridisationrate"), F.lit("falseneg").alias("status"))


def _matches(rows: DataFrame, value: str, window: float, name: str) -> DataFrame:
    """Counts of ``rows`` with a closest one within the window, and the median squared distance."""
    off = F.col("closest") - F.col(value)
    good = F.abs(off) < window
    unique = F.count_distinct(F.when(good, F.col("closest")))
    return rows.groupBy(*FIT).agg(
        F.count_if(good).alias(f"{name}affected"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias(f"{name}nonaffected"),
        (F.count(F.lit(1)) - unique).alias(f"{name}duplicates"),
        unique.alias(f"{name}truepos"),
        F.median(F.when(good, off * off)).alias(f"{name}residuals"),
    )


def fits_table(peaks: DataFrame, fits: DataFrame, hairpins: DataFrame, noise: DataFrame, window: float = 10.0, hpin_window: float | None = None, oligos: list[str] = [], with_peaks: bool = False) -> DataFrame:
    """One row per bead and hairpin: the fit, counts of matches both ways, medians of true and false positives, and the peaks if asked for."""
    own = identified_peaks(peaks, fits, hairpins, window)
    sizes = hairpins.groupBy("hpin").agg(F.max("strandsize").alias("strandsize"), F.count_distinct("position").alias("nbindings"))
    medians = [F.median(F.when(F.col("status") == s, F.col(c))).alias(f"{k}{c}") for k, s in (("tp", "truepos"), ("fp", "falsepos")) for c in MEASURED]
    item = F.struct("peakposition", *MEASURED[:2], "status", "orientation", "baseposition", "closest", "distance")
    nested = [F.array_sort(F.collect_list(item)).alias("peaks")] if with_peaks else []
    exp = _matches(own, "baseposition", window, "exp").join(own.groupBy(*FIT).agg(F.count("*").alias("nblockages"), *medians, *nested), FIT)
    every = fits.select(*FIT).join(hairpins.select("hpin", F.col("position").cast("double").alias("position")).distinct(), "hpin")
    back = closest(every, own.select(*FIT, F.col("baseposition").alias("target")), FIT)
    out = fits.join(sizes, "hpin").join(noise.select(*BEAD, "hfsigma"), BEAD, "left").join(exp, FIT, "left").join(_matches(back, "position", window if hpin_window is None else hpin_window, "hpin"), FIT, "left")
    return out.withColumns({"nblockages": F.coalesce("nblockages", F.lit(0)), "expfalseneg": F.col("nbindings") - F.coalesce("exptruepos", F.lit(0)), "oligo": F.lit(",".join(oligos))})


GROUP = ["track", "hpin"]


def group_consensus(identified: DataFrame, width: float, kernel: list[float], half: int = 2, window: float = 10.0) -> DataFrame:
    """(track, hpin, consensus, position, beads, share, and means and spreads of measures): the peaks that a hairpin's beads share.

    The density of all beads' positions in bases, in bins of ``width`` and
    smoothed, has a consensus peak at each maximum within ``half`` bins.
    Positions belong to the nearest one within ``window``; a bead with several
    counts once in ``beads`` and in ``share``, the percentage of the hairpin's beads.
    """
    measures = [c for c in ("baseposition", *MEASURED) if c in identified.columns]
    rows = identified.where("baseposition is not null").select(*GROUP, "bead", *measures)
    low = rows.groupBy(*GROUP).agg(F.min("baseposition").alias("low"), F.count_distinct("bead").alias("_all"))
    bins = rows.join(low, GROUP).groupBy(*GROUP, F.rint((F.col("baseposition") - F.col("low")) / width).cast("bigint").alias("bin")).agg(F.count("*").alias("count"))
    density = smooth(bins, kernel, GROUP).withColumn("density", F.round("density", 9))
    tops = density_maxima(density.withColumn("bin", F.col("bin").cast("int")), half, GROUP).join(low, GROUP)
    spots = tops.select(*GROUP, (F.col("vertex") * width + F.col("low")).alias("target"))
    met = nearest(rows, spots, GROUP, window, "baseposition").where("closest is not null")
    stats = [f(c).alias(f"{c}{n}") for c in measures for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    out = met.groupBy(*GROUP, F.col("closest").alias("position")).agg(F.count_distinct("bead").alias("beads"), *stats).join(low, GROUP)
    rank = F.row_number().over(W.partitionBy(*GROUP).orderBy("position")) - 1
    return out.withColumns({"consensus": rank, "share": F.col("beads") * 100 / F.col("_all")}).drop("low", "_all")
