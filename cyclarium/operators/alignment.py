"""Alignment of cycles by their values at phase edges and extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.operators.statistics import BEAD, CYCLE
from cyclarium.sources.fixtures import PHASES


def extremum_bias(frames: DataFrame, mode: str = "min", bins: int = 15) -> DataFrame:
    """bias(track, bead, cycle): less the smallest, largest or middle of medians over bins of frames."""
    per = frames.groupBy(*CYCLE, F.floor(F.col("cycleframe") / bins).alias("_bin")).agg(F.median("z").alias("z"))
    what = {"min": F.min, "max": F.max, "median": F.median}[mode]
    return per.groupBy(*CYCLE).agg((-what("z")).alias("bias"))


def edge_bias(frames: DataFrame, phase: int, edge: str = "left", window: int = 15, percentile: float = 75.0) -> DataFrame:
    """Less a percentile of a phase's first or last ``window`` frames."""
    order = F.col("frame") if edge == "left" else F.col("frame").desc()
    rows = frames.where(F.col("phase") == phase).withColumn("_i", F.row_number().over(W.partitionBy(*CYCLE).orderBy(order)))
    return rows.where(F.col("_i") <= window).groupBy(*CYCLE).agg((-F.percentile("z", F.lit(percentile / 100))).alias("bias"))


def centred(biases: DataFrame) -> DataFrame:
    """Biases less their median over the bead."""
    return biases.withColumn("bias", F.col("bias") - F.median("bias").over(W.partitionBy(*BEAD)))


def translate(frames: DataFrame, biases: DataFrame, drop_missing: bool = True) -> DataFrame:
    """Bias added to each cycle; cycles without one lose their values, or get less the bead's median."""
    rows = frames.join(biases.select(*CYCLE, "bias"), CYCLE, "left")
    bias = F.col("bias") if drop_missing else F.coalesce(F.col("bias"), -F.median("z").over(W.partitionBy(*BEAD)))
    return rows.withColumn("z", F.col("z") + bias).drop("bias")


def relax_outliers(frames: DataFrame, biases: DataFrame, least: float, phase: int = PHASES["relax"]) -> DataFrame:
    """Bias is missing where the relax phase lies below the bead's median by more than its median deviation and ``least``."""
    per = frames.where(F.col("phase") == phase).groupBy(*CYCLE).agg(F.median("z").alias("m"))
    bead = W.partitionBy(*BEAD)
    per = per.withColumn("c", F.median("m").over(bead))
    per = per.withColumn("d", F.median(F.abs(F.col("m") - F.col("c"))).over(bead))
    low = F.coalesce(F.col("m") < F.col("c") - F.col("d") - least, F.lit(False))
    return biases.join(per.select(*CYCLE, low.alias("_low")), CYCLE, "left").withColumn("bias", F.when(~F.coalesce("_low", F.lit(False)), F.col("bias"))).drop("_low")


def edge_statistics(frames: DataFrame, window: int = 15) -> DataFrame:
    """Per cycle the biases at the initial phase's start, the pull phase's end and the measure phase's start."""
    parts = {"initial": edge_bias(frames, PHASES["initial"], "left", window), "pull": edge_bias(frames, PHASES["pull"], "right", window, 25.0), "measure": edge_bias(frames, PHASES["measure"], "left", window)}
    out = frames.select(*CYCLE).distinct()
    for name, biases in parts.items():
        out = out.join(biases.withColumnRenamed("bias", name), CYCLE, "left")
    return out


def best_bias(frames: DataFrame, mode: str = "pull", *, delta: float = 0.2, pull: float = 0.1, opening: float = 0.25, percentile: float = 0.25, window: int = 15, min_population: float = 80.0) -> DataFrame:
    """Each cycle's bias, after the mode, and the tactic that gave it.

    ``onlyinitial`` and ``onlypull`` use that phase. ``initial`` uses the
    initial phase unless it is off its median by ``opening`` or missing, then
    the pull phase. ``pull`` uses the pull phase unless its extent falls short
    of the bead's ``percentile`` by ``delta``, then the initial one; a cycle
    whose pull is further off than ``pull`` below the bead's is dropped.
    """
    bead = W.partitionBy(*BEAD)
    stats = edge_statistics(frames, window)
    own = {c: F.col(c) - F.median(c).over(bead) for c in ("initial", "pull", "measure")}
    stats = stats.withColumn("extent", F.col("initial") - F.col("pull")).withColumns({f"_{c}": x for c, x in own.items()})
    stats = stats.withColumn("_usual", F.percentile("extent", F.lit(percentile)).over(bead))
    short = F.coalesce(F.col("extent") < F.col("_usual") - delta, F.lit(True))
    off = F.coalesce(F.abs("_initial") > opening, F.lit(True))
    dropped = F.coalesce(F.col("_pull") > pull + F.abs("_usual"), F.lit(False))
    tactic = {
        "onlyinitial": F.lit("initial"),
        "onlypull": F.lit("pull"),
        "measure": F.lit("measure"),
        "initial": F.when(off, "pull").otherwise("initial"),
        "pull": F.when(dropped, "drop").when(short, "initial").otherwise("pull"),
    }[mode]
    stats = stats.withColumn("tactic", tactic)
    bias = F.when(F.col("tactic") == "initial", F.col("_initial")).when(F.col("tactic") == "pull", F.col("_pull")).when(F.col("tactic") == "measure", F.col("_measure"))
    out = stats.withColumn("bias", bias)
    share = F.count("bias").over(bead) * 100 / F.count("*").over(bead)
    return out.select(*CYCLE, "bias", "tactic", (share >= min_population).alias("enough"))


def measure_end(frames: DataFrame, last: int = 10, max_distance: float | None = None) -> DataFrame:
    """Each cycle moved so that its last measure frames have mean zero; cycles far off in the relax phase go."""
    back = F.row_number().over(W.partitionBy(*CYCLE, "phase").orderBy(F.col("frame").desc()))
    tail = frames.withColumn("_i", back).where((F.col("phase") == PHASES["measure"]) & (F.col("_i") <= last))
    moved = frames.join(tail.groupBy(*CYCLE).agg(F.avg("z").alias("_m")), CYCLE).withColumn("z", F.col("z") - F.col("_m")).select(*frames.columns)
    if max_distance is None:
        return moved
    relax = moved.where(F.col("phase") == PHASES["relax"]).groupBy(*CYCLE).agg(F.median("z").alias("_r"))
    relax = relax.withColumn("_d", F.abs(F.col("_r") - F.median("_r").over(W.partitionBy(*BEAD))))
    return moved.join(relax.where(F.col("_d") <= max_distance).select(*CYCLE), CYCLE, "left_semi")


def mode_bias(frames: DataFrame, width: float, last: int = 10, percentile: float = 0.05, bins: int = 5) -> DataFrame:
    """Per bead the fullest bin of the last measure values near their 5th percentile; ties go to the lowest bin."""
    back = F.row_number().over(W.partitionBy(*CYCLE, "phase").orderBy(F.col("frame").desc()))
    tail = frames.withColumn("_i", back).where((F.col("phase") == PHASES["measure"]) & (F.col("_i") <= last) & F.col("z").isNotNull())
    tail = tail.withColumn("_p", F.percentile("z", F.lit(percentile)).over(W.partitionBy(*BEAD)))
    tail = tail.withColumn("_bin", F.floor((F.col("z") - F.col("_p")) / width)).where(F.abs("_bin") <= bins)
    counts = tail.groupBy(*BEAD, "_p", "_bin").agg(F.count("*").alias("n"))
    best = counts.groupBy(*BEAD).agg(F.max_by(F.col("_p") + (F.col("_bin") + 0.5) * width, F.struct("n", -F.col("_bin"))).alias("bias"))
    return best
