"""Tables that compare beads, hairpins and experiments: matches, orders, statuses, histories and expected positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.functions.signal import complement
from cyclarium.operators.peaks import PEAK, oligo_positions
from cyclarium.operators.selection import as_of, assign_phases, matched, nearest
from cyclarium.operators.statistics import BEAD

FIT = [*BEAD, "hpin"]


def median_threshold(steps: Column, precision: Column, percentile: float = 75.0, distance: float = 2.0) -> Column:
    """An aggregate: a percentile of the steps and some precisions more."""
    return F.percentile(steps, F.lit(percentile / 100)) + distance * precision


def population_threshold(steps: Column, outliers: float = 75.0, deviation: tuple[float, float] = (33.0, 66.0), distance: float = 2.0) -> Column:
    """An aggregate: a percentile of the steps and some of the spans between two others more."""
    low, mid, high = (F.percentile(steps, F.lit(p / 100)) for p in (*deviation, outliers))
    return high + (mid - low) * distance


def match_distance(points: DataFrame, targets: DataFrame, key: list[str], window: float, stretch: float = 1.0, bias: float = 0.0) -> DataFrame:
    """Per key how many points and targets match (see ``matched``), their distance, and its slopes in stretch and bias.

    Targets are placed at target * stretch + bias. The distance is the sum of
    squares over the window's and the number of those without a match; without
    any match it is the number of both and one more.
    """
    placed = targets.select(*key, F.col("target").alias("raw"), (F.col("target") * stretch + bias).alias("target"))
    sizes = points.groupBy(*key).agg(F.count("*").alias("n1")).join(targets.groupBy(*key).agg(F.count("*").alias("n2")), key, "full").na.fill(0)
    off = F.col("position") - F.col("target")
    pairs = matched(points, placed.select(*key, "target"), key, window, first="position").join(placed, [*key, "target"])
    met = pairs.groupBy(*key).agg(F.count("*").alias("nfound"), F.sum(off * off).alias("square"), F.sum(-F.col("raw") * off).alias("slope"), F.sum(-off).alias("shift"))
    rows = sizes.join(met, key, "left").na.fill(0)
    lost = F.col("n1") + F.col("n2")
    found = F.col("nfound") > 0
    return rows.select(
        *key, "nfound",
        F.when(found, lost - 2 * F.col("nfound") + F.col("square") / window**2).otherwise(lost + 1.0).alias("distance"),
        (2 * F.col("slope") / window**2).alias("stretch_slope"),
        (2 * F.col("shift") / window**2).alias("bias_slope"),
    )


def select_best(fits: DataFrame, discarded: list[str] = []) -> DataFrame:
    """Each bead's cheapest fit; beads whose best hairpin is ``discarded`` go."""
    rank = F.row_number().over(W.partitionBy(*BEAD).orderBy("cost", "hpin"))
    return fits.withColumn("_i", rank).where(F.col("_i") == 1).drop("_i").where(~F.col("hpin").isin(*discarded))


def reset_status(identified: DataFrame, distance: float) -> DataFrame:
    """Positives are true again if nearer than ``distance``, else false; others have no closest binding."""
    known = F.col("status").isin("truepos", "falseneg")
    status = F.when(known & (F.abs("distance") < distance), "truepos").when(F.col("status") == "truepos", "falsepos").otherwise(F.col("status"))
    return identified.withColumns({"status": status, "closest": F.when(known, F.col("closest"))})


def axis_order(fits: DataFrame, levels: list[str] = ["hpin", "track", "bead"]) -> DataFrame:
    """Fits with the median cost of each level within the ones before, and their rank by these.

    Costs are summed up per level. Ranks are counted within the innermost groups
    and moved on by the sizes of the groups that come before, which a window
    over the groups (one row each) adds up.
    """
    out = fits
    for i, name in enumerate(levels):
        own = levels[: i + 1]
        out = out.join(fits.groupBy(*own).agg(F.median("cost").alias(f"{name[0]}cost")), own)
    order = [x for n in levels for x in (f"{n[0]}cost", n)]
    inner, outer = levels[:-1], order[:-2]
    sizes = out.groupBy(*dict.fromkeys([*inner, *outer])).agg(F.count("*").alias("_n"))
    before = W.partitionBy(levels[0]).orderBy(*outer).rowsBetween(W.unboundedPreceding, -1)
    moved = sizes.select(*inner, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_moved"))
    rank = F.row_number().over(W.partitionBy(*inner).orderBy(*order))
    return out.join(moved, inner).withColumn("order", (rank + F.col("_moved")).cast("int")).select(*fits.columns, *[f"{n[0]}cost" for n in levels], "order")


def bead_statuses(beads: DataFrame, errors: DataFrame, peaks: DataFrame) -> DataFrame:
    """Per track and status the beads: the error, ``empty`` without peaks, else ``ok``."""
    rows = beads.select(*BEAD).distinct().join(errors.select(*BEAD, "errkey"), BEAD, "left").join(peaks.select(*BEAD, F.lit(True).alias("_any")).distinct(), BEAD, "left")
    status = F.when(F.col("errkey") != "ok", F.col("errkey")).when(F.col("_any"), "ok").otherwise("empty")
    return rows.groupBy("track", status.alias("beadstatus")).agg(F.count("*").alias("beads"))


def duplicate_history(rows: DataFrame, history: DataFrame, key: str = "track") -> DataFrame:
    """Rows once per entry of the history (key, time) of their key, at that time."""
    own = history.select(F.upper("key").alias("_key"), "time")
    return rows.join(own, F.upper(key) == F.col("_key")).withColumns({"modification": F.col("time"), "keep": F.lit(True)}).drop("_key", "time")


def _pure(name: Column) -> Column:
    return name.rlike("(?i)^[atcg]+$")


def reference_track(tracks: DataFrame) -> DataFrame:
    """The first track, by name, that isn't named by bases alone."""
    return tracks.where(~_pure(F.col("track"))).agg(F.min("track").alias("track"))


def track_oligos(tracks: DataFrame) -> DataFrame:
    """(track, oligo) of tracks named by bases: the reverse complement."""
    return tracks.where(_pure(F.col("track"))).select("track", complement(F.lower("track")).alias("oligo")).distinct()


def expected_positions(sequence: DataFrame, oligos: list[str], target: str) -> DataFrame:
    """hpin, oligo, position, strand of the oligos on a sequence (hpin, sequence), whether within the target, and whether expected there."""
    found = oligo_positions(sequence, oligos).select("hpin", "oligo", "position", F.col("orientation").alias("strand"))
    span = oligo_positions(sequence, [target]).groupBy("hpin").agg(F.min("position").alias("_end"))
    inside = F.coalesce((F.col("position") <= F.col("_end")) & (F.col("position") > F.col("_end") - len(target)), F.lit(False))
    return found.join(span, "hpin", "left").withColumn("target", inside).withColumn("expected", F.col("target") & F.col("strand")).drop("_end")


def track_order(tracks: DataFrame, target: str) -> DataFrame:
    """(track, trackorder) by where each track's oligo first stands on the target's reverse complement; the reference track comes first."""
    place = F.instr(complement(F.lower(F.lit(target))), F.lower("track"))
    rows = tracks.select("track").distinct().withColumn("_at", F.when(_pure(F.col("track")), place).otherwise(0)).where((F.col("_at") > 0) | ~_pure(F.col("track")))
    return rows.withColumn("trackorder", F.row_number().over(W.orderBy("_at", "track")) - 1).drop("_at")


def identify_references(peaks: DataFrame, reference: DataFrame, window: float = 10.0) -> DataFrame:
    """Peaks in bases with the nearest position of their track's reference (track, position) and the distance."""
    found = nearest(peaks, reference.select("track", F.col("position").alias("target")), ["track"], window, "peakposition")
    return found.withColumnRenamed("closest", "reference")


def false_positives(identified: DataFrame) -> DataFrame:
    """Peaks without a reference."""
    return identified.where("reference is null").drop("reference", "delta")


def positions_per_peak(events: DataFrame) -> DataFrame:
    """Mean position of each peak's events in each cycle, and their number."""
    return events.groupBy(*PEAK, "cycle").agg(F.avg("avg").alias("position"), F.count("*").alias("events"))


def sigma_peaks(resolution: DataFrame) -> DataFrame:
    """Per bead the median resolution of its peaks."""
    return resolution.groupBy(*BEAD).agg(F.median("resolution").alias("sigmapeaks"))


def quality_series(secondaries: DataFrame, magnet: DataFrame, cycles: DataFrame, names: list[str]) -> DataFrame:
    """(track, cycle, frame, one column per temperature, zmag, vcap) of all places that have any; cycle -1 after the last.

    ``secondaries`` has (track, name, frame, value), ``magnet`` (track, frame,
    zmag, vcap), ``cycles`` (track, cycle, start, stop).
    """
    wide = secondaries.groupBy("track", "frame").pivot("name", names).agg(F.first("value"))
    both = wide.where(F.coalesce(*names).isNotNull()).join(magnet.select("track", "frame", "zmag", "vcap"), ["track", "frame"], "full")
    placed = assign_phases(both.select("track", "frame"), cycles.withColumn("phase", F.lit(0))).select("track", "frame", "cycle")
    return both.join(placed, ["track", "frame"], "left").select("track", F.coalesce("cycle", F.lit(-1)).alias("cycle"), "frame", *names, "zmag", "vcap")


def ramp_data(frames: DataFrame, secondaries: DataFrame, name: str = "zmag") -> DataFrame:
    """Frames with the magnet's position, interpolated between the places where it is known."""
    return as_of(frames, secondaries, name).withColumnRenamed("interpolated", "zmag").drop("latest")
