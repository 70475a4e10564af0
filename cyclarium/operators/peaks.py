"""Peaks: clustering of events, probabilities, filters, and calling against sequences or references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.functions import expected, fits, mixtures, wavelets
from cyclarium.functions import peaks as kernels
from cyclarium.functions.filters import kernel
from cyclarium.functions.signal import complement
from cyclarium.operators.selection import nearest
from cyclarium.operators.statistics import BEAD, CYCLE

PEAK = [*BEAD, "peak"]


def histogram_peaks(x: np.ndarray, precision: float, finder: str = "maxima") -> np.ndarray:
    """Peaks of the smoothed histogram of values, between bins: its maxima, or the ridges of its ``wavelets``."""
    step, low = precision / 5, x.min() - 4 * precision
    bins = np.bincount(np.rint((x - low) / step).astype(int), minlength=int((x.max() - low) / step) + 40).astype(float)
    density = np.convolve(bins, kernel(), "same")
    at = wavelets.find_peaks(density) if finder == "wavelets" else kernels.local_maxima(density)
    return low + step * kernels.subpixel(density, at)


def select_peaks(events: DataFrame, precision: float | None = None, *, align: bool = False, method: str = "histogram", window: float = 2.5, least: int = 3, base: float | None = 0.1, finder: str = "maxima") -> DataFrame:
    """peak_events(track, bead, cycle, event, start, length, avg, bias, peak, peakposition) from (…, avg[, precision]).

    ``method`` is ``histogram``, ``em`` or ``em_`` and one of the mixtures' methods.
    Peaks with fewer than ``least`` events go, but for the fullest of those within ``base`` of the lowest: the baseline.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cycle", "event"], ignore_index=True)
        z = rows["avg"].to_numpy(float)
        own = precision if precision is not None else float(rows["precision"].iloc[0])
        cycle = rows["cycle"].to_numpy()
        bias = np.zeros(len(z))
        if align:
            names = np.unique(cycle)
            found = kernels.cycle_biases([z[cycle == c] for c in names], own)
            bias = found[np.searchsorted(names, cycle)]
        x = z + bias
        places = histogram_peaks(x, own, finder)
        if method.startswith("em_"):
            places, ids = mixtures.find(x, rows["length"].to_numpy(float), places, method[3:], precision=own, least=least)
            count = np.bincount(ids[ids >= 0], minlength=len(places) or 1)
            ids = np.where((ids >= 0) & (count[np.maximum(ids, 0)] >= least), ids, -1)
        elif method == "em":
            par, resp = kernels.best_mixture(x, rows["length"].to_numpy(float), centres=places, precision=own, least=least)
            ids, places = resp.argmax(axis=1), par[:, 1]
            count = np.bincount(ids, minlength=len(places))
            ids = np.where(count[ids] >= least, ids, -1)
        else:
            ids = kernels.flag(x, places, window * own, least, base)
        known = np.unique(ids[ids >= 0])
        order = known[np.argsort(places[known])]
        number = {int(k): i for i, k in enumerate(order)}
        rows["bias"] = bias
        rows["peak"] = [number.get(int(i), -1) for i in ids]
        mean = pd.Series(x).groupby(rows["peak"]).transform("mean")
        rows["peakposition"] = mean
        return rows[rows["peak"] >= 0][["track", "bead", "cycle", "event", "start", "length", "avg", "bias", "peak", "peakposition"]]

    columns = [*CYCLE, "event", "start", "length", "avg", *(["precision"] if precision is None else [])]
    return events.select(*columns).where("avg is not null").groupBy(*BEAD).applyInPandas(run, "track string, bead bigint, cycle int, event bigint, start bigint, length bigint, avg double, bias double, peak int, peakposition double")


def density_maxima(bins: DataFrame, half: int = 3, by: list[str] = BEAD) -> DataFrame:
    """Bins of (bin, density) that are largest within ``half`` bins, with the parabola's vertex, as window functions."""
    order = W.partitionBy(*by).orderBy("bin")
    top = F.max("density").over(order.rangeBetween(-half, half))
    a, c = F.max("density").over(order.rangeBetween(-1, -1)), F.max("density").over(order.rangeBetween(1, 1))
    bend = a - 2 * F.col("density") + c
    vertex = F.col("bin") + F.when(bend < 0, 0.5 * (a - c) / bend).otherwise(0.0)
    earlier = F.coalesce(F.max("density").over(order.rangeBetween(-half, -1)), F.lit(0.0))
    return bins.withColumns({"_top": top, "_earlier": earlier, "vertex": F.coalesce(vertex, F.col("bin").cast("double"))}).where((F.col("density") == F.col("_top")) & (F.col("density") > F.col("_earlier"))).drop("_top", "_earlier")


#: What a duration without a bound is reported as: the largest 32-bit number.
LARGEST = 3.4028234663852886e38


def probabilities(events: DataFrame, cycles: DataFrame, limits: DataFrame | None = None, *, rate: float = 30.0, least: int = 5, by: list[str] = PEAK) -> DataFrame:
    """Per peak the hybridisation rate, durations and probability of leaving; ``cycles`` has (track, bead, ncycles).

    A cycle's events count as one, from its first start to its last end, which
    is too long if it lies beyond the cycle's ``stop`` in ``limits`` (track,
    bead, cycle, stop). With n such cycles, a share r of them too long, and a
    mean duration d, the probability is that of a geometric law seen from
    ``least`` frames on: (1 - r) / (1 - r + d - least). The likely duration is
    -1 / log(1 - p).
    """
    spans = events.groupBy(*dict.fromkeys([*by, "cycle"])).agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("last"))
    late = F.lit(False)
    if limits is not None:
        spans = spans.join(limits.select(*CYCLE, "stop"), CYCLE, "left")
        late = F.col("last") > F.col("stop")
    per = spans.groupBy(*by).agg(F.count("*").alias("nevents"), F.count_if(late).alias("ntoolong"), F.sum(F.col("last") - F.col("first")).alias("totalduration")).join(cycles, BEAD)
    n, m = F.col("nevents"), 1 - F.col("ntoolong") / F.col("nevents")
    over = m + F.col("totalduration") / n - least
    p = F.when((n > F.col("ntoolong")) & (over > 0), m / over).otherwise(0.0)
    rows = per.withColumns({"probability": p, "stddev": F.when(over > 0, F.sqrt(1 - m / over) / over).otherwise(0.0)})
    log = -F.log(1 - F.col("probability")) * rate
    likely = F.when(F.col("probability") >= 1, 0.0).when(F.col("probability") <= 0, LARGEST).otherwise(1 / log)
    return rows.withColumn("likelyduration", likely).select(
        *by, "nevents", "ncycles", "ntoolong", "totalduration",
        F.least(F.lit(1.0), n / F.col("ncycles")).alias("hybridisationrate"),
        (F.col("totalduration") / n / rate).alias("averageduration"),
        "likelyduration", "probability", "stddev",
        F.least(F.lit(100.0), 100 * F.col("ntoolong") / n).alias("saturation"),
        F.when(n > F.col("ntoolong"), F.col("likelyduration") / F.sqrt(n - F.col("ntoolong"))).otherwise(LARGEST).alias("uncertainty"),
        (least < 1 + (F.col("totalduration") - F.col("ntoolong")) / n).alias("good"),
    )


def resolution(events: DataFrame, by: list[str] = PEAK) -> DataFrame:
    """Per peak the spread over cycles of the length-weighted means, and that over the root of their number; skewness."""
    per = events.groupBy(*dict.fromkeys([*by, "cycle"])).agg((F.sum(F.col("avg") * F.col("length")) / F.sum("length")).alias("m"))
    return per.groupBy(*by).agg(F.stddev_pop("m").alias("resolution"), (F.stddev_pop("m") / F.sqrt(F.count("*"))).alias("positionprecision"), F.skewness("m").alias("skew"))


def peak_values(events: DataFrame, frames: DataFrame) -> DataFrame:
    """(track, bead, peak, cycle, frame, z): the values of each peak's events, met within their cycle."""
    spans = events.select(*PEAK, "cycle", "start", (F.col("start") + F.col("length")).alias("_stop"))
    return frames.select(*CYCLE, "frame", "z").join(spans, CYCLE).where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("_stop"))).select(*PEAK, "cycle", "frame", "z")


def peak_noise(values: DataFrame) -> DataFrame:
    """Per peak ``skew`` and ``peakhfsigma``, the medians over cycles of the skewness and of the noise of its events' values.

    A cycle's events stand in one line; the noise is the median step between
    values that aren't missing. Cycles without a step or a spread don't count.
    """
    key = [*PEAK, "cycle"]
    good = values.where("z is not null")
    rows = good.withColumn("_step", F.abs(F.col("z") - F.lag("z").over(W.partitionBy(*key).orderBy("frame"))))
    per = rows.groupBy(*key).agg(F.when(F.stddev_pop("z") > 1e-12, F.skewness("z")).alias("skew"), F.median("_step").alias("sigma"))
    return per.groupBy(*PEAK).agg(F.median("skew").alias("skew"), F.median("sigma").alias("peakhfsigma"))


def peak_table(events: DataFrame, cycles: DataFrame, rate: float = 30.0) -> DataFrame:
    """One row per peak: position, event count, rates, and its events nested."""
    item = F.struct("cycle", "start", "length", "avg")
    per = events.groupBy(*PEAK).agg(F.first("peakposition").alias("peakposition"), F.count("*").alias("eventcount"), F.avg("length").alias("_d"), F.countDistinct("cycle").alias("_h"), F.array_sort(F.collect_list(item)).alias("events"))
    return per.join(cycles, BEAD).select(*PEAK, "peakposition", "eventcount", (F.col("_h") / F.col("ncycles")).alias("hybridisationrate"), (F.col("_d") / rate).alias("averageduration"), "events")


def baseline_peaks(events: DataFrame, cycles: DataFrame, stops: DataFrame, initial: DataFrame, *, reach: float = 0.015, within: int = 5, share: float = 0.1) -> DataFrame:
    """Per bead the lowest peak near the initial position whose last event of a cycle ends with the phase in many cycles: (track, bead, baseline).

    ``stops`` has the end of the phase (track, bead, cycle, stop), ``initial`` the position (track, bead, position).
    """
    ends = events.groupBy(*PEAK, "cycle").agg(F.max_by(F.col("start") + F.col("length"), "start").alias("_end"), F.first("peakposition").alias("z"))
    rows = ends.join(stops, CYCLE).join(initial, BEAD).join(cycles, BEAD)
    late = F.count_if(F.col("_end") > F.col("stop") - within)
    per = rows.groupBy(*PEAK).agg(F.first("z").alias("z"), F.first("position").alias("p"), F.first("ncycles").alias("n"), late.alias("late"))
    return per.where((F.col("z") <= F.col("p") + reach) & (F.col("late") > share * F.col("n"))).groupBy(*BEAD).agg(F.min("z").alias("baseline"))


def single_strand_peaks(events: DataFrame, open_cycles: DataFrame, starts: DataFrame, *, within: int = 5, share: float = 0.5) -> DataFrame:
    """Per bead the position from which on, from the top, most events begin with the phase in cycles that don't close."""
    rows = events.join(open_cycles, CYCLE, "left_semi").join(starts, CYCLE)
    per = rows.groupBy(*PEAK).agg(F.first("peakposition").alias("z"), F.avg((F.col("start") - F.col("phase_start") < within).cast("int")).alias("early"))
    top = W.partitionBy(*BEAD).orderBy(F.col("z").desc()).rowsBetween(W.unboundedPreceding, 0)
    cut = per.withColumn("_broken", F.max((F.col("early") <= share).cast("int")).over(top)).where("_broken = 0")
    return cut.groupBy(*BEAD).agg(F.min("z").alias("singlestrand"))


def peak_status(peaks: DataFrame, baseline: DataFrame, strand: DataFrame) -> DataFrame:
    """Peaks below, at or above the baseline and the single-strand position."""
    rows = peaks.join(baseline, BEAD, "left").join(strand, BEAD, "left")
    z = F.col("peakposition")
    status = F.when(z < F.col("baseline"), "< baseline").when(z == F.col("baseline"), "baseline").when(z == F.col("singlestrand"), "singlestrand").when(z > F.col("singlestrand"), "> singlestrand").otherwise("")
    return rows.withColumn("status", status).drop("baseline", "singlestrand")


def keep_above_baseline(peaks: DataFrame, baseline: DataFrame, keep: bool = False) -> DataFrame:
    """Peaks above the baseline, with it or without; beads without one keep all."""
    rows = peaks.join(baseline, BEAD, "left")
    z = F.col("peakposition")
    above = z >= F.col("baseline") if keep else z > F.col("baseline")
    return rows.where(F.col("baseline").isNull() | above).drop("baseline")


def oligo_positions(sequences: DataFrame, oligos: list[str], *, name: str = "hpin", sequence: str = "sequence") -> DataFrame:
    """hairpins(hpin, strandsize, oligo, position, orientation): ends of the oligos and of their reverse complements."""
    out = None
    text = F.lower(sequence)
    for oligo in oligos:
        if oligo in ("0", "singlestrand"):
            place = F.lit(0) if oligo == "0" else F.length(sequence)
            rows = sequences.select(F.col(name), F.length(sequence).alias("strandsize"), F.lit(oligo).alias("oligo"), place.alias("position"), F.lit(True).alias("orientation"))
        else:
            n = len(oligo)
            starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
            at = sequences.select(F.col(name), F.length(sequence).alias("strandsize"), text.alias("_t"), F.explode(starts).alias("_i")).withColumn("_s", F.substr("_t", F.col("_i"), F.lit(n)))
            own, other = F.col("_s") == oligo.lower(), F.col("_s") == complement(F.lit(oligo.lower()))
            rows = at.where(own | other).select(name, "strandsize", F.lit(oligo).alias("oligo"), (F.col("_i") + n - 1).alias("position"), own.alias("orientation"))
        out = rows if out is None else out.union(rows)
    return out.distinct()


FITS = "track string, bead bigint, hpin string, cost double, stretch double, bias double"


def fit_hairpins(peaks: DataFrame, hairpins: dict[str, list[float]], method: str = "grid", constraints: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """fits(track, bead, hpin, cost, stretch, bias) of each bead against each of the hairpins, few by nature."""
    theory = {k: np.sort(np.array(v, float)) for k, v in hairpins.items()}
    fit = {"grid": kernels.grid_fit, "gaussian": kernels.gaussian_fit}[method]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(rows["peakposition"].to_numpy(float))
        out = []
        for name, positions in theory.items():
            if constraints and key[1] in constraints:
                s, b = constraints[key[1]]
                cost = kernels.chi_squared(positions, x, s, b)
            else:
                cost, s, b = fit(positions, x)
            out.append((*key, name, cost, s, b))
        return pd.DataFrame(out, columns=["track", "bead", "hpin", "cost", "stretch", "bias"])

    return peaks.select(*BEAD, "peakposition").groupBy(*BEAD).applyInPandas(run, FITS)


def fit_ends(peaks: DataFrame, hairpins: dict[str, tuple[list[float], list[float]]], **options) -> DataFrame:
    """fits(track, bead, hpin, cost, stretch, bias, topbias) of each bead to the lowest and the highest positions of each hairpin."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["peakposition"].to_numpy(float)
        made = ((name, fits.edge_fit(list(ends), x, **options)) for name, ends in hairpins.items())
        out = [(*key, name, cost, stretch, *biases) for name, (cost, stretch, biases) in made]
        return pd.DataFrame(out, columns=["track", "bead", "hpin", "cost", "stretch", "bias", "topbias"])

    return peaks.where("peakposition is not null").select(*BEAD, "peakposition").groupBy(*BEAD).applyInPandas(run, f"{FITS}, topbias double")


def fit_pieces(peaks: DataFrame, hairpins: dict[str, list[list[float]]], **options) -> DataFrame:
    """fits(track, bead, hpin, piece, cost, stretch, bias) of each bead to the pieces of each hairpin."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["peakposition"].to_numpy(float)
        out = [(*key, name, i, *fit) for name, pieces in hairpins.items() for i, fit in enumerate(fits.pieces_fit(pieces, x, **options))]
        return pd.DataFrame(out, columns=["track", "bead", "hpin", "piece", "cost", "stretch", "bias"])

    return peaks.where("peakposition is not null").select(*BEAD, "peakposition").groupBy(*BEAD).applyInPandas(run, FITS.replace("hpin string", "hpin string, piece int"))


def silhouettes(fits: DataFrame) -> DataFrame:
    """Per bead the best hairpin and how far the next is: ((b - a) / max(a, b) - 1/2) * 2, 1 if there is no other."""
    order = W.partitionBy(*BEAD).orderBy("cost", "hpin")
    rows = fits.withColumns({"_i": F.row_number().over(order), "_next": F.lead("cost").over(order)}).where("_i = 1")
    value = ((F.col("_next") - F.col("cost")) / F.nullif(F.greatest("cost", "_next"), F.lit(0.0)) - 0.5) * 2
    return rows.select(*BEAD, "hpin", "cost", "stretch", "bias", F.when(F.col("_next").isNull(), 1.0).otherwise(F.coalesce(value, F.lit(-1.0))).alias("silhouette"))


def beads_by_hairpin(fits: DataFrame, least: float = -3.0) -> DataFrame:
    """Beads ranked by silhouette within their best hairpin; those below ``least`` in a group of their own."""
    best = silhouettes(fits).withColumn("hpin", F.when(F.col("silhouette") < least, "✗").otherwise(F.col("hpin")))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("track", "hpin").orderBy(F.col("silhouette").desc(), "bead")))


def identify(peaks: DataFrame, fits: DataFrame, hairpins: DataFrame, window: float = 10.0) -> DataFrame:
    """Peaks in bases with the nearest position of their bead's hairpin, the distance, and the strand."""
    bases = peaks.join(fits.select(*BEAD, "hpin", "stretch", "bias"), BEAD).withColumn("position", (F.col("peakposition") - F.col("bias")) * F.col("stretch"))
    targets = hairpins.select("hpin", F.col("position").cast("double").alias("target")).distinct()
    found = nearest(bases, targets, ["hpin"], window)
    strand = hairpins.groupBy("hpin", F.col("position").cast("double").alias("closest")).agg(F.max("orientation").alias("orientation"))
    return found.join(strand, ["hpin", "closest"], "left")


def to_reference(peaks: DataFrame, stretch: Column, bias: Column) -> DataFrame:
    """Positions on the reference's scale."""
    return peaks.withColumn("peakposition", (F.col("peakposition") - bias) * stretch)


def fit_reference(peaks: DataFrame, reference: DataFrame, spread: float = 0.1, bias: tuple[float, float] = (-20.0, 20.0), window: float = 5.0) -> DataFrame:
    """Stretch and bias of each bead onto the same bead of a reference table (bead, peakposition)."""

    def run(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame(columns=["track", "bead", "cost", "stretch", "bias"])
        out = []
        for track, rows in one.groupby("track"):
            out.append((track, key[0], *kernels.grid_fit(two["peakposition"].to_numpy(float), rows["peakposition"].to_numpy(float), 1.0, spread, bias, window)))
        return pd.DataFrame(out, columns=["track", "bead", "cost", "stretch", "bias"])

    return peaks.select(*BEAD, "peakposition").groupBy("bead").cogroup(reference.select("bead", "peakposition").groupBy("bead")).applyInPandas(run, "track string, bead bigint, cost double, stretch double, bias double")


def correlation_biases(events: DataFrame, precision: float, by: list[str] = BEAD) -> DataFrame:
    """bias(track, bead, cycle) at which each cycle's events agree best with those of all cycles."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(rows["cycle"])
        bias = kernels.cycle_biases([rows.loc[rows["cycle"] == c, "avg"].to_numpy(float) for c in names], precision)
        return pd.DataFrame({"track": rows["track"].iloc[0], "bead": rows["bead"].iloc[0], "cycle": names, "bias": bias})

    return events.where("avg is not null").select(*CYCLE, "avg").groupBy(*by).applyInPandas(run, "track string, bead bigint, cycle int, bias double")


def expected_biases(events: DataFrame, precision: float, by: list[str] = BEAD, **options) -> DataFrame:
    """bias(track, bead, cycle) at which each cycle's events stand where those of the other cycles expect them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(rows["cycle"].to_numpy(), return_inverse=True)
        z = rows["avg"].to_numpy(float)
        order = np.lexsort((z, code))
        bias = expected.expected_biases(np.split(z[order], np.cumsum(np.bincount(code))[:-1]), precision, **options)
        return pd.DataFrame({"track": rows["track"].iloc[0], "bead": rows["bead"].iloc[0], "cycle": names, "bias": bias})

    return events.where("avg is not null").select(*CYCLE, "avg").groupBy(*by).applyInPandas(run, "track string, bead bigint, cycle int, bias double")


def move_events(events: DataFrame, biases: DataFrame) -> DataFrame:
    """Events with their cycle's bias added to ``avg``; peaks' positions become the means of their events."""
    rows = events.drop("bias").join(biases.select(*CYCLE, "bias"), CYCLE, "left").withColumn("bias", F.coalesce("bias", F.lit(0.0)))
    rows = rows.withColumn("avg", F.col("avg") + F.col("bias"))
    return rows.withColumn("peakposition", F.avg("avg").over(W.partitionBy(*PEAK))) if "peakposition" in events.columns else rows


def peak_biases(events: DataFrame, method: str = "minbias") -> DataFrame:
    """bias(track, bead, cycle) from the events of each peak, by turns of means or by least squares."""
    per = events.groupBy(*PEAK, "cycle").agg(F.avg("avg").alias("m"), F.count("*").alias("w"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        means, weights = (rows.pivot(index="peak", columns="cycle", values=c) for c in ("m", "w"))
        w = weights.fillna(0).to_numpy(float)
        bias = (kernels.min_bias if method == "minbias" else kernels.least_squares_bias)(w, means.to_numpy(float))
        return pd.DataFrame({"track": rows["track"].iloc[0], "bead": rows["bead"].iloc[0], "cycle": means.columns, "bias": bias})

    return per.groupBy(*BEAD).applyInPandas(run, "track string, bead bigint, cycle int, bias double")
