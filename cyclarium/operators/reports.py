"""Tables for reports, quality control and comparison of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.operators.selection import closest_listed, nearest
from cyclarium.operators.statistics import BEAD


def track_table(frames: DataFrame, status: DataFrame) -> DataFrame:
    """Per track: frames, beads, and how many of them are ok, fixed or otherwise bad, with the lists."""
    sizes = frames.groupBy("track").agg(F.countDistinct("bead").alias("beads"), (F.max("frame") + 1).alias("nframes"))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("bead"))))
    s = F.col("status")
    lists = status.groupBy("track").agg(names(s == "ok").alias("good"), names(s == "fixed").alias("fixed"), names(~s.isin("ok", "fixed")).alias("bad"))
    return sizes.join(lists, "track", "left").withColumns({"ngood": F.size("good"), "nfixed": F.size("fixed"), "nbad": F.size("bad")})


def shares(rows: DataFrame, x: str, y: str, within: str = "x") -> DataFrame:
    """Counts of (x, y) and their percentage among all with that x, or with that y."""
    n = rows.groupBy(x, y).agg(F.count("*").alias("count"))
    return n.withColumn("percent", F.col("count") * 100 / F.sum("count").over(W.partitionBy(x if within == "x" else y)))


def box(rows: DataFrame, x: str, value: str) -> DataFrame:
    """Per x: median, quartiles, whiskers at the outermost values within 1.5 interquartile ranges, and outliers."""
    own = W.partitionBy(x)
    q = {f"q{p}": F.percentile(value, F.lit(p / 100)).over(own) for p in (25, 50, 75)}
    rows = rows.where(F.col(value).isNotNull()).withColumns(q)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return rows.groupBy(x).agg(
        F.first("q25").alias("q25"), F.first("q50").alias("median"), F.first("q75").alias("q75"),
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"),
        F.count_if(~inside).alias("outliers"), F.count("*").alias("count"),
    )


def binned(rows: DataFrame, by: list[str], value: str, step: float) -> DataFrame:
    """Values on a grid about their median: rint((v - median) / step - 1/2) * step + median."""
    middle = F.median(value).over(W.partitionBy(*by))
    return rows.withColumn("binned", F.rint((F.col(value) - middle) / step - 0.5) * step + middle)


def ordered_categories(rows: DataFrame, x: str, value: str, parts: int = 64) -> DataFrame:
    """Categories with their medians, ranked by them.

    Ranges of medians are ranked by themselves and moved by the number of
    categories in the ranges before, so no task holds all categories.
    """
    per = rows.groupBy(x).agg(F.median(value).alias("median"))
    bounds = sorted(set(per.approxQuantile("median", [i / parts for i in range(1, parts)], 0.005)))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("median"))) if bounds else F.lit(0)
    per = per.withColumn("_part", F.when(F.col("median").isNull(), len(bounds) + 1).otherwise(place))
    sizes = per.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_part").orderBy(F.col("median"), F.col(x)))
    return per.withColumn("_own", own).join(F.broadcast(before), "_part").select(x, "median", (F.col("_own") + F.col("_before")).alias("rank"))


def less_reference(rows: DataFrame, key: list[str], reference: str, value: str, by: str = "track") -> DataFrame:
    """Values less the reference track's at the same key; rows of the reference itself go."""
    ref = rows.where(F.col(by) == reference).groupBy(*key).agg(F.avg(value).alias("_r"))
    return rows.where(F.col(by) != reference).join(ref, key, "left").withColumn(value, F.col(value) - F.coalesce("_r", F.lit(0.0))).drop("_r")


def identification_rates(rows: DataFrame, by: list[str], size: str | None = None) -> DataFrame:
    """Per key the share of true positives, false negatives and false positives (column status), and per base of ``size``."""
    n = lambda s: F.count_if(F.col("status") == s)
    total = F.count_if(F.col("status").isin("truepos", "falseneg"))
    out = [n(s).alias(s) for s in ("truepos", "falseneg", "falsepos")] + [(n("truepos") * 100 / F.nullif(total, F.lit(0))).alias("found_percent")]
    if size:
        out.append((n("falsepos") / F.nullif(F.max(size), F.lit(0))).alias("falsepos_per_base"))
    return rows.groupBy(*by).agg(*out)


def quality_table(cleaning: DataFrame) -> DataFrame:
    """Per bead the share of cycles that fail each test (one column each), and the test that fails most."""
    failed = (F.col("testtoolow") | F.col("testtoohigh")).cast("int")
    per = cleaning.groupBy(*BEAD, "testtype").agg((F.avg(failed) * 100).alias("percent"))
    most = per.groupBy(*BEAD).agg(F.max_by("testtype", F.struct("percent", "testtype")).alias("mostcommonerror"), F.max("percent").alias("_m"))
    wide = per.groupBy(*BEAD).pivot("testtype", ["population", "hfsigma", "extent", "pingpong", "phasejump", "saturation"]).agg(F.first("percent"))
    return wide.join(most, BEAD).withColumn("mostcommonerror", F.when(F.col("_m") > 0, F.col("mostcommonerror"))).drop("_m")


def status_pivot(status: DataFrame, names: list[str]) -> DataFrame:
    """Per track the number of beads of each status."""
    return status.groupBy("track").pivot("status", names).agg(F.count(F.lit(1))).na.fill(0)


def status_flow(status: DataFrame, order: str = "modification") -> DataFrame:
    """How many beads go from each status to each from one track to the next."""
    over = W.partitionBy("bead").orderBy(order, "track")
    rows = status.withColumns({"next_track": F.lead("track").over(over), "next_status": F.lead("status").over(over)})
    return rows.where("next_track is not null").groupBy("track", "status", "next_track", "next_status").agg(F.count("*").alias("beads"))


def status_evolution(status: DataFrame, order: str = "modification") -> DataFrame:
    """Share of each status over time, labelled by day and hour."""
    per = status.groupBy(order, "track", "status").agg(F.count("*").alias("beads"))
    return per.withColumns({"percent": F.col("beads") * 100 / F.sum("beads").over(W.partitionBy(order, "track")), "label": F.date_format(order, "dd HH:mm")})


def missing_beads(cleaning: DataFrame, share: float = 90.0, pingpong: float = 10.0) -> DataFrame:
    """Beads that aren't there: noise or population fail in most cycles, or ping-pong in some."""
    failed = F.avg((F.col("testtoolow") | F.col("testtoohigh")).cast("int")) * 100
    per = cleaning.groupBy(*BEAD, "testtype").agg(failed.alias("p"))
    gone = (F.col("testtype").isin("hfsigma", "population") & (F.col("p") >= share)) | ((F.col("testtype") == "pingpong") & (F.col("p") >= pingpong))
    return per.groupBy(*BEAD).agg(F.bool_or(gone).alias("missing"))


def overlapping(one: Column, two: Column, least: int | None = None) -> Column:
    """Whether ``least`` or more bases that end one name begin the other; by default all but one of the shorter name."""
    short = F.least(F.length(one), F.length(two))
    sizes = F.sequence(F.greatest(short - 1 if least is None else F.lit(least), F.lit(1)), short)
    return F.exists(F.when(short >= (1 if least is None else least), sizes).otherwise(F.array().cast("array<int>")), lambda n: (F.right(one, n) == F.left(two, n)) | (F.left(one, n) == F.right(two, n)))


def carry_over(experiments: DataFrame, delta: float = 0.003, ratio: float = 0.5, overlap: int | None = None, by: list[str] = ["bead"]) -> DataFrame:
    """Pairs of peaks, neighbours in position within ``delta`` and of consecutive experiments, that may be left over from one to the other.

    ``experiments`` has (by..., track, oligo, modification, position, count,
    keep). The second's oligo differs from the first's and doesn't overlap it,
    its count is at most ``ratio`` of the first's, and it is to be kept. The
    reverse strands overlap where the oligos do, as either end is tried. Of rows
    that differ in ``keep`` alone the one to be kept stands first.
    """
    columns = [*by, "track", "oligo", "modification", "position", "count", "keep"]
    rows = experiments.select(*columns).distinct()
    rows = rows.withColumn("_t", F.dense_rank().over(W.partitionBy(*by).orderBy("modification")))
    rows = rows.withColumn("_pair", F.explode(F.array(F.col("_t") - 1, F.col("_t"))))
    over = W.partitionBy(*by, "_pair").orderBy("position", "modification", "track", "oligo", "count", F.col("keep").desc())
    pairs = rows.withColumns({f"next_{c}": F.lead(c).over(over) for c in columns[len(by):]})
    close = (F.col("next_position") - F.col("position") < delta) & (F.col("next_modification") != F.col("modification"))
    fewer = F.col("next_count") <= ratio * F.col("count")
    return pairs.where(close & fewer & F.col("next_keep") & (F.col("oligo") != F.col("next_oligo")) & ~overlapping(F.col("oligo"), F.col("next_oligo"), overlap)).drop("_t", "_pair", "keep", "next_keep")


def detections(peaks: DataFrame, theory: DataFrame, *, within: float = 1.0, tolerance: tuple[float, float] = (0.01, 0.01), brother: float = 3.0) -> DataFrame:
    """Each peak (track, peakposition; one row per event, ``avg``) with the nearest position (track, strand, theopos) of each strand.

    A position is detected where at least ``tolerance`` (of the negative and of
    the positive strand) of the peak's events lie ``within`` of it. It binds
    doubly if a position of the other strand is nearer than ``brother``.
    """
    spots = theory.select("track", "strand", "theopos").distinct()
    marks = peaks.select("track", "peakposition").distinct().join(spots.select("track", "strand").distinct(), "track")
    found = closest_listed(marks, spots, ["track", "strand"], "peakposition", "theopos").withColumnRenamed("closest", "theopos")
    other = spots.select("track", F.when(F.col("strand") == "positive", "negative").otherwise("positive").alias("strand"), F.col("theopos").alias("target"))
    double = nearest(spots, other, ["track", "strand"], brother, "theopos").select("track", "strand", "theopos", F.col("closest").isNotNull().alias("doublebinding"))
    near = F.count_if(F.abs(F.col("avg") - F.col("theopos")) <= within)
    groups = peaks.join(found, ["track", "peakposition"]).groupBy("track", "strand", "theopos", "peakposition").agg(F.count("*").alias("estimators"), near.alias("_near"))
    enough = F.col("_near") / F.col("estimators") >= F.when(F.col("strand") == "positive", tolerance[1]).otherwise(tolerance[0])
    rows = groups.join(double, ["track", "strand", "theopos"])
    return rows.select("track", "strand", "theopos", "peakposition", (F.col("peakposition") - F.col("theopos")).alias("dist"), "estimators", "doublebinding", enough.alias("detection"))


def confusion_states(found: DataFrame, theory: DataFrame) -> DataFrame:
    """(track, strand, theopos, state) of all positions: TP or FN on the positive strand, FP or TN on the negative.

    A detected position of the negative strand that binds doubly is a TN.
    """
    per = found.groupBy("track", "strand", "theopos").agg(F.bool_or("detection").alias("hit"), F.bool_or(F.col("detection") & F.col("doublebinding")).alias("double"), F.count("*").alias("estimators"))
    rows = theory.select("track", "strand", "theopos").distinct().join(per, ["track", "strand", "theopos"], "left")
    hit, double = F.coalesce("hit", F.lit(False)), F.coalesce("double", F.lit(False))
    state = F.when(F.col("strand") == "positive", F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit & ~double, "FP").otherwise("TN"))
    return rows.select("track", "strand", "theopos", F.coalesce("estimators", F.lit(0)).alias("estimators"), state.alias("state"))


def confusion(peaks: DataFrame, theory: DataFrame, by: list[str] = ["track"], **options) -> DataFrame:
    """TP, FP, TN and FN per group."""
    states = confusion_states(detections(peaks, theory, **options), theory)
    return states.groupBy(*by).agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("TP", "FP", "TN", "FN")])


def summary_sheet(peaks: DataFrame, precision: DataFrame, cycles: DataFrame) -> DataFrame:
    """Per bead: noise, peaks, valid cycles, events a cycle and mean duration."""
    per = peaks.groupBy(*BEAD).agg(F.count("*").alias("peaks"), F.sum("eventcount").alias("events"), (F.sum(F.col("averageduration") * F.col("eventcount")) / F.sum("eventcount")).alias("downtime"))
    rows = cycles.join(precision, BEAD).join(per, BEAD, "left").na.fill(0, ["peaks", "events"])
    return rows.withColumn("events_per_cycle", F.col("events") / F.col("ncycles"))


def selection(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows that meet all conditions."""
    for c in conditions:
        rows = rows.where(c)
    return rows


def report(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The named columns of a report; write it with ``write_csv``."""
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolon-separated text with a header."""
    rows.write.option("header", True).option("sep", ";").mode("overwrite").csv(path)
