"""Selecting and reshaping tracks, beads, cycles and frames, and the joins between their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.operators.statistics import BEAD, CYCLE


def selecting(frames: DataFrame, keys: DataFrame | list, on: str | list[str] = "bead") -> DataFrame:
    """Rows whose key is among ``keys``: a list of values, or a table for compound keys."""
    return frames.where(F.col(on).isin(*keys)) if isinstance(keys, list) else frames.join(keys, on, "left_semi")


def discarding(frames: DataFrame, keys: DataFrame | list, on: str | list[str] = "bead") -> DataFrame:
    """Rows whose key is not among ``keys``."""
    return frames.where(~F.col(on).isin(*keys)) if isinstance(keys, list) else frames.join(keys, on, "left_anti")


def with_phases(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Frames of the phases from ``first`` to ``last``."""
    return frames.where(F.col("phase").between(first, last))


def with_cycles(frames: DataFrame, start: int, stop: int) -> DataFrame:
    """Frames of the cycles from ``start``, before ``stop``."""
    return frames.where((F.col("cycle") >= start) & (F.col("cycle") < stop))


def with_samples(frames: DataFrame, start: int, step: int) -> DataFrame:
    """Every ``step``-th frame from ``start`` on."""
    return frames.where((F.col("frame") >= start) & ((F.col("frame") - start) % step == 0))


def with_function(frames: DataFrame, function) -> DataFrame:
    """z replaced by a column expression of it, or by a pandas UDF."""
    return frames.withColumn("z", function(F.col("z")))


def phase_table(frames: DataFrame) -> DataFrame:
    """phases(track, cycle, phase, start, stop); stop is exclusive."""
    return frames.groupBy("track", "cycle", "phase").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"))


def assign_phases(values: DataFrame, phases: DataFrame, width: int = 64) -> DataFrame:
    """(track, frame, ...) with the cycle and phase that hold each frame: a range join on buckets of ``width`` frames."""
    bucket = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("_bucket")
    spread = phases.select("track", "cycle", "phase", "start", "stop", bucket)
    rows = values.withColumn("_bucket", F.floor(F.col("frame") / width))
    return rows.join(spread, ["track", "_bucket"]).where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop"))).drop("_bucket", "start", "stop")


def sample_cycles(frames: DataFrame, cycles: list[int]) -> DataFrame:
    """A track of the listed cycles alone, frames and cycles numbered anew."""
    rows = frames.where(F.col("cycle").isin(*cycles))
    bead = W.partitionBy(*BEAD)
    return rows.withColumns({"frame": (F.row_number().over(bead.orderBy("frame")) - 1), "cycle": F.dense_rank().over(bead.orderBy("cycle")) - 1})


def rename_beads(frames: DataFrame, names: dict[int, int]) -> DataFrame:
    """Beads renamed by a mapping; others keep their names."""
    to = F.create_map(*[F.lit(x).cast("bigint") for pair in names.items() for x in pair])
    return frames.withColumn("bead", F.coalesce(F.element_at(to, F.col("bead").cast("bigint")), F.col("bead")))


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second track's frames and cycles after the first's; beads of one track alone are missing in the other."""
    ends = first.groupBy("track").agg((F.max("frame") + 1).alias("_f"), (F.max("cycle") + 1).alias("_c"))
    starts = second.groupBy("track").agg(F.min("frame").alias("_g"))
    moved = second.join(ends, "track").join(starts, "track").withColumns({"frame": F.col("frame") - F.col("_g") + F.col("_f"), "cycle": F.col("cycle") + F.col("_c")}).select(*first.columns)
    both = first.unionByName(moved)
    places = both.select("track", "frame", "cycle", "cycleframe", "phase").distinct()
    grid = places.join(both.select(*BEAD).distinct(), "track")
    return grid.join(both.select(*BEAD, "frame", "z"), [*BEAD, "frame"], "left").select(*first.columns)


def common_beads(frames: DataFrame, tracks: int | None = None) -> DataFrame:
    """Beads that all tracks have."""
    n = tracks if tracks is not None else frames.agg(F.countDistinct("track")).first()[0]
    return frames.groupBy("bead").agg(F.countDistinct("track").alias("n")).where(F.col("n") == n).select("bead")


def available_beads(frames: DataFrame) -> DataFrame:
    return frames.select("bead").distinct()


def common_tracks(frames: DataFrame, beads: list[int]) -> DataFrame:
    """Tracks that have all of the beads."""
    return frames.where(F.col("bead").isin(*beads)).groupBy("track").agg(F.countDistinct("bead").alias("n")).where(F.col("n") == len(set(beads))).select("track")


def track_counts(beads: DataFrame) -> DataFrame:
    """(track, bead) with the number of tracks that have the bead."""
    return beads.select(*BEAD).distinct().withColumn("trackcount", F.count("*").over(W.partitionBy("bead")))


def tagged(frames: DataFrame, tags: DataFrame, names: list[str], keep: bool = True) -> DataFrame:
    """Beads that have one of the tags (track, bead, tag), or none of them."""
    chosen = tags.where(F.col("tag").isin(*names)).select(*BEAD)
    return frames.join(chosen, BEAD, "left_semi" if keep else "left_anti")


def compare_events(events: DataFrame, condition: Column, how: str = "any") -> DataFrame:
    """(track, bead, cycle) keys of which any or all events meet the condition."""
    met = {"any": F.bool_or, "all": F.bool_and}[how](condition)
    return events.groupBy(*CYCLE).agg(met.alias("met")).where("met").select(*CYCLE)


def matching_names(tracks: DataFrame, pattern: str | None = None, weak: int | None = None, strong: int | None = None) -> DataFrame:
    """Tracks whose names match, or have so many weak (a, t) and strong (g, c) bases."""
    if pattern:
        tracks = tracks.where(F.col("track").rlike(pattern))
    count = lambda bases: F.length("track") - F.length(F.regexp_replace("track", f"[{bases}]", ""))
    if weak is not None:
        tracks = tracks.where(count("atAT") == weak)
    if strong is not None:
        tracks = tracks.where(count("gcGC") == strong)
    return tracks


def least_common_names(tracks: DataFrame) -> DataFrame:
    """Names without the tokens (between underscores) that all names have; ``ref`` if nothing is left."""
    own = tracks.select("track").distinct().withColumn("tokens", F.split("track", "_"))
    total = own.agg(F.count("*").alias("n"))
    shared = own.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("k")).join(F.broadcast(total), F.col("k") == F.col("n")).agg(F.collect_set("token").alias("shared"))
    named = own.withColumn("_one", F.lit(1)).join(shared.withColumn("_one", F.lit(1)), "_one")
    left = F.array_join(F.filter("tokens", lambda t: ~F.array_contains("shared", t)), "_")
    return named.select("track", F.when(left == "", "ref").otherwise(left).alias("name"))


def to_nanometres(beads: DataFrame, slope: tuple[float, float], bias: tuple[float, float]) -> DataFrame:
    """Pixel positions by an affine map per axis."""
    return beads.withColumns({"x": F.col("x") * slope[0] + bias[0], "y": F.col("y") * slope[1] + bias[1]})


def view_status(beads: DataFrame) -> DataFrame:
    """One status from flags: missing, discarded, bad, fixed, else ok."""
    status = F.when(F.col("missing"), "missing").when(F.col("discarded"), "discarded").when(F.col("bad"), "bad").when(F.col("fixed"), "fixed").otherwise("ok")
    return beads.withColumn("status", status)


def override_cycles(frames: DataFrame, overrides: DataFrame) -> DataFrame:
    """Beads with overrides (track, bead, frame, z) have these values alone, missing elsewhere; others keep theirs."""
    beads = overrides.select(*BEAD).distinct().withColumn("_over", F.lit(True))
    new = overrides.select(*BEAD, "frame", F.col("z").alias("_z"))
    rows = frames.join(beads, BEAD, "left").join(new, [*BEAD, "frame"], "left")
    return rows.withColumn("z", F.when(F.col("_over"), F.col("_z")).otherwise(F.col("z"))).select(*frames.columns)


def as_of(frames: DataFrame, secondaries: DataFrame, name: str, width: int = 64) -> DataFrame:
    """The secondary series' latest value at or before each frame, and its linear interpolation.

    Values are those of the track, whether or not a bead has their frames; of
    several at one frame the largest counts. Before the first value there is no
    latest one, and the interpolation stays at the first or the last beyond
    them. Spans between values meet frames in buckets of ``width`` frames.
    """
    own = secondaries.where((F.col("name") == name) & F.col("value").isNotNull()).groupBy("track", F.col("frame").alias("_f0")).agg(F.max("value").alias("_v0"))
    order = W.partitionBy("track").orderBy("_f0")
    spans = own.withColumns({"_f1": F.lead("_f0").over(order), "_v1": F.lead("_v0").over(order)}).where("_f1 is not null")
    buckets = F.explode(F.sequence(F.floor(F.col("_f0") / width), F.floor((F.col("_f1") - 1) / width))).alias("_bucket")
    spread = spans.select(F.col("track").alias("_track"), "_f0", "_v0", "_f1", "_v1", buckets)
    ends = own.groupBy("track").agg(F.min_by("_v0", "_f0").alias("_first"), F.max("_f0").alias("_end"), F.max_by("_v0", "_f0").alias("_last"))
    at, bucket = F.col("frame"), F.floor(F.col("frame") / width)
    within = (F.col("track") == F.col("_track")) & (bucket == F.col("_bucket")) & (at >= F.col("_f0")) & (at < F.col("_f1"))
    rows = frames.join(spread, within, "left").join(ends, "track", "left")
    latest = F.coalesce("_v0", F.when(at >= F.col("_end"), F.col("_last")))
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (at - F.col("_f0")) / (F.col("_f1") - F.col("_f0"))
    return rows.withColumns({"latest": latest, "interpolated": F.coalesce(between, latest, "_first")}).select(*frames.columns, "latest", "interpolated")


def wide_beads(frames: DataFrame, beads: list[int]) -> DataFrame:
    """One column per bead: (track, frame, b1, b2, ...)."""
    return frames.where(F.col("bead").isin(*beads)).groupBy("track", "frame").pivot("bead", beads).agg(F.first("z")).select("track", "frame", *[F.col(str(b)).alias(f"b{b}") for b in beads])


def nearest(points: DataFrame, targets: DataFrame, key: list[str], window: float, value: str = "position", target: str = "target") -> DataFrame:
    """Each point with the nearest target of its key within ``window`` (NULL without one) and the difference.

    Both sides meet in buckets as wide as the window, so no key's points and
    targets are all paired.
    """
    bucket = lambda c: F.floor(F.col(c) / window)
    near = targets.select(*key, target, F.explode(F.array(*[bucket(target) + i for i in (-1, 0, 1)])).alias("_b"))
    met = points.withColumn("_b", bucket(value)).join(near, [*key, "_b"]).where(F.abs(F.col(value) - F.col(target)) < window)
    best = met.groupBy(*key, value).agg(F.min_by(target, F.struct(F.abs(F.col(value) - F.col(target)), F.col(target))).alias("closest"))
    return points.join(best, [*key, value], "left").withColumn("delta", F.col(value) - F.col("closest"))


def closest(points: DataFrame, targets: DataFrame, key: list[str], value: str = "position", target: str = "target") -> DataFrame:
    """Each point with the nearest target of its key, however far; of two at the same distance the larger.

    Points and targets of a key stand in one line, and each point looks to both sides.
    """
    marks = points.select(*key, F.col(value).alias("_x")).where("_x is not null").distinct().withColumn("_t", F.lit(None).cast("double"))
    spots = targets.select(*key, F.col(target).cast("double").alias("_x")).where("_x is not null").distinct()
    line = marks.union(spots.select(*key, "_x", F.col("_x").alias("_t")))
    order = W.partitionBy(*key).orderBy("_x")
    low = F.last("_t", True).over(order.rangeBetween(W.unboundedPreceding, 0))
    high = F.first("_t", True).over(order.rangeBetween(0, W.unboundedFollowing))
    found = F.when(high.isNull() | (F.col("_x") - low < high - F.col("_x")), low).otherwise(high)
    near = line.withColumn("closest", found).where("_t is null").select(*key, F.col("_x").alias(value), "closest")
    return points.join(near, [*key, value], "left")


def closest_listed(points: DataFrame, targets: DataFrame, key: list[str], value: str = "position", target: str = "target") -> DataFrame:
    """The same as ``closest`` where a key's targets are few and its points may be any share of all rows.

    A key's targets travel as one list to each point, which looks through it;
    points of a key needn't meet in one task.
    """
    lists = targets.groupBy(*key).agg(F.collect_set(F.col(target).cast("double")).alias("_spots"))
    x = F.col(value)
    best = F.array_min(F.transform("_spots", lambda t: F.struct(F.abs(x - t).alias("far"), (-t).alias("less"))))
    return points.join(lists, key, "left").withColumn("closest", F.when(x.isNotNull(), -best["less"])).drop("_spots")


def exclusive(nearest_rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the points with the same closest target only the nearest keeps it."""
    rank = F.row_number().over(W.partitionBy(*key, "closest").orderBy(F.abs("delta"), "position"))
    keep = (rank == 1) & F.col("closest").isNotNull()
    return nearest_rows.withColumn("_keep", keep).withColumns({"closest": F.when(F.col("_keep"), F.col("closest")), "delta": F.when(F.col("_keep"), F.col("delta"))}).drop("_keep")


def mutual(points: DataFrame, targets: DataFrame, key: list[str], window: float) -> DataFrame:
    """One-to-one matches: each is the other's nearest within the window."""
    one = nearest(points, targets, key, window).where("closest is not null").select(*key, "position", F.col("closest").alias("target"))
    two = nearest(targets.withColumnRenamed("target", "_t"), points.withColumnRenamed("position", "target"), key, window, "_t").where("closest is not null").select(*key, F.col("_t").alias("target"), F.col("closest").alias("position"))
    return one.join(two, [*key, "position", "target"])


def matched(points: DataFrame, targets: DataFrame, key: list[str], window: float, first: str = "target") -> DataFrame:
    """One-to-one pairs (position, target): in chains where both lists alternate, the closest neighbours first.

    Both lists of a key stand in one line. A chain goes on while the next one
    is of the other list and no more than ``window`` away. Of a chain's pairs of
    neighbours the closest is taken (the first of equally close ones), then the
    closest of those with two free ends, and so on. That is the same as
    counting along falling distances: a pair is taken if its places in the
    fall from the left and in the fall from the right are both even, counted
    from the smallest. At one position the list that had the last place comes
    first, at the very first one ``first``.
    """
    other = "position" if first == "target" else "target"
    part = {"target": targets, "position": points}
    line = part[first].select(*key, F.col(first).cast("double").alias("_x"), F.lit(0).alias("_side")).union(part[other].select(*key, F.col(other).cast("double").alias("_x"), F.lit(1).alias("_side"))).where("_x is not null")
    at, by_x = W.partitionBy(*key, "_x"), W.partitionBy(*key).orderBy("_x")
    so_far = by_x.rangeBetween(W.unboundedPreceding, W.currentRow)
    # which list comes first at a position of both: that of the last position of one list, turned at each position of both since then
    rows = line.withColumns({"_both": F.min("_side").over(at) != F.max("_side").over(at), "_one": F.row_number().over(at.orderBy("_side")) == 1})
    rows = rows.withColumn("_turns", F.count_if(F.col("_both") & F.col("_one")).over(so_far) - F.col("_both").cast("int"))
    last = F.last(F.when(~F.col("_both"), F.struct("_side", "_turns")), True).over(so_far)
    start = F.coalesce(last["_side"] + F.col("_turns") - last["_turns"], F.col("_turns")) % 2
    rows = rows.withColumn("_rank", F.when(F.col("_side") == start, 0).otherwise(1))
    order = W.partitionBy(*key).orderBy("_x", "_rank")
    lag = lambda c: F.lag(c).over(order)
    rows = rows.withColumns({"_i": F.row_number().over(order), "_before": lag("_x"), "_gap": F.when((lag("_side") != F.col("_side")) & ~(lag("_x") < F.col("_x") - window), F.col("_x") - lag("_x"))})
    line = W.partitionBy(*key).orderBy("_i")
    gap, left, right = F.col("_gap"), F.lag("_gap").over(line), F.lead("_gap").over(line)
    rises = F.coalesce(left <= gap, F.lit(False))
    falls = F.coalesce(right < gap, F.lit(False))
    rows = rows.withColumns({"_from": F.when(~rises, F.col("_i")), "_to": F.when(~falls, F.col("_i"))})
    up = F.col("_i") - F.last("_from", True).over(line.rowsBetween(W.unboundedPreceding, 0))
    down = F.first("_to", True).over(line.rowsBetween(0, W.unboundedFollowing)) - F.col("_i")
    taken = rows.withColumns({"_up": up, "_down": down}).where(gap.isNotNull() & (F.col("_up") % 2 == 0) & (F.col("_down") % 2 == 0))
    own, less = F.col("_x"), F.col("_before")
    second = F.col("_side") == 1
    return taken.select(*key, F.when(second, less).otherwise(own).alias(first), F.when(second, own).otherwise(less).alias(other)).select(*key, "position", "target")


def missed(targets: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """Targets without a match, as rows of status falseneg; the matches are truepos."""
    neg = targets.join(matches.select(*key, "target"), [*key, "target"], "left_anti").withColumn("status", F.lit("falseneg"))
    return matches.withColumn("status", F.lit("truepos")).unionByName(neg, allowMissingColumns=True)
