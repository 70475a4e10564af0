"""Beads fitted to the same beads of a reference by their densities: stretch and bias at which these agree best.

A density is a table of bins. Peaks put a kernel as wide as their own spread
about their position. A fit scores a grid of stretches and biases at once: a
bead's bins meet its reference's in one row, as arrays, and one sum per stretch
and bias is the score. Finer grids about each bead's best follow.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.functions import densities as kernels
from cyclarium.functions.peaks import NO_MATCH
from cyclarium.operators.selection import matched
from cyclarium.operators.statistics import BEAD
from cyclarium.operators.storage import stored


def peak_density(peaks: DataFrame, step: float, *, edge: int = 20, share: float = 0.75, by: list[str] = BEAD) -> DataFrame:
    """(by..., bin, low, density): kernels about (by..., peakposition, resolution), each as wide as its peak's spread.

    Bins are ``step`` wide and begin ``edge`` of them below the lowest peak;
    all bins up to as many above the highest are there. A spread is rounded to
    bins; one without any counts as the percentile ``share`` of the others', or
    as four bins if there are none. A kernel reaches two spreads to each side
    and sums up to one; where several reach, the widest counts, of equally wide
    ones that of the highest peak.
    """
    rows = peaks.where("peakposition is not null").select(*by, "peakposition", F.rint(F.col("resolution") / step).cast("int").alias("w"))
    low, high = F.min("peakposition") - edge * step, F.max("peakposition") + edge * step
    bounds = rows.groupBy(*by).agg(low.alias("low"), (F.floor((high - low) / step) + 1).alias("size"), F.percentile(F.when(F.col("w") > 0, F.col("w")), F.lit(share)).cast("int").alias("usual"))
    width = F.when(F.col("w") > 0, F.col("w")).otherwise(F.coalesce("usual", F.lit(4)))
    placed = rows.join(bounds, by).select(*by, "peakposition", "size", F.rint((F.col("peakposition") - F.col("low")) / step).cast("bigint").alias("at"), width.alias("w"))
    bell = lambda d: F.exp(-0.5 * F.pow(d / F.col("w"), F.lit(2)))
    total = F.aggregate(F.sequence(-2 * F.col("w"), 2 * F.col("w")), F.lit(0.0), lambda acc, d: acc + bell(d))
    reach = F.sequence(F.greatest(F.col("at") - 2 * F.col("w"), F.lit(0).cast("bigint")), F.least(F.col("at") + 2 * F.col("w"), F.col("size") - 1))
    spread = placed.withColumn("_total", total).withColumn("bin", F.explode(reach))
    made = spread.groupBy(*by, "bin").agg(F.max_by(bell(F.col("bin") - F.col("at")) / F.col("_total"), F.struct("w", "peakposition")).alias("density"))
    every = bounds.select(*by, "low", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)).alias("bin"))
    return every.join(made, [*by, "bin"], "left").select(*by, "bin", "low", F.coalesce("density", F.lit(0.0)).alias("density"))


def interpolator(density: DataFrame, least: float = 1e-3, by: list[str] = BEAD) -> DataFrame:
    """The bins of ``density`` that a line through their neighbours needs: (by..., bin, density).

    Densities below ``least`` count as none, and only bins next to a step of more than
    a hundredth of it are kept; all, where fewer than two are.
    """
    over = W.partitionBy(*by).orderBy("bin")
    rows = density.where(F.col("density").isNotNull() & ~F.isnan("density")).select(*by, "bin", F.when(F.col("density") < least, 0.0).otherwise(F.col("density")).alias("density"))
    step = lambda other: F.coalesce(F.abs(F.col("density") - other) > least * 1e-2, F.lit(False))
    rows = rows.withColumn("_kept", step(F.lag("density").over(over)) | step(F.lead("density").over(over)))
    few = F.count_if("_kept").over(W.partitionBy(*by)) < 2
    return rows.withColumn("_few", few).where(F.col("_kept") | F.col("_few")).drop("_kept", "_few")


def profile(density: DataFrame, step: float, *, pivot: str = "bottom", least: float = 1e-3, most: str | float | None = "auto", by: list[str] = BEAD) -> DataFrame:
    """(by..., bin, x, zero, start, kept, y, ahead): a density as lines between the bins that are kept.

    Kept are bins of ``least`` or more, their neighbours, and both ends. What is
    higher than ``most`` is cut to it; "auto" is the median of the kept bins'
    maxima. ``x`` counts from the first bin (``bottom``), to the last (``top``),
    or is the position itself (``absolute``); ``zero`` is the position of x = 0.
    """
    over = W.partitionBy(*by).orderBy("bin")
    whole = W.partitionBy(*by)
    d = F.col("density")
    near = lambda c: F.coalesce(c >= least, F.lit(True))  # noqa: E731  beyond the ends counts as enough
    rows = density.withColumn("kept", (d >= least) | near(F.lag("density").over(over)) | near(F.lead("density").over(over)))
    rows = rows.withColumn("_y", F.when(F.col("kept"), d))
    if most is not None:
        own = rows.where("kept")
        peak = (F.lag("_y").over(over) < F.col("_y")) & (F.lead("_y").over(over) < F.col("_y"))
        roof = own.withColumn("_peak", F.when(peak, F.col("_y"))).groupBy(*by).agg(F.median("_peak").alias("_roof")) if most == "auto" else own.select(*by).distinct().withColumn("_roof", F.lit(float(most)))
        rows = rows.join(roof, by, "left").withColumn("_y", F.when(F.col("kept"), F.least("_y", "_roof")))
    at = F.when(F.col("kept"), F.col("bin"))
    back, ahead = over.rowsBetween(W.unboundedPreceding, 0), over.rowsBetween(0, W.unboundedFollowing)
    y0, y1, b0, b1 = F.last("_y", True).over(back), F.first("_y", True).over(ahead), F.last(at, True).over(back), F.first(at, True).over(ahead)
    rows = rows.withColumn("y", F.when(b0 == b1, y0).otherwise(y0 + (y1 - y0) * (F.col("bin") - b0) / (b1 - b0)))
    zero = {"bottom": F.col("low"), "top": F.col("low") + F.max("bin").over(whole) * step, "absolute": F.lit(0.0)}[pivot]
    rows = rows.withColumn("zero", zero).withColumn("x", F.col("low") - F.col("zero") + F.col("bin") * step)
    return rows.select(*by, "bin", "x", "zero", (F.col("low") - F.col("zero")).alias("start"), "kept", "y", F.lead("y").over(over).alias("ahead"))


@dataclass(frozen=True)
class Grid:
    """Centre, reach and step of stretches and of biases."""

    stretch: tuple[float, float, float] = (1.0, 0.05, 0.02)
    bias: tuple[float, float, float] = (0.0, 0.1, 0.01)

    @staticmethod
    def _line(centre: float, reach: float, step: float) -> list[float]:
        n = max(1, int(2 * reach / step + 0.5) // 2 * 2 + 1)
        return [centre] if n == 1 else np.linspace(centre - reach, centre + reach, n).tolist()

    def nodes(self) -> list[tuple[float, float]]:
        """All pairs of a stretch and a bias."""
        return list(itertools.product(self._line(*self.stretch), self._line(*self.bias)))

    def finer(self, k: int) -> list[tuple[float, float]]:
        """Moves about the best of round ``k``: up to half a step of that round, in quarters."""
        return [(i * self.stretch[2] / 4**k, j * self.bias[2] / 4**k) for i, j in itertools.product((-2, -1, 0, 1, 2), repeat=2)]


def _all(keys: DataFrame, nodes: list[tuple[float, float]], by: list[str]) -> DataFrame:
    return keys.select(*by, F.explode(F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(b)).alias("b")) for s, b in nodes])).alias("o")).select(*by, "o.s", "o.b")


def _arrays(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Each key's profile in one row."""
    one = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "y", "kept"))).alias("_p"), F.first("start").alias(f"{name}_start"), F.first("zero").alias(f"{name}_zero"))
    return one.select(*by, *[F.col("_p")[c].alias(f"{name}_{c}") for c in ("bin", "y", "kept")], f"{name}_start", f"{name}_zero")


def fit_densities(left: DataFrame, right: DataFrame, step: float, grid: Grid = Grid(), rounds: int = 2, symmetry: str = "both", by: list[str] = BEAD, meet: list[str] = ["bead"]) -> DataFrame:
    """(by..., cost, stretch, bias) of profiles on their references' positions: position = (x - bias) * stretch.

    A grid and ``rounds`` finer ones about each bead's best. Beads without a
    reference are left out. A bead's profile meets its reference's as arrays.
    """
    nodes, finer = np.array(grid.nodes(), float), [np.array(grid.finer(k), float) for k in range(1, rounds + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            side = lambda name: [kernels.Profile(np.asarray(p, float), np.array(y, float), np.asarray(k, bool), start, step) for p, y, k, start in zip(*(rows[f"{name}_{c}"] for c in ("bin", "y", "kept", "start")))]  # noqa: E731, B023
            made = [kernels.fit(one, two, nodes, finer, symmetry) for one, two in zip(side("l"), side("r"))]
            yield rows[by].assign(cost=[x[0] for x in made], stretch=[x[1] for x in made], bias=[x[2] + r - l / x[1] for x, r, l in zip(made, rows["r_zero"], rows["l_zero"])])

    pairs = _arrays(right, by, "r").join(_arrays(left, meet, "l"), meet)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for k in by for f in [pairs.schema[k]])
    return pairs.mapInPandas(run, f"{kinds}, cost double, stretch double, bias double")


def _placed(best: DataFrame, left: DataFrame, right: DataFrame, by: list[str], meet: list[str]) -> DataFrame:
    """Stretch and bias of the positions themselves, from those of the profiles' x."""
    zeros = lambda rows, keys, name: rows.groupBy(*keys).agg(F.first("zero").alias(name))
    rows = best.join(zeros(right, by, "_r"), by).join(zeros(left, meet, "_l"), meet)
    return rows.select(*by, "cost", F.col("s").alias("stretch"), (F.col("b") + F.col("_r") - F.col("_l") / F.col("s")).alias("bias"))


def _regressed(reference: DataFrame, peaks: DataFrame, lines: DataFrame, window: float, key: list[str], meet: list[str]) -> tuple[DataFrame, DataFrame]:
    """What each line (key..., s, c) matches (position * s + c near a target), and the line through that, where there are two pairs or more."""
    placed = peaks.join(lines, [k for k in key if k in peaks.columns]).withColumn("position", F.col("x") * F.col("s") + F.col("c"))
    targets = lines.select(*key).distinct().join(reference.select(*meet, "target"), meet)
    pairs = matched(placed.select(*key, "position"), targets.select(*key, "target"), key, window)
    pairs = pairs.join(placed.select(*key, "position", "x").distinct(), [*key, "position"])
    made = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.covar_pop("target", "x").alias("up"), F.var_pop("x").alias("down"), F.avg("target").alias("ty"), F.avg("x").alias("tx"))
    good = (F.col("n") > 1) & (F.col("down") > 0)
    return pairs, made.select(*key, "n", F.when(good, F.col("up") / F.col("down")).alias("s2"), F.when(good, F.col("ty") - F.col("up") / F.col("down") * F.col("tx")).alias("c2"))


def chi_squared_fits(reference: DataFrame, peaks: DataFrame, options: DataFrame, window: float, *, symmetry: str = "both", key: list[str] = BEAD, by: list[str] = BEAD, meet: list[str] = ["bead"]) -> DataFrame:
    """(key..., cost, stretch, bias): for each option (key..., stretch, bias) the line through what it matches, again if that matches more, and its cost.

    ``reference`` has (meet..., target), ``peaks`` (by..., x), each value once.
    The cost is the root of (squared distances over the window's + squared
    number of unmatched ones) per matched one, ``NO_MATCH`` without any.
    """
    lines = stored(options.select(*key, F.col("stretch").alias("s"), (-F.col("bias") * F.col("stretch")).alias("c")))
    _, first = _regressed(reference, peaks, lines, window, key, meet)
    now = lines.join(first, key, "left").select(*key, F.coalesce("s2", "s").alias("s"), F.coalesce("c2", "c").alias("c"), F.coalesce("n", F.lit(0)).alias("n1"), F.col("s2").isNotNull().alias("_fitted"))
    now = stored(now)
    _, second = _regressed(reference, peaks, now.select(*key, "s", "c"), window, key, meet)
    again = F.col("_fitted") & (F.col("n") > F.col("n1"))
    last = stored(now.join(second, key, "left").select(*key, F.when(again, F.coalesce("s2", "s")).otherwise(F.col("s")).alias("s"), F.when(again, F.coalesce("c2", "c")).otherwise(F.col("c")).alias("c")))
    pairs, _ = _regressed(reference, peaks, last, window, key, meet)
    off = F.pow(F.col("position") - F.col("target"), F.lit(2))
    found = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.sum(off).alias("square"))
    sizes = last.join(peaks.groupBy(*by).agg(F.count("*").alias("_x")), by, "left").join(reference.groupBy(*meet).agg(F.count("*").alias("_t")), meet, "left").join(found, key, "left").na.fill(0, ["_x", "_t", "n"])
    total = {"both": F.col("_x") + F.col("_t"), "left": F.col("_t"), "right": F.col("_x")}[symmetry]
    paired = F.col("n") * (2 if symmetry == "both" else 1)
    square = F.when(F.col("n") > 1, F.col("square")).otherwise(0.0) / window**2
    cost = F.when(F.col("n") > 0, F.sqrt((square + F.pow(total - paired, F.lit(2))) / paired)).otherwise(NO_MATCH)
    return sizes.select(*key, cost.alias("cost"), F.col("s").alias("stretch"), (-F.col("c") / F.col("s")).alias("bias"))


def _listed(reference: DataFrame, peaks: DataFrame, first: int, by: list[str], meet: list[str]) -> tuple[DataFrame, DataFrame]:
    """The reference's positions from number ``first`` on, and the peaks', each once."""
    rank = F.row_number().over(W.partitionBy(*meet).orderBy("peakposition"))
    own = reference.where("peakposition is not null").select(*meet, "peakposition").distinct().withColumn("_i", rank).where(F.col("_i") > first)
    return own.select(*meet, F.col("peakposition").cast("double").alias("target")), peaks.where("peakposition is not null").select(*by, F.col("peakposition").cast("double").alias("x")).distinct()


def fit_to_reference(reference: DataFrame, peaks: DataFrame, step: float, grid: Grid = Grid(), *, method: str = "histogram", pivot: str = "bottom", symmetry: str = "both", window: float = 1.5e-2, first: int = 1, rounds: int = 2, by: list[str] = BEAD, meet: list[str] = ["bead"]) -> DataFrame:
    """(by..., cost, stretch, bias) of peaks (by..., peakposition, resolution) on those of a reference (meet...).

    ``histogram`` is the best agreement of densities. ``corrected`` continues
    with a line through the peaks that this pairs, without the reference's
    ``first`` ones. ``chisquare`` does so for each node of the grid and takes
    the least chi-squared cost.
    """
    left = profile(peak_density(reference, step, by=meet), step, pivot=pivot, by=meet)
    right = profile(peak_density(peaks, step, by=by), step, pivot=pivot, by=by)
    if method != "chisquare":
        best = fit_densities(left, right, step, grid, rounds, symmetry, by, meet)
        return best if method == "histogram" else chi_squared_fits(*_listed(reference, peaks, first, by, meet), best, window, symmetry=symmetry, key=by, by=by, meet=meet)
    left, right = stored(left), stored(right)
    keys = right.select(*by).distinct().join(left.select(*meet).distinct(), meet).select(*by)
    nodes = _all(keys, grid.nodes(), by).withColumn("cost", F.lit(0.0))
    options = _placed(nodes, left, right, by, meet).withColumns({"node": F.xxhash64("stretch", "bias")})
    made = chi_squared_fits(*_listed(reference, peaks, first, by, meet), options, window, symmetry=symmetry, key=[*by, "node"], by=by, meet=meet)
    return made.groupBy(*by).agg(F.min(F.struct("cost", "stretch", "bias")).alias("best")).select(*by, "best.*")
