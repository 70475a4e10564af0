"""Experiments laid over one another: a common zero, masked peaks, a pivot, and the scale of a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclarium.operators.references import Grid, fit_to_reference

#: The grid of a track on its reference, in units of its stretch and of micrometres.
GRID = Grid((1.0, 0.15, 0.03), (0.0, 0.008, 0.002))


def _positions(rows: DataFrame, by: list[str]) -> DataFrame:
    """The keys' distinct positions and their rates."""
    return rows.where("peakposition is not null").groupBy(*by, "peakposition").agg(F.min("hybridisationrate").alias("_rate"))


def find_zero(rows: DataFrame, by: list[str], least_ratio: float = 0.1, least_rate: float = 0.1) -> DataFrame:
    """Rows (by..., peakposition, hybridisationrate) without the weak peaks below the zero.

    The zero is the lowest peak with more than ``least_rate``. Peaks below it go
    that have less than ``least_ratio`` times its rate, up to the first below
    it that has more. Keys without a zero keep all.
    """
    whole = W.partitionBy(*by)
    own = _positions(rows, by).withColumn("_zero", F.min(F.when(F.col("_rate") > least_rate, F.col("peakposition"))).over(whole))
    own = own.withColumn("_top", F.max(F.when(F.col("peakposition") == F.col("_zero"), F.col("_rate"))).over(whole))
    below = F.col("peakposition") < F.col("_zero")
    weak = below & (F.col("_rate") < F.col("_top") * least_ratio)
    own = own.withColumn("_strong", F.min(F.when(below & ~weak, F.col("peakposition"))).over(whole))
    gone = own.where(weak & (F.col("_strong").isNull() | (F.col("peakposition") < F.col("_strong")))).select(*by, "peakposition")
    return rows.join(gone, [*by, "peakposition"], "left_anti")


def mask_peaks(rows: DataFrame, masks: dict, by: list[str]) -> DataFrame:
    """Rows without the masked peaks; ``masks`` has the first key's values.

    A whole number keeps the peaks below the one of that number (from 0, or
    from the end if negative), a list takes the peaks of these numbers out.
    Numbers that a key doesn't have mask nothing.
    """
    if not masks:
        return rows
    kind = rows.schema[by[0]].dataType.simpleString()
    table = rows.sparkSession.createDataFrame([(k, None, [int(x) for x in v]) if isinstance(v, (list, tuple, set)) else (k, int(v), None) for k, v in masks.items() if v is not None], f"{by[0]} {kind}, _below int, _out array<int>")
    over = W.partitionBy(*by)
    own = _positions(rows, by).join(F.broadcast(table), by[0])
    own = own.withColumns({"_i": F.row_number().over(over.orderBy("peakposition")) - 1, "_n": F.count("*").over(over)})
    number = lambda x, n: F.when(x < 0, x + n).otherwise(x)
    edge = number(F.col("_below"), F.col("_n"))
    late = F.coalesce((F.col("_i") >= edge) & (edge >= 0) & (edge < F.col("_n")), F.lit(False))
    listed = F.coalesce(F.exists("_out", lambda x: number(x, F.col("_n")) == F.col("_i")), F.lit(False))
    return rows.join(own.where(late | listed).select(*by, "peakposition"), [*by, "peakposition"], "left_anti")


def set_pivot(rows: DataFrame, by: list[str], position: str = "max", bump: dict | None = None) -> DataFrame:
    """``peakposition`` and ``avg`` counted from the key's highest or lowest peak (``max``, ``min``, or ``abs`` for none), and moved by ``bump``."""
    if position == "abs":
        return rows
    pivot = rows.groupBy(*by).agg({"max": F.max, "min": F.min, "mean": F.mean, "median": F.median}[position]("peakposition").alias("_pivot"))
    more = F.lit(0.0)
    if bump:
        more = F.coalesce(F.create_map(*[F.lit(x) for k, v in bump.items() for x in (k, float(v))])[F.col(by[0])], F.lit(0.0))
    return rows.join(pivot, by).withColumns({c: F.col(c) - F.col("_pivot") + more for c in ("peakposition", "avg") if c in rows.columns}).drop("_pivot")


def reference_fits(rows: DataFrame, reference, by: str, step: float, grid: Grid = GRID, *, method: str = "corrected", window: float = 1.5e-2, rounds: int = 2) -> DataFrame:
    """(by, cost, stretch, bias) of each key's peaks (peakposition, resolution) on those of the key ``reference``."""
    peaks = rows.groupBy(by, "peakposition").agg(F.min("resolution").alias("resolution")).withColumn("_ref", F.lit(1))
    own = peaks.where(F.col(by) == F.lit(reference)).drop(by)
    return fit_to_reference(own, peaks, step, grid, method=method, pivot="absolute", window=window, first=0, rounds=rounds, by=[by, "_ref"], meet=["_ref"]).drop("_ref")


def correct(rows: DataFrame, fits: DataFrame, by: str) -> DataFrame:
    """Positions and widths on the scale of the fits; keys without one go."""
    placed = {c: (F.col(c) - F.col("bias")) * F.col("stretch") for c in ("peakposition", "avg") if c in rows.columns}
    scaled = {c: F.col(c) * F.col("stretch") for c in ("std", "resolution") if c in rows.columns}
    return rows.join(fits.select(by, "stretch", "bias"), by).withColumns(placed | scaled).select(*rows.columns)


def align_experiments(rows: DataFrame, reference, by: str = "track", step: float = 2e-4, *, pivot: str = "max", masks: dict | None = None, bump: dict | None = None, discarded: list = [], zero: bool = True, **options) -> DataFrame:
    """Rows (track, bead, peakposition, hybridisationrate, resolution, avg, ...) of all keys on the scale of the key ``reference``.

    Discarded keys go; then the weak peaks below the zero and the masked ones;
    what is left is counted from the pivot and fitted to the reference.
    """
    rows = rows.where(~F.col(by).isin(*discarded)) if discarded else rows
    rows = find_zero(rows, [by]) if zero else rows
    rows = set_pivot(mask_peaks(rows, masks or {}, [by]), [by], pivot, bump)
    return correct(rows, reference_fits(rows, reference, by, step, **options), by)
