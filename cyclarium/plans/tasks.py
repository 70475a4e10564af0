"""Task lists: declarative, ordered, and folded into one DataFrame plan.

A task is a frozen dataclass without data. A list of tasks is checked (a root
first, each type once, levels from beads to peaks), rescaled or saved as JSON
without touching data, and run by folding each task's function over the frames,
so that Catalyst sees one plan for all tracks. Tasks on events and peaks may
also look at the signals that these come from.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclarium.functions import filters
from cyclarium.operators import alignment, calling, cleaning, correlation, events, peaks, projection, ramps, references, reports, selection, statistics
from cyclarium.sources import simulators
from cyclarium.sources.fixtures import DURATIONS, PHASES

#: Levels from the coarsest to the finest.
LEVELS = ("project", "bead", "cycle", "event", "peak")


@dataclass
class Context:
    """What a plan's tasks know besides the rows: the latest signals, how precision is measured, and errors that cost one bead only."""

    signals: DataFrame | None = None
    computer: str = "range"
    skip: tuple[type[Exception], ...] = ()

    def precision(self) -> DataFrame:
        return statistics.raw_precision(self.signals, self.computer)

    def cycles(self) -> DataFrame:
        """(track, bead, ncycles)."""
        return self.signals.groupBy(*statistics.BEAD).agg(F.count_distinct("cycle").alias("ncycles"))

    def bounds(self, phase: int) -> DataFrame:
        """(track, bead, cycle, first, phase_start, stop) of a phase: its first frame, and its ends counted from there, as events' starts are."""
        per = self.signals.where(F.col("phase") == phase).groupBy(*statistics.CYCLE).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
        return per.select(*statistics.CYCLE, "first", F.lit(0).alias("phase_start"), (F.col("last") - F.col("first") + 1).alias("stop"))


@dataclass(frozen=True)
class Task:
    """Base of all tasks; ``zattributes`` are the parameters in units of z."""

    disabled: bool = False
    level = "bead"
    order = 0
    zattributes = ()

    def apply(self, frames: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        """The rows after the task."""
        return rows.transform(self.apply)

    def rescaled(self, factor: float) -> Task:
        """The task with its lengths multiplied."""
        scale = lambda v: tuple(x if x is None else x * factor for x in v) if isinstance(v, tuple) else v * factor
        return replace(self, **{a: scale(getattr(self, a)) for a in self.zattributes if getattr(self, a) is not None})


@dataclass(frozen=True)
class RootTask(Task):
    """Where frames come from; the plan's first task."""

    level, order = "project", 0


@dataclass(frozen=True)
class TrackReaderTask(RootTask):
    """Frames stored as Parquet; ``key`` names the track if the files don't. A dict of paths by track reads all of them."""

    path: str | dict = ""
    key: str | None = None

    def read(self, spark) -> DataFrame:
        many = self.path if isinstance(self.path, dict) else {self.key: self.path}
        out = None
        for key, path in many.items():
            frames = spark.read.parquet(path)
            frames = frames.withColumn("track", F.lit(key)) if key else frames
            out = frames if out is None else out.unionByName(frames)
        if out is None:
            raise ValueError("no paths to read")
        return out

    def paths_read(self) -> list[str]:
        """All paths."""
        return list(self.path.values()) if isinstance(self.path, dict) else [self.path]


@dataclass(frozen=True)
class InMemoryTrackTask(RootTask):
    """Frames that the caller hands to ``run``."""


@dataclass(frozen=True)
class UndersamplingTask(Task):
    """Bins of frames."""

    framerate: float = 30.0
    target: float = 30.0
    aggregation: str | None = "mean"
    order = 1

    def apply(self, frames: DataFrame) -> DataFrame:
        width = statistics.bin_width(self.framerate, self.target)
        return frames if width == 1 else statistics.undersample(frames, width, self.aggregation)


@dataclass(frozen=True)
class BeadSubtractionTask(Task):
    """The signal of some beads taken from the others."""

    beads: tuple = ()
    how: str = "median"
    order = 2

    def apply(self, frames: DataFrame) -> DataFrame:
        return cleaning.subtract(frames, list(self.beads), self.how) if self.beads else frames


@dataclass(frozen=True)
class DataSelectionTask(Task):
    """Beads, cycles, phases and samples to keep."""

    selected: tuple = ()
    discarded: tuple = ()
    cycles: tuple | None = None
    phases: tuple | None = None
    samples: tuple | None = None
    order = 3

    def apply(self, frames: DataFrame) -> DataFrame:
        if self.selected:
            frames = selection.selecting(frames, list(self.selected))
        if self.discarded:
            frames = selection.discarding(frames, list(self.discarded))
        for value, function in ((self.cycles, selection.with_cycles), (self.phases, selection.with_phases), (self.samples, selection.with_samples)):
            if value:
                frames = function(frames, *value)
        return frames


@dataclass(frozen=True)
class CycleSamplingTask(Task):
    """A track of some cycles alone."""

    cycles: tuple = ()
    order = 4

    def apply(self, frames: DataFrame) -> DataFrame:
        return selection.sample_cycles(frames, list(self.cycles))


@dataclass(frozen=True)
class TaggingTask(Task):
    """Beads with, or without, some tags; ``tags`` maps a tag to beads."""

    tags: dict = field(default_factory=dict)
    selection: tuple = ()
    keep: bool = True
    order = 5

    def apply(self, frames: DataFrame) -> DataFrame:
        beads = sorted({b for t in self.selection for b in self.tags.get(t, ())})
        return selection.selecting(frames, beads) if self.keep else selection.discarding(frames, beads)


@dataclass(frozen=True)
class DataCleaningTask(Task):
    """Cycles and beads that break the rules go."""

    hfsigma: tuple = (1e-4, 1e-2)
    extent: tuple = (0.25, 2.0)
    population: float = 80.0
    pingpong: float = 3.0
    saturation: float = 0.015
    tests: tuple = ("population", "hfsigma", "extent", "pingpong", "saturation")
    aberrant: bool = True
    order = 6
    zattributes = ("hfsigma", "extent", "saturation")

    def rules(self) -> cleaning.Rules:
        return cleaning.Rules(hfsigma=self.hfsigma, extent=self.extent, population=(self.population, None), pingpong=(None, self.pingpong), saturation=(None, self.saturation), tests=self.tests)

    def apply(self, frames: DataFrame) -> DataFrame:
        return cleaning.clean(cleaning.suppress_aberrant(frames) if self.aberrant else frames, self.rules())


@dataclass(frozen=True)
class FixedBeadDetectionTask(Task):
    """Beads that don't move go."""

    extent: float = 0.1
    noise: float = 5e-3
    spread: float = 0.05
    order = 7
    zattributes = ("extent", "noise", "spread")

    def apply(self, frames: DataFrame) -> DataFrame:
        fixed = cleaning.fixed_beads(frames, max_extent=self.extent, max_noise=self.noise, max_spread=self.spread).where("fixed")
        return frames.join(fixed, statistics.BEAD, "left_anti")


@dataclass(frozen=True)
class ExtremumAlignmentTask(Task):
    """Cycles moved to each other by their edges."""

    mode: str = "pull"
    delta: float = 0.2
    pull: float = 0.1
    opening: float = 0.25
    order = 8
    zattributes = ("delta", "pull", "opening")

    def apply(self, frames: DataFrame) -> DataFrame:
        biases = alignment.best_bias(frames, self.mode, delta=self.delta, pull=self.pull, opening=self.opening)
        return alignment.translate(frames, biases).where("z is not null")


@dataclass(frozen=True)
class DriftTask(Task):
    """The drift that a bead's cycles share, or a cycle's beads, taken off.

    ``collapse`` says how stretches of all cycles become one profile: by the
    ``sock``, the ``mean`` or ``merging`` of their events, or by the median or
    mean (``mode``) step of all frames (``derivate``).
    """

    mode: str = "median"
    onbeads: bool = True
    collapse: str = "sock"
    stitching: str = "interpolation"
    least: int = 10
    order = 9

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        by = statistics.BEAD if self.onbeads else ["track", "cycle"]
        if self.collapse == "derivate":
            profile = events.drift_by_derivate(rows, by, self.mode)
        else:
            profile = events.cycle_drift(rows, context.precision(), self.collapse, self.stitching, self.least, by)
        return events.remove_drift(rows, profile, by)


@dataclass(frozen=True)
class ClippingTask(Task):
    """Measure values out of range go."""

    low: float = 4.0
    high: float = 0.0
    order = 10

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        return cleaning.clip_measure(rows, context.precision(), self.low, self.high)


@dataclass(frozen=True)
class EventDetectionTask(Task):
    """Frames become events."""

    least: int = 4
    confidence: float = 0.1
    phase: int = PHASES["measure"]
    level, order = "event", 11

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        return events.event_table(events.detect(rows, context.precision(), phase=self.phase, least=self.least, confidence=self.confidence))


@dataclass(frozen=True)
class PeakSelectorTask(Task):
    """Events become peaks."""

    precision: float = 3e-3
    align: bool = True
    method: str = "histogram"
    level, order = "peak", 12
    zattributes = ("precision",)

    def apply(self, found: DataFrame) -> DataFrame:
        return peaks.select_peaks(found, self.precision, align=self.align, method=self.method)


@dataclass(frozen=True)
class FitToHairpinTask(Task):
    """Peaks become fits to hairpins' positions."""

    hairpins: dict = field(default_factory=dict)
    method: str = "grid"
    level, order = "peak", 13

    def apply(self, found: DataFrame) -> DataFrame:
        return peaks.fit_hairpins(found.select("track", "bead", "peakposition").distinct(), self.hairpins, self.method)


@dataclass(frozen=True)
class BeadsByHairpinTask(Task):
    """Fits become ranked groups of beads."""

    least: float = -3.0
    level, order = "peak", 14

    def apply(self, fits: DataFrame) -> DataFrame:
        return peaks.beads_by_hairpin(fits, self.least)


@dataclass(frozen=True)
class DataFrameTask(Task):
    """Named measures of z per key."""

    by: tuple = ("track", "bead")
    measures: dict = field(default_factory=dict)
    level, order = "project", 15

    def apply(self, frames: DataFrame) -> DataFrame:
        return statistics.measures(frames, list(self.by), **self.measures)


@dataclass(frozen=True)
class ActionTask(Task):
    """Any function from a DataFrame to a DataFrame, which isn't saved."""

    call: Callable[[DataFrame], DataFrame] = lambda frames: frames
    order = 16

    def apply(self, frames: DataFrame) -> DataFrame:
        return frames.transform(self.call)


@dataclass(frozen=True)
class TrackSimulatorTask(RootTask):
    """Simulated frames."""

    beads: int = 1
    cycles: int = 15
    durations: tuple = DURATIONS
    peaks: tuple = (0.1, 0.3, 0.5)
    rates: tuple | None = None
    mean: float = 8.0
    brownian: float = 3e-3
    drift: float = 0.0
    seed: int = 0

    def read(self, spark) -> DataFrame:
        return simulators.simulate_tracks(spark, self.beads, self.cycles, durations=tuple(self.durations), peaks=list(self.peaks), rates=self.rates, mean=self.mean, brownian=self.brownian, drift=self.drift, seed=self.seed)


@dataclass(frozen=True)
class EventSimulatorTask(RootTask):
    """Simulated events."""

    beads: int = 1
    cycles: int = 15
    peaks: tuple = (0.1, 0.3, 0.5)
    rates: tuple | None = None
    brownian: float = 3e-3
    mean: float = 10.0
    stretch: float = 1.0
    bias: float = 0.0
    seed: int = 0
    level = "event"

    def read(self, spark) -> DataFrame:
        rates = list(self.rates or [0.5] * len(self.peaks))
        return simulators.simulate_events(spark, self.beads, self.cycles, list(self.peaks), rates, brownian=self.brownian, mean=self.mean, stretch=self.stretch, bias=self.bias, seed=self.seed)


@dataclass(frozen=True)
class ByPeaksEventSimulatorTask(EventSimulatorTask):
    """Simulated events of known peaks."""

    level = "peak"

    def read(self, spark) -> DataFrame:
        ranks = F.array(*map(F.lit, sorted(self.peaks)))
        rows = super().read(spark).withColumn("peak", (F.array_position(ranks, F.col("truth")) - 1).cast("int"))
        return peaks.move_events(rows.withColumn("peakposition", F.col("truth")).drop("truth"), rows.select(*statistics.CYCLE, F.lit(0.0).alias("bias")).distinct())


@dataclass(frozen=True)
class BatchTask(RootTask):
    """The same tasks over several stored tracks: one row set of all results. ``tasks`` come after the root."""

    paths: dict = field(default_factory=dict)
    tasks: tuple = ()

    def template(self) -> tuple:
        return self.tasks

    def read(self, spark) -> DataFrame:
        made = [run([TrackReaderTask(path=path, key=key), *self.template()], spark=spark) for key, path in self.paths.items()]
        out = made[0]
        for rows in made[1:]:
            out = out.unionByName(rows)
        return out


@dataclass(frozen=True)
class PeakFindingBatchTask(BatchTask):
    """Cleaning, alignment, events and peaks of each track; ``tasks`` replace those of their type."""

    def template(self) -> tuple:
        out = [DataCleaningTask(), ExtremumAlignmentTask(), EventDetectionTask(), PeakSelectorTask()]
        for task in self.tasks:
            out = insert(out, task)
        return tuple(out)


@dataclass(frozen=True)
class HybridstatBatchTask(PeakFindingBatchTask):
    """The same, fitted to hairpins and grouped by them."""

    hairpins: dict = field(default_factory=dict)

    def template(self) -> tuple:
        return (*super().template(), FitToHairpinTask(hairpins=self.hairpins), BeadsByHairpinTask())


@dataclass(frozen=True)
class RawPrecisionTask(Task):
    """How the tasks that follow measure precision: ``range`` or ``normalized``."""

    computer: str = "range"
    level, order = "none", 0

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        context.computer = self.computer
        return rows


#: Errors that may cost a bead only.
ERRORS = {"ValueError": ValueError, "ArithmeticError": ArithmeticError, "IndexError": IndexError, "RuntimeError": RuntimeError}


@dataclass(frozen=True)
class ExceptionCatchingTask(Task):
    """Beads on which a later function of values raises one of these errors go; others stop the plan."""

    errors: tuple = ("ValueError",)
    level, order = "none", 0

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        context.skip = tuple(ERRORS[x] for x in self.errors)
        return rows


@dataclass(frozen=True)
class CycleCreatorTask(Task):
    """Each cycle's frames from one phase to another."""

    first: int = PHASES["initial"]
    last: int = PHASES["relax"]
    level, order = "cycle", 4

    def apply(self, frames: DataFrame) -> DataFrame:
        return selection.with_phases(frames, self.first, self.last)


@dataclass(frozen=True)
class RampDataCleaningTask(DataCleaningTask):
    """Cleaning of ramps: cycles whose extent is far from the bead's go as well."""

    low: float = 0.9
    high: float = 1.1
    tests: tuple = ("population", "hfsigma", "extent", "pingpong")
    order = 6

    def apply(self, frames: DataFrame) -> DataFrame:
        kept = super().apply(frames)
        outliers = cleaning.extent_outliers(kept, self.low, self.high).where("testtoolow or testtoohigh")
        return kept.join(outliers, statistics.CYCLE, "left_anti")


@dataclass(frozen=True)
class DataFunctorTask(Task):
    """Base of tasks that pass a bead's values through one function."""

    order = 7

    def kernel(self, values):
        raise NotImplementedError

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        return cleaning.by_bead(rows, self.kernel, skip=context.skip)


@dataclass(frozen=True)
class ForwardBackwardFilterTask(DataFunctorTask):
    """Means from both sides, weighted by how well each fits."""

    widths: tuple = (1, 5, 15)
    precision: float = 3e-3
    power: float = 20.0
    zattributes = ("precision",)

    def kernel(self, values):
        return filters.forward_backward(values, tuple(self.widths), self.precision, self.power)


@dataclass(frozen=True)
class NonLinearFilterTask(DataFunctorTask):
    """Means of all windows about a value, weighted by how well each fits."""

    widths: tuple = (1, 5, 15)
    precision: float = 3e-3
    power: float = 20.0
    zattributes = ("precision",)

    def kernel(self, values):
        return filters.non_linear(values, tuple(self.widths), self.precision, self.power)


@dataclass(frozen=True)
class MeasureEndAlignmentTask(Task):
    """Cycles moved so that their measure phase ends at zero."""

    length: int = 10
    distance: float | None = None
    order = 8
    zattributes = ("distance",)

    def apply(self, frames: DataFrame) -> DataFrame:
        return alignment.measure_end(frames, self.length, self.distance)


@dataclass(frozen=True)
class BiasRemovalTask(Task):
    """Beads moved so that the values at the end of their measure phases are mostly at zero."""

    length: int = 10
    position: float = 5.0
    binsize: float = 1e-3
    delta: float = 1e-2
    order = 8
    zattributes = ("binsize", "delta")

    def apply(self, frames: DataFrame) -> DataFrame:
        bias = alignment.mode_bias(frames, self.binsize, self.length, self.position / 100, int(self.delta / self.binsize + 0.5))
        return frames.join(bias, statistics.BEAD, "left").withColumn("z", F.col("z") - F.coalesce("bias", F.lit(0.0))).drop("bias")


@dataclass(frozen=True)
class RampStatsTask(Task):
    """Statistics of each cycle of a ramp with its bead's status, or one row per opening or closing."""

    events: bool = False
    phases: tuple | None = None
    population: float = 80.0
    extension: tuple = (0.005, 0.05, 5.0)
    hfsigma: tuple = (1e-4, 5e-3)
    fixed_share: float = 80.0
    level, order = "project", 15
    zattributes = ("extension", "hfsigma")

    def apply(self, frames: DataFrame) -> DataFrame:
        rows = selection.with_phases(frames, *self.phases) if self.phases else frames
        if self.events:
            return ramps.ramp_events(rows)
        stats = ramps.ramp_stats(rows)
        status = ramps.ramp_status(stats, population=self.population, extension=tuple(self.extension), hfsigma=tuple(self.hfsigma), fixed_share=self.fixed_share)
        return stats.join(status, statistics.BEAD, "left").na.fill("bad", ["status"])


@dataclass(frozen=True)
class RampConsensusBeadTask(Task):
    """A bead's mean ramp, up and down."""

    level, order = "project", 15

    def apply(self, frames: DataFrame) -> DataFrame:
        return ramps.ramp_consensus(frames)


@dataclass(frozen=True)
class PeakCorrelationAlignmentTask(Task):
    """Events moved by the shift at which their cycle agrees best with all cycles, in rounds of moves."""

    precision: float = 3e-3
    level, order = "event", 11
    zattributes = ("precision",)

    def apply(self, found: DataFrame) -> DataFrame:
        sure = found.select(*statistics.BEAD).distinct().withColumn("precision", F.lit(float(self.precision)))
        return peaks.move_events(found, correlation.align_cycles(found, sure))


@dataclass(frozen=True)
class PeakProjectorTask(Task):
    """Frames become peaks without events in between."""

    distance: float = 2.0
    repeats: int = 1
    threshold: float = 0.05
    factor: float = 2.0
    phase: int = PHASES["measure"]
    level, order = "peak", 12

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        config = projection.Projection(distance=self.distance, repeats=self.repeats, threshold=self.threshold)
        precision = context.precision().withColumn("precision", F.col("precision") * self.factor)
        found = projection.project_peaks(context.signals, precision, config, self.phase)
        return found.join(context.bounds(self.phase).select(*statistics.CYCLE, "first"), statistics.CYCLE).withColumn("start", F.col("start") - F.col("first")).drop("first")


@dataclass(frozen=True)
class SingleStrandTask(Task):
    """The single-strand peak of cycles that don't close, and all peaks above it, go."""

    phase: int = PHASES["rampdown"]
    eventstart: int = 5
    delta: float = -0.015
    percentage: float = 50.0
    minframes: int = 10
    level, order = "peak", 12.2
    zattributes = ("delta",)

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        steps = statistics.steps(context.signals.where(F.col("phase") == self.phase))
        still = steps.groupBy(*statistics.CYCLE).agg(F.min("dz").alias("low"), F.count("*").alias("n")).where((F.col("low") > self.delta) & (F.col("n") >= self.minframes))
        strand = peaks.single_strand_peaks(rows, still.select(*statistics.CYCLE), context.bounds(PHASES["measure"]).drop("first", "stop"), within=self.eventstart, share=self.percentage / 100)
        return rows.join(strand, statistics.BEAD, "left").where("singlestrand is null or peakposition < singlestrand").drop("singlestrand")


@dataclass(frozen=True)
class BaselinePeakTask(Task):
    """The baseline peak and those below it go."""

    eventend: int = 5
    maxdisttozero: float = 0.015
    mineventpercentage: float = 10.0
    level, order, keep = "peak", 12.4, False
    zattributes = ("maxdisttozero",)

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        initial = statistics.phase_position(context.signals, PHASES["initial"])
        low = peaks.baseline_peaks(rows, context.cycles(), context.bounds(PHASES["measure"]).drop("first", "phase_start"), initial, reach=self.maxdisttozero, within=self.eventend, share=self.mineventpercentage / 100)
        return peaks.keep_above_baseline(rows, low, self.keep)


@dataclass(frozen=True)
class BaselinePeakFilterTask(BaselinePeakTask):
    """The peaks below the baseline go, the baseline itself stays."""

    keep = True


@dataclass(frozen=True)
class MinBiasPeakAlignmentTask(Task):
    """Cycles of events moved onto their peaks' means, by turns."""

    level, order, method = "peak", 12.6, "minbias"

    def apply(self, found: DataFrame) -> DataFrame:
        return peaks.move_events(found, peaks.peak_biases(found, self.method))


@dataclass(frozen=True)
class GELSPeakAlignmentTask(MinBiasPeakAlignmentTask):
    """The same in one least-squares solution."""

    method = "gels"


@dataclass(frozen=True)
class PeakProbabilityTask(Task):
    """Peaks' events become rates, durations and probabilities."""

    minduration: int = 5
    framerate: float = 30.0
    level, order = "peak", 13

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        return peaks.probabilities(rows, context.cycles(), context.bounds(PHASES["measure"]).drop("first", "phase_start"), rate=self.framerate, least=self.minduration)


@dataclass(frozen=True)
class FitToReferenceTask(Task):
    """Peaks on the scale of a reference: ``reference`` maps beads to positions."""

    reference: dict = field(default_factory=dict)
    spread: float = 0.1
    bias: tuple = (-20e-3, 20e-3)
    window: float = 5e-3
    method: str = "pairs"
    precision: float = 1e-3
    level, order = "peak", 13
    zattributes = ("bias", "window", "precision")

    def apply(self, found: DataFrame) -> DataFrame:
        """By ``pairs`` of peaks, or by densities: ``histogram``, ``corrected`` or ``chisquare``."""
        known = found.sparkSession.createDataFrame([(int(b), float(p)) for b, ps in self.reference.items() for p in ps], "bead bigint, peakposition double")
        own = found.select(*statistics.BEAD, "peakposition").distinct()
        if self.method == "pairs":
            fits = peaks.fit_reference(own, known, self.spread, tuple(self.bias), self.window)
        else:
            wide = F.lit(None).cast("double")
            middle, reach = sum(self.bias) / 2, (self.bias[1] - self.bias[0]) / 2
            grid = references.Grid((1.0, self.spread, self.spread / 2.5), (middle, reach, reach / 10))
            fits = references.fit_to_reference(known.withColumn("resolution", wide), own.withColumn("resolution", wide), self.precision, grid, method=self.method, pivot="absolute", window=self.window, first=0)
        return found.drop("stretch", "bias").join(fits, statistics.BEAD).withColumn("referenceposition", (F.col("peakposition") - F.col("bias")) * F.col("stretch"))


@dataclass(frozen=True)
class PeakFindingExcelTask(Task):
    """Report sheets of peaks: ``summary`` has a row per bead, ``peaks`` one per peak. With a path the sheet is written there as text."""

    sheet: str = "summary"
    path: str | None = None
    level, order = "peak", 15

    def rows_of(self, rows: DataFrame, context: Context) -> DataFrame:
        table = peaks.peak_table(rows, context.cycles())
        if self.sheet == "summary":
            return reports.summary_sheet(table, statistics.hf_sigma(context.signals, statistics.BEAD), context.cycles())
        spread = peaks.resolution(rows).select(*peaks.PEAK, "resolution")
        odds = peaks.probabilities(rows, context.cycles(), context.bounds(PHASES["measure"]).drop("first", "phase_start"))
        return table.drop("events", "hybridisationrate", "averageduration").join(spread, peaks.PEAK).join(odds.drop("ncycles", "ntoolong", "totalduration", "stddev", "good", "saturation", "likelyduration"), peaks.PEAK)

    def fold(self, rows: DataFrame, context: Context) -> DataFrame:
        out = self.rows_of(rows, context)
        if self.path:
            reports.write_csv(out, self.path)
        return out


@dataclass(frozen=True)
class HybridstatExcelTask(PeakFindingExcelTask):
    """The same with hairpins: ``summary`` has each bead's best fit, ``peaks`` the binding of each peak."""

    hairpins: dict = field(default_factory=dict)
    method: str = "grid"
    window: float = 10.0

    def rows_of(self, rows: DataFrame, context: Context) -> DataFrame:
        table = peaks.peak_table(rows, context.cycles()).drop("events").withColumn("status", F.lit(""))
        fits = peaks.fit_hairpins(table.select(*statistics.BEAD, "peakposition"), self.hairpins, self.method)
        best = peaks.beads_by_hairpin(fits)
        if self.sheet == "summary":
            return super().rows_of(rows, context).join(best, statistics.BEAD, "left")
        named = [(h, int(max(ps)), int(p), True) for h, ps in self.hairpins.items() for p in ps]
        known = rows.sparkSession.createDataFrame(named, "hpin string, strandsize int, position int, orientation boolean")
        return calling.identified_peaks(table, best, known, self.window).join(best.select(*statistics.BEAD, "silhouette"), statistics.BEAD)


#: Task types by name, as JSON has them.
TASKS: dict[str, type[Task]] = {}


def _register(kind: type[Task]) -> None:
    for sub in kind.__subclasses__():
        TASKS[sub.__name__] = sub
        _register(sub)


_register(Task)
#: What a task needs before it.
NEEDS = {PeakSelectorTask: EventDetectionTask, FitToHairpinTask: PeakSelectorTask, BeadsByHairpinTask: FitToHairpinTask, PeakCorrelationAlignmentTask: EventDetectionTask}


def check(tasks: list[Task]) -> None:
    """A root first and only first, each type once (actions aside), and no task on a coarser level than the rows that reach it."""
    if not tasks or not isinstance(tasks[0], RootTask):
        raise ValueError("a plan begins with a root task")
    kinds = [type(t) for t in tasks if not isinstance(t, ActionTask)]
    if len(set(kinds)) < len(kinds) or any(isinstance(t, RootTask) for t in tasks[1:]):
        raise ValueError("a plan holds each type of task once")
    reached = LEVELS.index(tasks[0].level)
    for task in tasks[1:]:
        if isinstance(task, ActionTask) or task.level in ("none", "project"):
            continue
        level = LEVELS.index(task.level)
        if reached > LEVELS.index("cycle") and level < reached:
            raise ValueError(f"{type(task).__name__} works on {task.level}s, after tasks that make {LEVELS[reached]}s of them")
        reached = max(reached, level)


def insert(tasks: list[Task], task: Task) -> list[Task]:
    """The list with the task in its place; one of the same type gives way."""
    rest = [t for t in tasks if type(t) is not type(task)]
    at = next((i for i, t in enumerate(rest) if t.order > task.order), len(rest))
    return [*rest[:at], task, *rest[at:]]


def complete(tasks: list[Task]) -> list[Task]:
    """The list with the tasks that others need, by their defaults."""
    for task in list(tasks):
        need = NEEDS.get(type(task))
        while need:
            if not any(isinstance(t, need) for t in tasks):
                tasks = insert(tasks, need())
            need = NEEDS.get(need)
    return tasks


def run(tasks: list[Task], frames: DataFrame | None = None, spark=None) -> DataFrame:
    """One plan for the whole list. Filters on beads come before the kernels as selections are ordered first."""
    tasks = complete(tasks)
    check(tasks)
    out = frames if isinstance(tasks[0], InMemoryTrackTask) else tasks[0].read(spark)
    context = Context()
    for task in [None, *tasks[1:]]:
        if task is not None and not task.disabled:
            out = task.fold(out, context)
        if {"frame", "z", "phase"} <= set(out.columns):
            context.signals = out
    return out


def rescale(tasks: list[Task], factor: float) -> list[Task]:
    """The list for signals in other units."""
    return [t.rescaled(factor) for t in tasks]


def dumps(tasks: list[Task]) -> str:
    """JSON of the list. Actions hold functions, which JSON can't, so a list with one is refused."""
    if any(isinstance(t, ActionTask) for t in tasks):
        raise ValueError("a list with an ActionTask can't be saved")
    return json.dumps([{"task": type(t).__name__, **{f.name: [json.loads(dumps([x]))[0] for x in v] if f.name == "tasks" else v for f in fields(t) for v in [getattr(t, f.name)]}} for t in tasks], sort_keys=True)


def loads(text: str) -> list[Task]:
    """Tasks from JSON; parameters that a task doesn't have are ignored."""
    out = []
    for x in json.loads(text):
        kind = TASKS[x.pop("task")]
        known = {f.name for f in fields(kind)}
        if "tasks" in x:
            x["tasks"] = loads(json.dumps(x["tasks"]))
        out.append(kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items() if k in known}))
    return out


def digest(tasks: list[Task]) -> str:
    """A name for a list of tasks."""
    return hashlib.sha256(dumps(tasks).encode()).hexdigest()


def _files(spark, path: str) -> list[str]:
    """Names, sizes and times of a path's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sorted(out)


def cached(tasks: list[Task], folder: str, frames: DataFrame | None = None, spark=None, name: str | None = None) -> DataFrame:
    """The plan's result, stored by a digest of the tasks and of what they read, and read from there the next time.

    Stored tracks count by their files' names, sizes and times. Frames in
    memory need a ``name``, which the caller changes with the data.
    """
    spark = spark or frames.sparkSession
    if frames is not None and name is None:
        raise ValueError("frames in memory need a name to be stored under")
    paths = [p for t in tasks for p in (t.paths_read() if isinstance(t, TrackReaderTask) else t.paths.values() if isinstance(t, BatchTask) else [])]
    key = json.dumps([dumps(tasks), name, [_files(spark, p) for p in paths]])
    path = f"{folder}/{hashlib.sha256(key.encode()).hexdigest()}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        run(tasks, frames, spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
