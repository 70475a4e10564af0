"""Every task: its JSON, and a plan that runs it."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclarium.functions import peaks as kernels
from cyclarium.operators import cleaning, peaks, ramps, reports, selection, statistics
from cyclarium.plans import tasks as plan
from cyclarium.sources import simulators

DURATIONS = (1, 15, 1, 15, 12, 150, 1, 15)
HAIRPINS = {"GF1": [114.0, 341.0, 568.0], "GF2": [114.0, 250.0, 800.0]}


@pytest.fixture(scope="module")
def signals(spark):
    return simulators.simulate_tracks(spark, 2, 30, durations=DURATIONS, mean=20.0).cache()


@pytest.fixture(scope="module")
def events(spark, signals):
    return plan.run([plan.InMemoryTrackTask(), plan.EventDetectionTask(), plan.PeakSelectorTask(precision=4e-3, align=False)], signals).cache()


def after(signals, *tasks):
    return plan.run([plan.InMemoryTrackTask(), *tasks], signals)


def test_all_tasks_round_trip():
    assert len(plan.TASKS) == 47
    for kind in plan.TASKS.values():
        if kind is not plan.ActionTask:
            task = kind(tasks=(plan.DataSelectionTask(selected=(1,)),), paths={"a": "b"}) if issubclass(kind, plan.BatchTask) else kind()
            assert plan.loads(plan.dumps([task])) == [task]
            assert dataclasses.replace(task, disabled=True).disabled
    with pytest.raises(ValueError):
        plan.dumps([plan.InMemoryTrackTask(), plan.ActionTask()])


def test_levels_are_checked():
    plan.check([plan.InMemoryTrackTask(), plan.EventDetectionTask(), plan.PeakSelectorTask(), plan.PeakProbabilityTask()])
    for bad in ([plan.InMemoryTrackTask(), plan.EventDetectionTask(), plan.DriftTask()], [plan.EventSimulatorTask(), plan.DataCleaningTask()], [plan.InMemoryTrackTask(), plan.PeakProjectorTask(), plan.EventDetectionTask()]):
        with pytest.raises(ValueError):
            plan.check(bad)


@pytest.mark.parametrize(
    "task",
    [plan.RawPrecisionTask(computer="normalized"), plan.CycleCreatorTask(first=1, last=5), plan.ForwardBackwardFilterTask(), plan.NonLinearFilterTask(), plan.MeasureEndAlignmentTask(), plan.BiasRemovalTask()],
    ids=lambda t: type(t).__name__,
)
def test_signals_stay_signals(signals, task):
    out = after(signals, task)
    assert out.columns == signals.columns
    n = signals.where("phase between 1 and 5").count() if isinstance(task, plan.CycleCreatorTask) else signals.count()
    assert out.count() == n


def test_end_of_the_measure_phase_is_zero(signals):
    back = F.row_number().over(plan.events.W.partitionBy("bead", "cycle", "phase").orderBy(F.col("frame").desc()))
    ends = after(signals, plan.MeasureEndAlignmentTask(length=10)).withColumn("_i", back).where("phase = 5 and _i <= 10").groupBy("bead", "cycle").agg(F.avg("z").alias("m"))
    assert ends.where("abs(m) > 1e-9").count() == 0
    moved = after(signals.withColumn("z", F.col("z") + 0.7), plan.BiasRemovalTask())
    assert abs(moved.where("phase = 1").agg(F.median("z")).first()[0]) < 5e-3


def test_filters_lessen_noise(signals):
    noise = lambda df: df.where("phase = 1").agg(F.stddev("z")).first()[0]
    for task in (plan.ForwardBackwardFilterTask(power=2.0), plan.NonLinearFilterTask(power=2.0)):
        assert noise(after(signals, task)) < 0.8 * noise(signals)


def test_errors_of_one_bead(signals):
    class FailsOnOne(plan.DataFunctorTask):
        def kernel(self, values):
            if abs(values[0]) > 50:
                raise ValueError("odd bead")
            return values

    odd = signals.withColumn("z", F.when(F.col("bead") == 1, 100.0).otherwise(F.col("z")))
    assert {r.bead for r in after(odd, plan.ExceptionCatchingTask(), FailsOnOne()).select("bead").distinct().collect()} == {0}
    with pytest.raises(Exception, match="odd bead"):
        after(odd, FailsOnOne()).collect()


def test_simulated_roots(spark):
    frames = plan.run([plan.TrackSimulatorTask(beads=2, cycles=3)], spark=spark)
    assert frames.count() == 2 * 3 * 40
    made = plan.run([plan.EventSimulatorTask(beads=2, cycles=50)], spark=spark)
    assert 100 < made.count() < 200
    known = plan.run([plan.ByPeaksEventSimulatorTask(beads=1, cycles=100, peaks=(0.5, 0.1))], spark=spark).groupBy("peak").agg(F.avg("peakposition").alias("p"), F.count("*").alias("n")).orderBy("peak").collect()
    assert [r.peak for r in known] == [0, 1] and np.allclose([r.p for r in known], [0.1, 0.5], atol=2e-3)
    aligned = plan.run([plan.ByPeaksEventSimulatorTask(beads=1, cycles=40), plan.MinBiasPeakAlignmentTask()], spark=spark)
    assert aligned.agg(F.max(F.abs("bias"))).first()[0] < 0.02


def test_batches(spark, signals, tmp_path):
    for k in ("a", "b"):
        signals.drop("track").withColumn("track", F.lit("x")).write.parquet(str(tmp_path / k))
    paths = {k: str(tmp_path / k) for k in ("a", "b")}
    rows = plan.run([plan.BatchTask(paths=paths, tasks=(plan.DataFrameTask(measures={"m": "mean"}),))], spark=spark).collect()
    assert sorted((r.track, r.bead) for r in rows) == [(k, b) for k in ("a", "b") for b in (0, 1)]
    cleaning, grouping = plan.DataCleaningTask(hfsigma=(1e-4, 1.0), extent=(0.0, 9.0), pingpong=1e6, saturation=9.0, aberrant=False), plan.PeakSelectorTask(precision=4e-3, align=False)
    peaks_ = plan.run([plan.PeakFindingBatchTask(paths=paths, tasks=(cleaning, grouping))], spark=spark)
    assert {r.track for r in peaks_.select("track").distinct().collect()} == {"a", "b"}
    fits = plan.run([plan.HybridstatBatchTask(paths=paths, tasks=(cleaning, grouping), hairpins=HAIRPINS)], spark=spark).collect()
    assert sorted((r.track, r.bead) for r in fits) == [(k, b) for k in ("a", "b") for b in (0, 1)] and {r.hpin for r in fits} == {"GF1"}


def test_results_are_kept_by_what_they_read(spark, signals, tmp_path):
    tasks = [plan.InMemoryTrackTask(), plan.DataFrameTask(measures={"m": "mean"})]
    mean = lambda df, name: plan.cached(tasks, str(tmp_path / "kept"), df, name=name).agg(F.avg("m")).first()[0]
    one, five = (signals.withColumn("z", F.lit(x)) for x in (1.0, 5.0))
    assert (mean(one, "one"), mean(five, "five")) == (1.0, 5.0)
    with pytest.raises(ValueError):
        plan.cached(tasks, str(tmp_path / "kept"), one)
    with pytest.raises(ValueError):
        plan.cached([*tasks, plan.ActionTask(call=lambda f: f)], str(tmp_path / "kept"), one, name="one")
    stored = [plan.TrackReaderTask(path=str(tmp_path / "t"), key="t"), plan.DataFrameTask(measures={"m": "mean"})]
    for frames, want in ((one, 1.0), (five, 5.0)):
        frames.write.mode("overwrite").parquet(str(tmp_path / "t"))
        assert plan.cached(stored, str(tmp_path / "kept"), spark=spark).agg(F.avg("m")).first()[0] == want


def test_peak_filters_and_tables(signals, events):
    tasks = [plan.EventDetectionTask(), plan.PeakSelectorTask(precision=4e-3, align=False)]
    every = {round(r.peakposition, 2) for r in events.select("peakposition").distinct().collect()}
    assert {0.0, 0.1, 0.3, 0.5} <= every
    positions = lambda *more: {round(r.peakposition, 2) for r in after(signals, *tasks, *more).select("peakposition").distinct().collect()}
    assert min(positions(plan.BaselinePeakTask())) > 0.015 and min(positions(plan.BaselinePeakFilterTask())) < 0.01
    assert positions(plan.SingleStrandTask()) <= every
    odds = after(signals, *tasks, plan.PeakProbabilityTask(minduration=4)).where("nevents > 5").collect()
    assert odds and all(0 < r.hybridisationrate <= 1 and 0 <= r.probability <= 1 for r in odds)
    for kind in (plan.PeakFindingExcelTask, plan.HybridstatExcelTask):
        own = {"hairpins": HAIRPINS} if kind is plan.HybridstatExcelTask else {}
        summary, sheet = (after(signals, *tasks, kind(sheet=x, **own)) for x in ("summary", "peaks"))
        assert summary.count() == 2 and sheet.count() == events.select("bead", "peak").distinct().count()
    aligned = after(signals, plan.EventDetectionTask(), plan.PeakCorrelationAlignmentTask(), plan.PeakSelectorTask(precision=4e-3, align=False))
    assert {0.1, 0.3, 0.5} <= {round(r.peakposition, 1) for r in aligned.select("peakposition").distinct().collect()}
    for kind in (plan.MinBiasPeakAlignmentTask, plan.GELSPeakAlignmentTask):
        assert after(signals, *tasks, kind()).count() == events.count()


def test_report_is_written(spark, signals, tmp_path):
    tasks = [plan.EventDetectionTask(), plan.PeakSelectorTask(precision=4e-3, align=False), plan.PeakFindingExcelTask(path=str(tmp_path / "r"))]
    n = after(signals, *tasks).count()
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "r")).count() == n == 2


def test_projection_and_reference(signals, spark):
    found = after(signals, plan.PeakProjectorTask())
    at = {round(r.peakposition, 2) for r in found.select("peakposition").distinct().collect()}
    assert {0.0, 0.1, 0.3, 0.5} <= at
    reference = {b: [p * 1.03 + 0.01 for p in (0.0, 0.1, 0.3, 0.5)] for b in (0, 1)}
    placed = after(signals, plan.EventDetectionTask(), plan.PeakSelectorTask(precision=4e-3, align=False), plan.FitToReferenceTask(reference=reference))
    assert placed.select("bead", "stretch").distinct().count() == 2
    assert all(abs(r.stretch - 1.03) < 0.02 for r in placed.select("stretch").distinct().collect())


def ramp(spark):
    """Bead 0 opens and closes, bead 1 stays, bead 2 is noise."""
    rng, rows = np.random.default_rng(1), []
    for cycle in range(5):
        for i in range(80):
            zmag = -abs(i - 40) / 50
            z = {0: float(15 < i < 65), 1: 0.0, 2: rng.normal(0, 1)}
            rows += [("t", b, cycle * 80 + i, cycle, i, 3, v + rng.normal(0, 1e-3), zmag) for b, v in z.items()]
    return spark.createDataFrame(rows, "track string, bead bigint, frame bigint, cycle int, cycleframe int, phase int, z double, zmag double")


def test_ramps(spark):
    rows = ramp(spark)
    status = {r.bead: r.status for r in ramps.ramp_status(ramps.ramp_stats(rows), beads=rows.union(rows.withColumn("bead", F.col("bead") + 7))).collect()}
    assert status == {0: "ok", 1: "fixed", 2: "bad", 7: "bad", 8: "bad", 9: "bad"}
    out = after(rows, plan.RampStatsTask())
    assert {(r.bead, r.status) for r in out.select("bead", "status").distinct().collect()} == {(0, "ok"), (1, "fixed"), (2, "bad")}
    kinds = after(rows.where("bead = 0"), plan.RampStatsTask(events=True)).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"open": 5, "close": 5}
    assert after(rows, plan.RampConsensusBeadTask()).count() > 0
    kept = after(rows, plan.RampDataCleaningTask(hfsigma=(1e-4, 1e-2), extent=(0.5, 2.0), pingpong=1e9, aberrant=False))
    assert {r.bead for r in kept.select("bead").distinct().collect()} == {0}


def test_probabilities_by_hand(spark):
    rows = [("t", 1, c, 0, s, n, 0.5, 0.5) for c, s, n in ((0, 0, 10), (1, 5, 5), (1, 12, 8), (2, 3, 17))]
    found = spark.createDataFrame(rows, "track string, bead bigint, cycle int, peak int, start bigint, length bigint, avg double, peakposition double")
    cycles = spark.createDataFrame([("t", 1, 6)], "track string, bead bigint, ncycles bigint")
    limits = spark.createDataFrame([("t", 1, c, 19) for c in range(6)], "track string, bead bigint, cycle int, stop bigint")
    r = peaks.probabilities(found, cycles, limits, rate=10.0, least=5).first()
    p = (1 / 3) / (1 / 3 + 42 / 3 - 5)
    assert (r.nevents, r.ntoolong, r.totalduration, r.hybridisationrate, r.good) == (3, 2, 42, 0.5, True)
    assert r.averageduration == pytest.approx(1.4) and r.probability == pytest.approx(p) and r.saturation == pytest.approx(200 / 3)
    assert r.likelyduration == pytest.approx(-1 / (10 * math.log(1 - p))) and r.uncertainty == pytest.approx(r.likelyduration)
    assert r.stddev == pytest.approx(math.sqrt(1 - p) / (1 / 3 + 42 / 3 - 5))


def test_cost_by_hand():
    theory = np.array([0.0, 100.0, 200.0, 300.0])
    assert kernels.chi_squared(theory, theory, 1.0, 0.0) == 0
    assert kernels.chi_squared(theory, theory + 1000, 1.0, 0.0) == kernels.NO_MATCH
    placed = np.array([-2.0, 103.0, 198.0, 260.0, 330.0])
    square = (4 + 9 + 4) / 100
    assert kernels.chi_squared(theory, placed, 1.0, 0.0) == pytest.approx(math.sqrt((square + 0.04 + (9 - 6) ** 2) / 6))
    assert kernels.chi_squared(theory, placed, 1.0, 0.0, singlestrand=True, symmetry="left") == pytest.approx(math.sqrt((square + 0.04 + 9 + (4 - 3) ** 2) / 3))
    assert kernels.chi_squared(theory[1:], placed, 1.0, 0.0, symmetry="right") == pytest.approx(math.sqrt((0.09 + 0.04 + (5 - 2) ** 2) / 2))


def brute_fit(theory, placed, stretch, spread, bias, window):
    """The least cost over all pairs of pairs, each also refitted."""
    best = (kernels.NO_MATCH, stretch, 0.0)
    options = [(stretch, 0.0)]
    for i in range(len(theory)):
        for j in range(i + 1, len(theory)):
            for k in range(len(placed)):
                for m in range(k + 1, len(placed)):
                    s = (theory[j] - theory[i]) / (placed[m] - placed[k])
                    b = placed[k] - theory[i] / s
                    if abs(s / stretch - 1) <= spread and bias[0] <= b <= bias[1]:
                        options.append((s, b))
    for s, b in options:
        for x in ((s, b), kernels.refit(theory, placed, s, b, window)):
            best = min(best, (kernels.chi_squared(theory, placed, *x, window), *x))
    return best


def test_grid_fit_leaves_no_candidate_out():
    rng = np.random.default_rng(3)
    for _ in range(25):
        theory = np.sort(rng.uniform(0, 900, rng.integers(2, 9)))
        keep = rng.random(len(theory)) < 0.8
        placed = np.sort(np.concatenate([theory[keep] / 1130 * 1.02 + 0.01, rng.uniform(0, 0.8, 2)])) + rng.normal(0, 1e-3, keep.sum() + 2)
        placed = np.sort(placed)
        want = brute_fit(theory, placed, 1 / 8.8e-4, 0.1, (-0.05, 0.05), 10.0)
        assert kernels.grid_fit(theory, placed)[0] == pytest.approx(want[0])


def test_baseline_group_stays():
    values, places = np.array([0.0, 0.05, 0.051, 0.5, 0.5, 0.5, 0.8]), np.array([0.0, 0.05, 0.5, 0.8])
    assert kernels.flag(values, places, 0.01, 3).tolist() == [-1, -1, -1, 2, 2, 2, -1]
    assert kernels.flag(values, places, 0.01, 3, 0.1).tolist() == [-1, 1, 1, 2, 2, 2, -1]
    assert kernels.flag(values[[0, 1]], places, 0.01, 3, 0.1).tolist() == [0, -1]


def test_carry_over_rules(spark):
    names = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(reports.overlapping(F.col("a"), F.col("b"))).first()[0]
    assert not names("tca", "agt") and names("agc", "gct") and names("gct", "agc") and names("agc", "agc")
    rows = [(1, "tca", t, p, n, True) for t, p, n in ((1, 0.1, 10),)] + [(1, "agt", 2, 0.101, n, k) for n, k in ((6, True), (5, True), (4, False))]
    peaks_ = spark.createDataFrame([(b, o, o, t, p, n, k) for b, o, t, p, n, k in rows], "bead int, track string, oligo string, modification int, position double, count int, keep boolean")
    one = lambda n: reports.carry_over(peaks_.where(f"count in (10, {n})")).count()
    assert (one(6), one(5), one(4)) == (0, 1, 0)
    assert reports.carry_over(peaks_.where("count in (10, 6)"), ratio=0.6).count() == 1


@pytest.mark.parametrize("kept", [(True, False), (False, True)])
def test_carry_over_looks_at_all_rows_of_a_place(spark, kept):
    rows = [(1, "x", "tca", 1, 0.1, 10, True)] + [(1, "y", "agt", 2, 0.101, 5, k) for k in kept]
    peaks_ = spark.createDataFrame(rows, "bead int, track string, oligo string, modification int, position double, count int, keep boolean").coalesce(1)
    assert [(r.track, r.next_track) for r in reports.carry_over(peaks_).collect()] == [("x", "y")]
    assert reports.carry_over(peaks_.where("keep is distinct from true or track = 'x'")).count() == 0


def test_drops_are_unknown_where_no_frame_can_be_judged(spark):
    rows = [("t", 1, c, i, z) for c, signal in enumerate(([9.0, 1.0, 1.0], [9.0, 8.0, 8.0], [9.0, None, 1.0])) for i, z in enumerate(signal)]
    out = cleaning.drops(spark.createDataFrame(rows, "track string, bead int, cycle int, frame int, z double"), -5.0)
    assert {r.cycle: r.drops for r in out.collect()} == {0: 1, 1: 0, 2: None}


def test_rolling_tells_the_first_of_equal_extremes(spark):
    rows = [("t", 1, i, z) for i, z in enumerate([5.0, 1.0, 1.0, 7.0, 7.0, None, 1.0])]
    out = statistics.rolling(spark.createDataFrame(rows, "track string, bead int, frame int, z double"), 2, 2).orderBy("frame").collect()
    assert [r.low_at for r in out] == [1, 1, 1, 1, 2, 6, 6]
    assert [r.high_at for r in out] == [0, 3, 3, 3, 3, 3, 4]


def test_confusion_by_hand(spark):
    theory = spark.createDataFrame([("t", "positive", 10.0), ("t", "positive", 50.0), ("t", "negative", 30.0), ("t", "negative", 51.0), ("t", "negative", 90.0)], "track string, strand string, theopos double")
    found = spark.createDataFrame([("t", 10.0, x) for x in (9.8, 10.1, 12.0)] + [("t", 30.2, 30.3), ("t", 50.6, 50.6)], "track string, peakposition double, avg double")
    row = reports.confusion(found, theory).first()
    assert (row.TP, row.FN, row.FP, row.TN) == (2, 0, 1, 2)


def test_closest(spark):
    points = spark.createDataFrame([(1, x) for x in (-5.0, 2.0, 3.0, 99.0)] + [(2, 1.0), (3, None)], "k int, position double")
    targets = spark.createDataFrame([(1, 0.0), (1, 4.0), (1, 4.0), (1, None)], "k int, target double")
    out = {(r.k, r.position): r.closest for r in selection.closest(points, targets, ["k"]).collect()}
    assert out == {(1, -5.0): 0.0, (1, 2.0): 4.0, (1, 3.0): 4.0, (1, 99.0): 4.0, (2, 1.0): None, (3, None): None}


def plain_filters(z, widths, precision, power, window):
    """Both filters by loops over windows."""
    v = [x for x in z if not math.isnan(x)]
    weigh = lambda chi, n: 4.0**-power if n == 1 else (chi * n / (n - 1) + 2 * math.sqrt(n) / (n - 1)) ** -power
    both, ends = [[] for _ in v], [[] for _ in v]
    for flip in (False, True):
        x = v[::-1] if flip else v
        for n in widths:
            means = [sum(x[max(0, i - n + 1) : i + 1]) / min(n, i + 1) for i in range(len(x))]
            off = [((a - m) / precision) ** 2 for a, m in zip(x, means)]
            for i, m in enumerate(means):
                near = off[max(0, i - window + 1) : i + 1]
                both[len(v) - 1 - i if flip else i].append((weigh(sum(near) / len(near), n), m))
    for n in widths:
        for i in range(len(v)):
            own = v[max(0, i - n + 1) : i + 1]
            m = sum(own) / len(own)
            pair = weigh(sum((a - m) ** 2 for a in own) / len(own) / precision**2, n), m
            ends[i].append(pair)
            if len(own) == n:
                ends[i - n + 1].append(pair)
    return [[sum(w * m for w, m in row) / sum(w for w, _ in row) for row in rows] for rows in (both, ends)]


def test_filters_by_loops():
    from cyclarium.functions import filters

    rng = np.random.default_rng(4)
    z = np.concatenate([rng.normal(x, 3e-3, 20) for x in (0, 0.1, 0.05)])
    z[[3, 17, 40]] = np.nan
    for widths, power in (((1, 5, 15), 2.0), ((1, 3), 6.0)):
        both, ends = plain_filters(z, widths, 3e-3, power, 10)
        good = np.isfinite(z)
        np.testing.assert_allclose(filters.forward_backward(z, widths, 3e-3, power)[good], both, rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(filters.non_linear(z, widths, 3e-3, power)[good], ends, rtol=1e-7, atol=1e-9)
        assert np.isnan(filters.forward_backward(z)[~good]).all()
