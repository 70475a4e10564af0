"""Task lists, readers, simulators and streams."""

import json

import pytest
from pyspark.sql import functions as F

from cyclarium.operators import statistics
from cyclarium.plans import tasks as plan
from cyclarium.sources import readers, simulators
from cyclarium.sources.fixtures import frames, short_signals
from cyclarium.streaming import cycles


def test_order_and_checks():
    tasks = plan.insert([plan.InMemoryTrackTask(), plan.PeakSelectorTask()], plan.DataCleaningTask())
    assert [t.order for t in tasks] == sorted(t.order for t in tasks)
    assert any(isinstance(t, plan.EventDetectionTask) for t in plan.complete(tasks))
    for bad in ([], [plan.DriftTask()], [plan.InMemoryTrackTask(), plan.DriftTask(), plan.DriftTask()]):
        with pytest.raises(ValueError):
            plan.check(bad)


def test_json_and_rescale():
    tasks = [plan.InMemoryTrackTask(), plan.DataCleaningTask(hfsigma=(1.0, 2.0)), plan.PeakSelectorTask(precision=2.0)]
    assert plan.loads(plan.dumps(tasks)) == tasks
    scaled = plan.rescale(tasks, 10.0)
    assert scaled[1].hfsigma == (10.0, 20.0) and scaled[2].precision == 20.0 and scaled[1].population == 80.0
    assert json.loads(plan.dumps(tasks))[0]["task"] == "InMemoryTrackTask"


def test_filters_reach_the_scan(spark, tmp_path):
    simulators.simulate_tracks(spark, 3, 4).write.parquet(str(tmp_path / "t.parquet"))
    tasks = [plan.TrackReaderTask(path=str(tmp_path / "t.parquet"), key="x"), plan.DataSelectionTask(selected=(1,)), plan.DataFrameTask(measures={"mean": "mean"})]
    out = plan.run(tasks, spark=spark)
    assert "EqualTo(bead,1)" in out._jdf.queryExecution().toString()
    assert [tuple(r)[:2] for r in out.collect()] == [("x", 1)]
    cached = plan.cached(tasks, str(tmp_path / "cache"), spark=spark)
    assert cached.collect() == plan.cached(tasks, str(tmp_path / "cache"), spark=spark).collect()


def test_simulated_peaks_are_found(spark):
    made = simulators.simulate_tracks(spark, 2, 60, durations=(1, 15, 1, 15, 1, 150, 1, 15), mean=20.0)
    tasks = [plan.InMemoryTrackTask(), plan.EventDetectionTask(), plan.PeakSelectorTask(precision=4e-3, align=False)]
    got = {(r.bead, round(r.peakposition, 2)) for r in plan.run(tasks, made).select("bead", "peakposition").distinct().collect()}
    assert all((b, p) in got for b in (0, 1) for p in (0.1, 0.3, 0.5))


def test_partitions_do_not_matter(spark, sf_dir):
    one = statistics.hf_sigma(frames(spark, sf_dir).coalesce(1)).orderBy("bead", "cycle").collect()
    many = statistics.hf_sigma(frames(spark, sf_dir).repartition(13)).orderBy("bead", "cycle").collect()
    assert one == many


def test_readers(spark, tmp_path):
    (tmp_path / "h.fasta").write_text("> GF1\nACGT\nacg\n>GF2\nttt\n")
    assert {tuple(r) for r in readers.open_track(spark, str(tmp_path / "h.fasta")).collect()} == {("GF1", "acgtacg"), ("GF2", "ttt")}
    (tmp_path / "a.txt").write_text("x\ny\nz\n% Time (s), Amplitude (V)\n" + "".join(f"{i / 10};{i * 1e-6}\n" for i in range(20)))
    rows = readers.open_track(spark, str(tmp_path / "a.txt"))
    assert rows.count() == 20
    assert readers.frame_rate(rows).first().framerate == pytest.approx(10)
    readers.save_tracks(simulators.simulate_tracks(spark, 2, 3), str(tmp_path / "saved"))
    assert readers.read_parquet(spark, str(tmp_path / "saved")).where("track = 'simulated'").count() == 2 * 3 * 40


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    signals = short_signals(spark, sf_dir).select("track", "bead", F.col("ts").cast("timestamp").alias("ts"), "z")
    signals.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(signals.schema).parquet(str(tmp_path / "in"))
    query = cycles.windowed(stream, "7 days").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    pick = lambda df: sorted(map(str, df.select("track", "bead", "window", "n", F.round("mean", 6)).collect()))
    assert pick(spark.table("windows")) == pick(cycles.windowed(signals, "7 days"))
    noise = cycles.running_noise(stream).writeStream.format("memory").queryName("noise").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    noise.processAllAvailable()
    noise.stop()
    assert spark.table("noise").agg(F.max("n")).first()[0] > 0
