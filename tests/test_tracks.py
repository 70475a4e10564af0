"""Many tracks from a listing of files, and results that follow the files."""

import os
import shutil
import time

import pytest

from cyclarium.plans import tasks as plan
from cyclarium.sources import simulators, tracks


def frames(spark, beads=2, seed=0):
    return simulators.simulate_tracks(spark, beads, 4, seed=seed).drop("track") if "seed" in simulators.simulate_tracks.__code__.co_varnames else simulators.simulate_tracks(spark, beads, 4).drop("track")


@pytest.fixture
def folder(spark, tmp_path):
    for i, name in enumerate(["exp_atc_1", "exp_gga_2"]):
        frames(spark, i + 1).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    frames(spark, 3).coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next(p for p in os.listdir(tmp_path / "one") if p.endswith(".parquet"))
    shutil.copy(tmp_path / "one" / part, tmp_path / "in" / "ref.parquet")
    (tmp_path / "in" / "notes.txt").write_text("no track")
    return tmp_path


MEANS = [plan.DataSelectionTask(phases=(1, 5)), plan.DataFrameTask(by=("track", "bead"), measures={"m": "mean", "n": "count"})]


def test_tracks_are_found_and_read_in_one_job(spark, folder):
    found = tracks.find_tracks(spark, str(folder / "in"))
    assert {r.track for r in found.collect()} == {"exp_atc_1", "exp_gga_2", "ref"} and found.where("bytes <= 0").count() == 0
    assert {r.track for r in tracks.find_tracks(spark, str(folder / "in"), name="_([acgt]{3})_").collect()} == {"atc", "gga"}
    assert {r.track for r in tracks.find_tracks(spark, str(folder / "in"), "exp_?ga*").collect()} == {"exp_gga_2"}
    rows = tracks.track_frame(spark, str(folder / "in"), MEANS).collect()
    assert {(r.track, r.bead) for r in rows} == {("exp_atc_1", 0), ("exp_gga_2", 0), ("exp_gga_2", 1), ("ref", 0), ("ref", 1), ("ref", 2)}
    for name in ("exp_gga_2", "ref"):
        alone = plan.run([plan.TrackReaderTask(path=str(folder / "in" / f"{name}.parquet"), key=name), *MEANS], spark=spark)
        assert sorted(map(tuple, alone.collect())) == sorted(tuple(r) for r in rows if r.track == name)
    with pytest.raises(ValueError):
        tracks.read_tracks(spark, "x", found.where("false"))


def test_names(spark, folder):
    found = tracks.find_tracks(spark, str(folder / "in"), "exp*")
    assert {tuple(r) for r in tracks.short_names(found).collect()} == {("exp_atc_1", "atc_1"), ("exp_gga_2", "gga_2")}
    assert {tuple(r) for r in tracks.oligo_names(found).collect()} == {("exp_atc_1", "atc", "gat"), ("exp_gga_2", "gga", "tcc")}


def test_only_changed_tracks_are_computed(spark, folder):
    seen = []

    def go():
        out = tracks.update(spark, str(folder / "in"), MEANS, str(folder / "out"))
        seen.append({(r.track, r.bead, r.n) for r in out.collect()})
        return {n: os.stat(p).st_mtime_ns for n in os.listdir(results) for p in [os.path.join(results, n)] if n.startswith("track=")}

    results = str(folder / "out" / plan.digest(MEANS) / "results")
    first = go()
    assert {t for t, _, _ in seen[0]} == {"exp_atc_1", "exp_gga_2", "ref"}
    time.sleep(1.1)
    assert go() == first and seen[1] == seen[0]
    frames(spark, 5).write.mode("overwrite").parquet(str(folder / "in" / "exp_atc_1.parquet"))
    frames(spark, 1).write.parquet(str(folder / "in" / "new.parquet"))
    os.remove(folder / "in" / "ref.parquet")
    third = go()
    assert {(t, b) for t, b, _ in seen[2]} == {("exp_atc_1", b) for b in range(5)} | {("exp_gga_2", 0), ("exp_gga_2", 1), ("new", 0)}
    assert third["track=exp_gga_2"] == first["track=exp_gga_2"] and third["track=exp_atc_1"] != first["track=exp_atc_1"]
    assert tracks.update(spark, str(folder / "in"), MEANS[1:], str(folder / "out")).count() == 8


def test_many_paths_in_one_task(spark, folder):
    paths = {"a": str(folder / "in" / "exp_atc_1.parquet"), "b": str(folder / "in" / "ref.parquet")}
    tasks = [plan.TrackReaderTask(path=paths), *MEANS]
    rows = plan.run(plan.loads(plan.dumps(tasks)), spark=spark).collect()
    assert {(r.track, r.bead) for r in rows} == {("a", 0), ("b", 0), ("b", 1), ("b", 2)}
    assert plan.cached(tasks, str(folder / "kept"), spark=spark).count() == 4
