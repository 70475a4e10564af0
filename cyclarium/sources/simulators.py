"""Simulated tracks, events and peaks with known truth; each bead has a seed of its own, so partitions don't matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.sources.fixtures import DURATIONS

FRAMES = "track string, bead bigint, frame bigint, cycle int, cycleframe bigint, phase int, z double"


def _beads(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "bead").repartition(F.col("bead"))


def cycle_signal(rng: np.random.Generator, durations: tuple[int, ...], peaks: list[float], rates: list[float], mean: float, brownian: float, drift: float) -> np.ndarray:
    """One cycle: a ramp up and down, then bindings in the measure phase, drift and noise."""
    top = max(peaks, default=1.0) + 0.3
    levels = [0.0, 0.0, top, top, top, 0.0, 0.0, 0.0]
    z = np.concatenate([np.linspace(levels[i - 1] if i in (2, 4) else levels[i], levels[i] if i != 4 else 0.0, d) for i, d in enumerate(durations)])
    start, size = sum(durations[:5]), durations[5]
    for peak, rate in sorted(zip(peaks, rates), reverse=True):
        if rng.random() < rate:
            at = rng.integers(0, max(size - 4, 1))
            length = max(4, int(rng.exponential(mean)))
            z[start + at : start + min(at + length, size)] = peak
    return z + drift * np.linspace(1, 0, len(z)) + rng.normal(0, brownian, len(z))


def simulate_tracks(spark: SparkSession, beads: int, cycles: int, *, durations: tuple[int, ...] = DURATIONS, peaks: list[float] = (0.1, 0.3, 0.5), rates: list[float] | None = None, mean: float = 8.0, brownian: float = 3e-3, drift: float = 0.0, seed: int = 0, track: str = "simulated") -> DataFrame:
    """frames of several beads."""
    rates = list(rates or [0.5] * len(peaks))
    phase = np.repeat(np.arange(len(durations)), durations)

    def run(batches):
        for rows in batches:
            for bead in rows["bead"]:
                rng = np.random.default_rng([seed, int(bead)])
                z = np.concatenate([cycle_signal(rng, durations, list(peaks), rates, mean, brownian, drift) for _ in range(cycles)])
                n = len(phase)
                yield pd.DataFrame({"track": track, "bead": bead, "frame": np.arange(len(z)), "cycle": np.repeat(np.arange(cycles), n), "cycleframe": np.tile(np.arange(n), cycles), "phase": np.tile(phase, cycles), "z": z})

    return _beads(spark, beads).mapInPandas(run, FRAMES)


def simulate_events(spark: SparkSession, beads: int, cycles: int, peaks: list[float], rates: list[float], *, brownian: float = 3e-3, mean: float = 10.0, stretch: float = 1.0, bias: float = 0.0, seed: int = 0) -> DataFrame:
    """events (…, avg, truth): per cycle a random subset of the peaks, with noise, stretch and bias."""

    def run(batches):
        for rows in batches:
            for bead in rows["bead"]:
                rng = np.random.default_rng([seed, int(bead)])
                out = []
                for c in range(cycles):
                    for k, p in enumerate(p for p, r in zip(peaks, rates) if rng.random() < r):
                        out.append(("simulated", bead, c, k, 20 * k, max(4, int(rng.exponential(mean))), p * stretch + bias + rng.normal(0, brownian), p))
                yield pd.DataFrame(out, columns=["track", "bead", "cycle", "event", "start", "length", "avg", "truth"])

    return _beads(spark, beads).mapInPandas(run, "track string, bead bigint, cycle int, event bigint, start bigint, length bigint, avg double, truth double")
