"""Frames as a stream: windows of time, cycles closed by gaps, and noise kept per bead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["track", "bead"]


def _late(signals: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs timestamps with a zone; a batch as it is."""
    return signals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if signals.isStreaming else signals


def windowed(signals: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, smallest and largest value per bead and window of (track, bead, ts, z)."""
    rows = _late(signals, late)
    return rows.groupBy(*KEY, F.window("ts", window, slide or window)).agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("low"), F.max("z").alias("high"))


def gap_cycles(signals: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Cycles of each bead, parted by gaps in time."""
    rows = _late(signals, late)
    return rows.groupBy(*KEY, F.session_window("ts", gap)).agg(F.count("z").alias("n"), F.avg("z").alias("mean"))


def running_noise(signals: DataFrame, keep: int = 256) -> DataFrame:
    """After each batch every bead's median absolute step over its latest ``keep`` values (track, bead, n, hfsigma)."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, values = state.get if state.exists else (0, [])
        rows = pd.concat(list(parts)).sort_values("ts")
        new = rows["z"].dropna().tolist()
        values = (list(values) + new)[-keep:]
        state.update((seen + len(new), values))
        noise = float(np.median(np.abs(np.diff(values)))) if len(values) > 1 else None
        yield pd.DataFrame({"track": [key[0]], "bead": [key[1]], "n": [seen + len(new)], "hfsigma": [noise]})

    return signals.groupBy(*KEY).applyInPandasWithState(update, "track string, bead bigint, n bigint, hfsigma double", "seen bigint, values array<double>", "update", GroupStateTimeout.NoTimeout)
