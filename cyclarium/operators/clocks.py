"""Phases of a track carried over to signals that have their own clock."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cyclarium.functions import clocks

PHASES = "track string, cycle int, phase int, start bigint"


def synchronize(samples: DataFrame, phases: DataFrame, bias: float = 0.0, at: int = 2, **options) -> DataFrame:
    """phases(track, cycle, phase, start) in the frames of ``samples`` (track, frame, z); one kernel per track.

    ``phases`` are those of the instrument that sets them; ``z`` steps once a
    cycle, where phase number ``at`` begins. A track without samples, or whose
    samples have no such rhythm, has no phases.
    """

    def run(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=["track", "cycle", "phase", "start"])
        if one.empty or two.empty:
            return out
        table = two.pivot_table(index="cycle", columns="phase", values="start").dropna().sort_index()
        z = one.sort_values("frame")["z"].to_numpy(np.float64, na_value=np.nan)
        made = clocks.synchronized(table.to_numpy(float), z, bias, at, **options)
        if not len(made):
            return out
        cycle, phase = np.meshgrid(np.arange(len(made)), table.columns.to_numpy(), indexing="ij")
        return pd.DataFrame({"track": key[0], "cycle": cycle.ravel(), "phase": phase.ravel(), "start": made.ravel()})

    own = samples.select("track", "frame", "z").groupBy("track")
    return own.cogroup(phases.select("track", "cycle", "phase", "start").groupBy("track")).applyInPandas(run, PHASES)
