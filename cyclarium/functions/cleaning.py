"""Cleaning kernels that depend on the order of values; arrays of doubles in, NaN for missing."""

from __future__ import annotations

import numpy as np


def constant_runs(z: np.ndarray, least: int = 3, tolerance: float = 1e-6) -> np.ndarray:
    """Runs of ``least`` values within ``tolerance`` of their first lose all but the first; missing ones count and don't end a run."""
    out, start = z.copy(), 0
    for i in range(1, len(z) + 1):
        if i == len(z) or not (np.isnan(z[i]) or abs(z[i] - z[start]) < tolerance):
            if i - start >= least:
                out[start + 1 : i] = np.nan
            start = i
    return out


def derivate(z: np.ndarray, max_distance: float = 5.0, max_derivate: float = 0.6, clip: bool = False) -> np.ndarray:
    """Values far from the median, or from the mean of their neighbours, go; with ``clip`` the former are clamped."""
    out = z.copy()
    good = np.flatnonzero(np.isfinite(z))
    if not len(good):
        return out
    v = z[good]
    median = np.median(v)
    far = np.abs(v - median) > max_distance
    before, after = np.roll(v, 1), np.roll(v, -1)
    before[0], after[-1] = v[1 if len(v) > 1 else 0], v[-2 if len(v) > 1 else -1]
    jump = np.abs(v - 0.5 * (before + after)) > max_derivate
    jump[[0, -1]] &= len(v) > 2
    if clip:
        out[good[far]] = np.clip(v[far], median - max_distance, median + max_distance)
        jump &= ~far
    else:
        jump |= far
    out[good[jump]] = np.nan
    return out


def local_missing(z: np.ndarray, window: int = 5, ratio: float = 20.0) -> np.ndarray:
    """Values with many missing both in the ``window`` before and after go."""
    out, n = z.copy(), len(z)
    least = int(window * ratio / 100 + 1)
    total = np.concatenate([[0], np.cumsum(~np.isfinite(z))])
    i = np.arange(window, n - window - 1)
    if len(i):
        both = (total[i] - total[i - window] >= least) & (total[i + 1 + window] - total[i + 1] >= least)
        out[i[both]] = np.nan
    return out


def islands(z: np.ndarray, river: int = 2, width: int = 10, ratio: float = 80.0, max_derivate: float = 0.6) -> np.ndarray:
    """Up to ``width`` values between stretches of missing ones go if most of them jump against their neighbours."""
    out = z.copy()
    bad = ~np.isfinite(z)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], bad, [True]]).astype(np.int8)))
    for start, stop in zip(edges[::2], edges[1::2]):
        if stop - start > width or start < river or stop + river > len(z):
            continue
        if not (bad[start - river : start].all() and bad[stop : stop + river].all()):
            continue
        v = z[start:stop]
        around = np.concatenate([[np.nan], v, [np.nan]])
        second = np.abs(v - 0.5 * (around[:-2] + around[2:]))
        if np.sum(~(second <= max_derivate)) * 100 >= ratio * len(v):
            out[start:stop] = np.nan
    return out


def aberrant(z: np.ndarray, *, clip: bool = False, min_share: float = 0.8) -> tuple[np.ndarray, bool]:
    """All four in turn, and whether too few values are left."""
    out = islands(local_missing(constant_runs(derivate(z, clip=clip))))
    return out, bool(len(out)) and float(np.isfinite(out).mean()) < min_share
