"""Peaks of a density as ridges through its wavelet transforms; arrays of doubles."""

from __future__ import annotations

import math

import numpy as np


def ricker(points: int, width: float) -> np.ndarray:
    """The negative second derivative of a gaussian of that width, at ``points`` places about its centre."""
    x = np.arange(points) - (points - 1) / 2
    u = (x / width) ** 2
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - u) * np.exp(-u / 2)


def transform(y: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """One row per width: the density's agreement with the wavelet at each place."""
    return np.array([np.convolve(y, ricker(min(10 * int(w), len(y)), w)[::-1], "same") for w in widths])


def ridges(rows: np.ndarray, reach: np.ndarray, gap: float) -> list[list[tuple[int, int]]]:
    """Lines (row, place) of maxima, from the widest row on: each goes on at the nearest maximum of the next row within ``reach``.

    A line ends after ``gap`` rows without one. A maximum that no line reaches begins a line.
    """
    n = rows.shape[1]
    top = np.zeros(rows.shape, bool)
    if n > 2:
        top[:, 1:-1] = (rows[:, 1:-1] > rows[:, :-2]) & (rows[:, 1:-1] > rows[:, 2:])
    open_, closed = [], []
    for r in range(len(rows) - 1, -1, -1):
        ends = np.array([line[-1][1] for line in open_])
        for place in np.flatnonzero(top[r]).tolist():
            near = int(np.abs(ends - place).argmin()) if len(ends) else -1
            if near >= 0 and abs(ends[near] - place) <= reach[r]:
                if open_[near][-1][0] == r:  # two maxima of a row reach one line: the nearer one stays
                    if abs(ends[near] - place) < abs(ends[near] - open_[near][-1][1]):
                        open_[near][-1] = (r, place)
                else:
                    open_[near].append((r, place))
            else:
                open_.append([(r, place)])
        closed += [line for line in open_ if line[-1][0] - r > gap]
        open_ = [line for line in open_ if line[-1][0] - r <= gap]
    return closed + open_


def find_peaks(y: np.ndarray, widths: np.ndarray | None = None, *, reach: np.ndarray | None = None, gap: float | None = None, least: int | None = None, snr: float = 1.0, noise: float = 10.0) -> np.ndarray:
    """Places of peaks, in order: the narrow ends of ridges that are long and stand out.

    ``widths`` are in bins. A ridge needs ``least`` rows (a quarter of them if
    not given), and at its narrow end ``snr`` times the percentile ``noise`` of
    the narrowest row about that place.
    """
    widths = np.arange(5, 11) if widths is None else np.asarray(widths)
    if len(y) < 3:
        return np.zeros(0, int)
    rows = transform(y, widths)
    lines = ridges(rows, widths / 4 if reach is None else np.asarray(reach), float(math.ceil(widths[0])) if gap is None else gap)
    least = math.ceil(len(widths) / 4) if least is None else least
    half = math.ceil(len(y) / 20) // 2
    out = []
    for line in lines:
        row, place = line[-1]
        floor = np.percentile(rows[0, max(0, place - half) : place + half + 1], noise)
        if len(line) >= least and abs(rows[row, place]) >= snr * abs(floor):
            out.append(place)
    return np.unique(np.array(out, int))
