"""Filters and profiles over whole signals; arrays of doubles, NaN for missing."""

from __future__ import annotations

import numpy as np


def _trailing(z: np.ndarray, width: int) -> np.ndarray:
    """Mean of up to ``width`` values that end at each place."""
    i = np.arange(len(z)) + 1
    n = np.minimum(i, width)
    total = np.concatenate([[0.0], np.cumsum(z)])
    return (total[i] - total[i - n]) / n


#: Weights are cut off here: the largest 32-bit number.
MOST = 3.4028234663852886e38


def _weights(chi: np.ndarray, width: int, power: float) -> np.ndarray:
    """What a mean of ``width`` values counts if its squared residuals over the precision's are ``chi``: less with more, and more for wide ones."""
    if width <= 1:
        return np.full(len(chi), min(4.0**-power, MOST))
    base = np.maximum(chi, 0) * width / (width - 1) + 2 * np.sqrt(width) / (width - 1)
    with np.errstate(over="ignore", divide="ignore"):
        return np.minimum(base**-power, MOST)


def forward_backward(z: np.ndarray, widths: tuple[int, ...] = (1, 5, 15), precision: float = 3e-3, power: float = 20.0, window: int = 10) -> np.ndarray:
    """Means of several widths up to each value, from both sides, weighted by how well each has lately (over ``window`` values) told the value it ends at."""
    out, good = z.copy(), np.isfinite(z)
    v = z[good]
    if not len(v):
        return out
    total, weight = np.zeros(len(v)), np.zeros(len(v))
    for flip in (1, -1):
        x = v[::flip]
        for width in widths:
            mean = _trailing(x, width)
            w = _weights(_trailing(((x - mean) / precision) ** 2, window), width, power)
            total += (w * mean)[::flip]
            weight += w[::flip]
    out[good] = total / weight
    return out


def non_linear(z: np.ndarray, widths: tuple[int, ...] = (1, 5, 15), precision: float = 3e-3, power: float = 20.0) -> np.ndarray:
    """Means of windows of several widths that begin or end at each value, weighted by how little the window's values scatter.

    Signals no longer than the widest window stay as they are.
    """
    out, good = z.copy(), np.isfinite(z)
    v = z[good]
    if len(v) <= max(widths):
        return out
    v = v - v[0]
    total, weight = np.zeros(len(v)), np.zeros(len(v))
    for width in widths:
        mean = _trailing(v, width)
        w = _weights((_trailing(v * v, width) - mean * mean) / precision**2, width, power)
        total += w * mean
        weight += w
        if len(v) >= width:
            whole = len(v) - width + 1
            total[:whole] += (w * mean)[width - 1 :]
            weight[:whole] += w[width - 1 :]
    out[good] = total / weight + z[good][0]
    return out


def kernel(width: float = 1.0, window: int = 4, oversampling: int = 5, mode: str = "normal") -> np.ndarray:
    """A normalised smoothing kernel over ``window`` widths to each side."""
    half = int(window * width * oversampling)
    x = np.arange(-half, half + 1) / oversampling
    y = np.exp(-0.5 * (x / width) ** 2) if mode == "normal" else (np.abs(x) <= width).astype(float)
    return y / y.sum()


def collapse_to_mean(stretches: list[tuple[int, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """A profile from the right: each stretch (start, values) is shifted onto the mean of those so far. Also the counts."""
    total, count = np.zeros(size), np.zeros(size)
    for start, values in sorted(stretches, key=lambda s: s[0] + len(s[1]), reverse=True):
        at = slice(start, start + len(values))
        known = count[at] > 0
        shift = np.mean(total[at][known] / count[at][known] - values[known]) if known.any() else 0.0
        total[at] += values + shift
        count[at] += 1
    return np.where(count > 0, total / np.maximum(count, 1), 0.0), count


def collapse_by_derivate(stretches: list[tuple[int, np.ndarray]], size: int, mode: str = "median") -> tuple[np.ndarray, np.ndarray]:
    """A profile from each frame's median or mean step, summed from the right. Also the counts."""
    steps: list[list[float]] = [[] for _ in range(size)]
    for start, values in stretches:
        for i, d in enumerate(np.diff(values)):
            steps[start + i].append(d)
    what = np.median if mode == "median" else np.mean
    each = np.array([what(s) if s else 0.0 for s in steps])
    return -np.concatenate([np.cumsum(each[:-1][::-1])[::-1], [0.0]]) if size else np.zeros(0), np.array([len(s) for s in steps])


def collapse_by_merging(stretches: list[tuple[int, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two stretches that overlap most are merged again and again. Also the counts."""
    parts = [(np.pad(v.astype(float), (s, size - s - len(v))), np.pad(np.ones(len(v)), (s, size - s - len(v)))) for s, v in stretches]
    while len(parts) > 1:
        pairs = [(int(((a[1] > 0) & (b[1] > 0)).sum()), -i, -j) for i, a in enumerate(parts) for j, b in enumerate(parts[:i])]
        overlap, i, j = max(pairs)
        if not overlap:
            break
        (x, n), (y, m) = parts[-i], parts[-j]
        both = (n > 0) & (m > 0)
        y = np.where(m > 0, y + np.mean(x[both] - y[both]), 0.0)
        merged = np.where(n + m > 0, (x * n + y * m) / np.maximum(n + m, 1), 0.0), n + m
        parts = [p for k, p in enumerate(parts) if k not in (-i, -j)] + [merged]
    total, count = np.zeros(size), np.zeros(size)
    for x, n in parts:
        total, count = np.where(n > 0, x, total), count + n
    return total, count


def collapse_to_sock(stretches: list[tuple[int, np.ndarray]], size: int, low: float = 0.1, high: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """A first profile, then the trimmed mean of all stretches shifted onto it. Also the counts."""
    first, count = collapse_to_mean(stretches, size)
    values: list[list[float]] = [[] for _ in range(size)]
    for start, v in stretches:
        shifted = v + np.median(first[start : start + len(v)] - v) if len(v) else v
        for i, x in enumerate(shifted):
            values[start + i].append(x)
    out = np.zeros(size)
    for i, v in enumerate(values):
        if v:
            v = np.sort(v)
            trimmed = v[int(low * len(v)) : max(int(np.ceil(high * len(v))), int(low * len(v)) + 1)]
            out[i] = trimmed.mean()
    return out, count


def stitch(profile: np.ndarray, count: np.ndarray, least: int = 10, how: str = "interpolation", order: int = 1) -> np.ndarray:
    """Frames with few stretches get the line between their neighbours, a polynomial fit, or the neighbouring slope."""
    good = np.flatnonzero(count >= least)
    if not len(good):
        return profile
    x = np.arange(len(profile))
    bad = count < least
    out = profile.copy()
    if how == "interpolation":
        out[bad] = np.interp(x[bad], good, profile[good])
    elif how == "fit":
        out[bad] = np.polyval(np.polyfit(good, profile[good], min(order, len(good) - 1)), x[bad])
    else:
        slope = np.median(np.diff(profile[good]) / np.diff(good)) if len(good) > 1 else 0.0
        near = good[np.clip(np.searchsorted(good, x[bad]), 0, len(good) - 1)]
        out[bad] = profile[near] + slope * (x[bad] - near)
    return out


COLLAPSE = {"mean": collapse_to_mean, "sock": collapse_to_sock, "merging": collapse_by_merging, "derivate": collapse_by_derivate}
