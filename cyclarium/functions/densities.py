"""Stretch and bias at which one profile of a density agrees best with another's; arrays of doubles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Profile:
    """Heights ``y`` (NaN if missing) in the sorted ``bins``, of which some are ``kept``; bin 0 begins at ``start``."""

    bins: np.ndarray
    y: np.ndarray
    kept: np.ndarray
    start: float
    step: float

    def at(self, x: np.ndarray) -> np.ndarray:
        """Heights on the lines between bins; nothing where there is no bin."""
        v = (x - self.start) / self.step
        low = np.floor(v)
        i = np.minimum(np.searchsorted(self.bins, low), len(self.bins) - 1)
        part = v - low
        ahead = np.append(self.y[1:], np.nan)
        value = np.where(part == 0, self.y[i], self.y[i] + (ahead[i] - self.y[i]) * part)
        return np.where((self.bins[i] == low) & ~np.isnan(value), value, 0.0)

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and heights of the kept bins."""
        good = self.kept & ~np.isnan(self.y)
        return self.start + self.bins[good] * self.step, self.y[good]


def costs(left: Profile, right: Profile, options: np.ndarray, symmetry: str = "both") -> np.ndarray:
    """Less the sum of products of both profiles for each (stretch, bias) row.

    The right profile is placed at (x - bias) * stretch on the left one;
    ``symmetry`` says which side's bins are summed over, or both.
    """
    s, b = options[:, :1], options[:, 1:]
    total = np.zeros(len(options))
    if symmetry in ("both", "left"):
        x, y = right.points()
        total += left.at((x - b) * s) @ y
    if symmetry in ("both", "right"):
        x, y = left.points()
        total += right.at(x / s + b) @ y
    return np.round(-total, 9)


def fit(left: Profile, right: Profile, nodes: np.ndarray, finer: list[np.ndarray], symmetry: str = "both") -> tuple[float, float, float]:
    """(cost, stretch, bias) of the best node, then of the best of each round of ``finer`` moves about it; of equals the lowest stretch, then bias."""
    best = (np.inf, 0.0, 0.0)
    for k, moves in enumerate([nodes, *finer]):
        options = moves + np.array(best[1:]) if k else moves
        cost = costs(left, right, options, symmetry)
        i = np.lexsort((options[:, 1], options[:, 0], cost))[0]
        best = (float(cost[i]), float(options[i, 0]), float(options[i, 1]))
    return best
