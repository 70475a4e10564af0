"""Shifts of one bead's cycles at which their densities agree best with a reference's; arrays of doubles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The kernel: its width in units of the precision, and how many widths it has to both sides together.
WIDTH, WINDOW, OVERSAMPLING = 1.0, 4, 5


@dataclass(frozen=True)
class Move:
    """One round of moves.

    The bins follow ``factor`` times the precision. Cycles with fewer than
    ``least`` events stay. Moves go up to ``most`` (in such units), and a move
    by one costs the share ``cost`` of the score. ``refine`` places the best
    move between bins, at the top of the parabola through it and its neighbours.
    """

    factor: float = 1.5
    cost: float = 0.05
    least: int = 2
    most: int = 3
    refine: bool = False


def kernel(oversampling: int = OVERSAMPLING) -> list[float]:
    """Weights of the kernel, which sum up to one."""
    half = int(np.rint(WIDTH * WINDOW * oversampling)) // 2
    y = np.exp(-0.5 * (np.arange(-half, half + 1) / oversampling / WIDTH) ** 2)
    return (y / y.sum()).tolist()


def best_moves(z: np.ndarray, cycle: np.ndarray, bias: np.ndarray, precision: float, move: Move, positions: np.ndarray | None = None, oversampling: int = OVERSAMPLING) -> np.ndarray:
    """``bias`` after one round: value ``z`` is one of cycle number ``cycle``, and ``bias`` has all cycles.

    The reference is the mean of all cycles, or the density of ``positions`` if
    given; then biases aren't centred on their median. Memory goes with the
    number of values, however far they lie apart.
    """
    centred = lambda x: x if positions is not None else x - np.median(x)
    good = np.bincount(cycle, minlength=len(bias)) >= move.least
    z, cycle = z[good[cycle]], cycle[good[cycle]]
    step = precision * move.factor / oversampling
    if not len(z) or not step > 0:
        return centred(bias)
    x = z + bias[cycle]
    edge = (move.most + WIDTH) * 2 * oversampling * step
    low, high = x.min() - edge, x.max() + edge
    size = np.floor((high - low) / step) + 1
    weights = np.array(kernel(oversampling))
    near = np.arange(len(weights)) - len(weights) // 2
    half = move.most * oversampling
    own = np.rint((x - low) / step)
    spots = own if positions is None else np.rint((positions - low) / step)
    spots = spots[(spots >= 0) & (spots < size)]
    # stretches without anything that a move could bring together are cut short
    every = np.unique(np.concatenate([own, spots]))
    far = len(weights) + half
    place = np.concatenate([[0], np.cumsum(np.minimum(np.diff(every), far))]).astype(int) + far
    spread = lambda bins: (place[np.searchsorted(every, bins)][:, None] + near).ravel()
    inside = ((spots[:, None] + near >= half) & (spots[:, None] + near < size - half)).ravel()
    reference = np.bincount(spread(spots), weights=np.tile(weights, len(spots)) * inside, minlength=place[-1] + 2 * far)
    if positions is None:
        reference = reference / len(np.unique(cycle))
    at, row, w = spread(own), np.repeat(cycle, len(weights)), np.tile(weights, len(own))
    t = np.arange(-half, half)
    total = np.array([np.bincount(row, weights=w * reference[at - k], minlength=len(bias)) for k in t])
    # a move down by one bin costs nothing, like none
    score = np.round(total * (1 - move.cost / oversampling * np.where(t < 0, -t - 1, t))[:, None], 9)
    best = score.argmax(axis=0)
    shift = t[best].astype(float)
    if move.refine:
        padded = np.pad(np.where(total > 0, score, np.nan), ((1, 1), (0, 0)), constant_values=np.nan)
        a, b, c = (np.take_along_axis(padded, best[None, :] + k, axis=0)[0] for k in (0, 1, 2))
        bend = a - 2 * b + c
        top = bend < 0
        shift[top] += 0.5 * (a - c)[top] / bend[top]
    return centred(np.where((total > 0).any(axis=0), bias - shift * step, bias))
