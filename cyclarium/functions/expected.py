"""Shifts of cycles at which their events stand where the other cycles' events expect them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Golden section.
SECTION = (5**0.5 - 1) / 2


def least(cost: Callable[[float], float], reach: float, tolerance: float, points: int = 41) -> float:
    """Where ``cost`` is least within ``reach`` of zero: the best of a scan, then golden sections about it."""
    at = np.linspace(-reach, reach, points)
    best = int(np.argmin([cost(x) for x in at]))
    low, high = at[max(0, best - 1)], at[min(points - 1, best + 1)]
    while high - low > tolerance:
        a, b = high - SECTION * (high - low), low + SECTION * (high - low)
        if cost(a) <= cost(b):
            high = b
        else:
            low = a
    return float((low + high) / 2)


def _near(values: np.ndarray, x: float, reach: float) -> np.ndarray:
    return values[np.searchsorted(values, x - reach) : np.searchsorted(values, x + reach, "right")]


def _weights(values: np.ndarray, x: float, precision: float) -> np.ndarray:
    return np.exp(-0.5 * ((values - x) / precision) ** 2)


def likely_cost(delta: float, own: np.ndarray, others: np.ndarray, precision: float, reach: float, rigidity: float) -> float:
    """Mean squared distance of the moved events to the gaussian means of the others about them, and a price of the move that falls with their number."""
    cost = seen = 0.0
    for x in own + delta:
        near = _near(others, x, reach)
        if len(near):
            w = _weights(near, x, precision)
            cost += ((x + near @ w) / (w.sum() + 1) - x) ** 2
            seen += np.log(len(near) + 1)
        else:
            cost += reach**2
    return cost / len(own) + rigidity / (seen + 0.001) * delta**2


def symmetric_cost(delta: float, own: np.ndarray, others: np.ndarray, precision: float, reach: float, rigidity: float) -> float:
    """How unlike are the weights of others about an event's expected place and of the event about theirs.

    Expected places are means in which values weigh by how near they are to
    zero, as the method defines them, and the event by how near it is.
    """
    cost = 0.0
    for x in own + delta:
        near = _near(others, x, reach)
        if len(near):

            def mean(values: np.ndarray, centre: float) -> float:
                w, own_weight = _weights(values, 0.0, precision), np.exp(-0.5 * ((centre - x) / precision) ** 2)  # noqa: B023
                return float((w @ values + x * own_weight) / (own_weight + w.sum()))  # noqa: B023

            here = mean(near, x)
            there = np.array([mean(_near(others, y, reach), y) for y in near])
            cost += float(((_weights(there, here, precision) - _weights(near, here, precision)) ** 2).sum()) / (len(near) + 1)
    return cost


#: Pairs of an event and another one near it that are looked at at once.
PAIRS = 1 << 17


def _flat(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, place) with place in [low, high) of the row."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)


class Costs:
    """``likely_cost`` or ``symmetric_cost`` of several moves for each of some cycles at once.

    ``values`` are all cycles' events, sorted, ``of`` their cycles; ``own`` and
    ``cycle`` are the events to be moved and their cycles, which stand together.
    """

    def __init__(self, own: np.ndarray, cycle: np.ndarray, values: np.ndarray, of: np.ndarray, precision: float, reach: float, rigidity: float, farthest: float | None = None):
        self.own, self.cycle, self.values, self.of = own, cycle, values, of
        self.precision, self.reach, self.rigidity = precision, reach, rigidity
        self.starts = np.flatnonzero(np.concatenate([[True], np.diff(cycle) != 0]))
        self.number = np.cumsum(np.concatenate([[0], np.diff(cycle) != 0]))
        self.sizes = np.bincount(self.number)
        if farthest is not None:
            self._expect(farthest)

    def _expect(self, farthest: float) -> None:
        """For each event and each other one that it may come near to, sums over those near the latter: they don't depend on the move."""
        values, far = self.values, self.reach + farthest * (1 + 1e-9)
        self.weight = _weights(values, 0.0, self.precision)
        self.low = np.searchsorted(values, self.own - far)
        row, j = _flat(self.low, np.searchsorted(values, self.own + far, "right"))
        self.base = np.searchsorted(row, np.arange(len(self.own)))
        low, high = np.searchsorted(values, values - self.reach), np.searchsorted(values, values + self.reach, "right")
        self.sums, self.weights = np.zeros(len(row)), np.zeros(len(row))
        ends = np.cumsum((high - low)[j])
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 8 * PAIRS, "right")))
            pair, k = _flat(low[j[a:b]], high[j[a:b]])
            other = self.of[k] != self.cycle[row[a:b]][pair]
            pair, k = pair[other], k[other]
            self.sums[a:b] = np.bincount(pair, weights=self.weight[k] * values[k], minlength=b - a)
            self.weights[a:b] = np.bincount(pair, weights=self.weight[k], minlength=b - a)
            a = b

    def _near(self, moves: np.ndarray) -> tuple[np.ndarray, ...]:
        """The moved events, how many others are near each, and all such pairs: the event, the other, its weight."""
        x = (self.own + moves[:, self.number]).ravel()
        row, j = _flat(np.searchsorted(self.values, x - self.reach), np.searchsorted(self.values, x + self.reach, "right"))
        other = self.of[j] != self.cycle[row % len(self.own)]
        row, j = row[other], j[other]
        return x, np.bincount(row, minlength=len(x)), row, j, _weights(self.values[j], x[row], self.precision)

    def _total(self, each: np.ndarray) -> np.ndarray:
        return np.add.reduceat(each.reshape(-1, len(self.own)), self.starts, axis=1)

    def likely(self, moves: np.ndarray) -> np.ndarray:
        """Costs of ``moves``, which has a column for each cycle."""
        x, n, row, j, w = self._near(moves)
        mean = (x + np.bincount(row, weights=w * self.values[j], minlength=len(x))) / (np.bincount(row, weights=w, minlength=len(x)) + 1)
        cost = self._total(np.where(n > 0, (mean - x) ** 2, self.reach**2))
        return cost / self.sizes + self.rigidity / (self._total(np.log(n + 1)) + 0.001) * moves**2

    def symmetric(self, moves: np.ndarray) -> np.ndarray:
        x, n, row, j, w = self._near(moves)
        total = lambda y: np.bincount(row, weights=y, minlength=len(x))
        here = (total(self.weight[j] * self.values[j]) + x) / (1 + total(self.weight[j]))
        event = row % len(self.own)
        at = self.base[event] + j - self.low[event]
        there = (self.sums[at] + x[row] * w) / (w + self.weights[at])
        unlike = _weights(there, here[row], self.precision) - _weights(self.values[j], here[row], self.precision)
        return self._total(total(unlike**2) / (n + 1))


def least_of_each(cost: Callable[[np.ndarray], np.ndarray], cycles: int, reach: float, tolerance: float, at_once: int, points: int = 41) -> np.ndarray:
    """``least`` for several cycles in step: ``cost`` takes rows of one move for each cycle, ``at_once`` of them."""
    at = np.linspace(-reach, reach, points)
    scan = np.concatenate([cost(np.repeat(at[i : i + at_once, None], cycles, axis=1)) for i in range(0, points, at_once)])
    best = scan.argmin(axis=0)
    low, high = at[np.maximum(0, best - 1)], at[np.minimum(points - 1, best + 1)]
    while (going := high - low > tolerance).any():
        a, b = high - SECTION * (high - low), low + SECTION * (high - low)
        left, right = cost(np.array([a, b]))
        low, high = np.where(going & ~(left <= right), a, low), np.where(going & (left <= right), b, high)
    return (low + high) / 2


def averaged(cycles: list[np.ndarray], bias: np.ndarray, precision: float, reach: float, share: float) -> np.ndarray:
    """Each bias moved by ``share`` towards the mean of those of the cycles whose events are about its own."""
    values = np.concatenate([z + b for z, b in zip(cycles, bias)])
    of = np.repeat(np.arange(len(cycles)), [len(z) for z in cycles])
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    out = bias.copy()
    for i in range(len(cycles)):
        means = []
        for x in values[of == i]:
            a, b = np.searchsorted(values, x - reach), np.searchsorted(values, x + reach, "right")
            means.append(np.average(bias[of[a:b]], weights=_weights(values[a:b], x, precision)))
        out[i] = bias[i] * (1 - share) + share * float(np.mean(means))
    return out


def expected_biases(cycles: list[np.ndarray], precision: float, *, symmetric: bool = False, rounds: int = 2, window: float = 4.0, search: float = 2.5, rigidity: float = 0.1, average: float = 0.0, discard: float | None = None) -> np.ndarray:
    """A shift for each cycle of events, centred on their median; cycles without events stay.

    In each round every cycle finds its best place among the others as they
    stood before; ``average`` then draws it to its neighbours. With ``discard``
    another round is made, and cycles that it moves by so many precisions or more have NaN.
    """
    reach = window * precision
    full = [i for i, z in enumerate(cycles) if len(z)]
    own = [np.asarray(cycles[i], float) for i in full]
    events, cycle = (np.concatenate(own), np.repeat(np.arange(len(own)), [len(z) for z in own])) if own else (np.zeros(0), np.zeros(0, int))

    def turn(bias: np.ndarray) -> np.ndarray:
        moved = events + bias[cycle]
        order = np.argsort(moved, kind="stable")
        values, of = moved[order], cycle[order]
        near = np.searchsorted(values, events + reach, "right") - np.searchsorted(values, events - reach) + 1
        per = np.bincount(cycle, weights=near)
        block = np.floor((np.cumsum(per) - per) / PAIRS).astype(int)
        new = np.zeros(len(own))
        for k in np.unique(block):
            some = block[cycle] == k
            costs = Costs(events[some], cycle[some], values, of, precision, reach, rigidity, search * precision if symmetric else None)
            new[block == k] = least_of_each(costs.symmetric if symmetric else costs.likely, int((block == k).sum()), search * precision, 1e-4 * precision, max(1, int(PAIRS // near[some].sum())))
        if average > 0:
            new = averaged(own, new, precision, reach, average)
        return new - np.median(new)

    out = np.zeros(len(cycles))
    if not own:
        return out
    bias = np.zeros(len(own))
    for _ in range(rounds):
        bias = turn(bias)
    if discard is not None:
        good = np.abs(turn(bias) - bias) < discard * precision
        bias = np.where(good, bias - (np.median(bias[good]) if good.any() else 0.0), np.nan)
    out[full] = bias
    return out
