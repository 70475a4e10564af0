"""Mixtures of peaks: a gaussian in position times an exponential in duration for each, fitted by expectation and maximisation.

Rows of parameters are (weight, mean, sigma, scale). The methods differ in
where they begin and in what makes them split a peak.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """What a mixture's score is made of.

    ``timed`` mixtures look at durations, whose scale counts divided by
    ``sharpness``. With ``even`` peaks whose numbers of events are unlike those of a
    Poisson law about their mean cost likelihood.
    """

    timed: bool = True
    sharpness: float = 1.0
    even: bool = False
    tries: int = 1000
    tolerance: float = 1e-5
    floor: float = 1e-5

    def scores(self, z: np.ndarray, t: np.ndarray, par: np.ndarray) -> np.ndarray:
        """The density of each value (rows) under each peak (columns), without the peaks' weights."""
        _, m, s, d = par.T
        log = -0.5 * ((z[:, None] - m) / s) ** 2 - np.log(s * math.sqrt(2 * math.pi))
        if self.timed:
            d = d / self.sharpness
            log = log - t[:, None] / d - np.log(d)
        return np.exp(log)

    def likelihood(self, z: np.ndarray, t: np.ndarray, par: np.ndarray) -> float:
        """The logarithm of the values' likelihood, and of the peaks' if it counts."""
        out = float(np.log(np.maximum(self.scores(z, t, par) @ par[:, 0], 1e-300)).sum())
        if self.even:
            events = (par[:, 0] * len(z)).astype(int)
            mean = max(float(events.mean()), 1e-12)
            out += sum(k * math.log(mean) - mean - math.lgamma(k + 1) for k in events.tolist())
        return out

    def bic(self, z: np.ndarray, t: np.ndarray, par: np.ndarray) -> float:
        """Less twice the likelihood, and log(n / 2 pi) for each parameter of a peak."""
        return -2 * self.likelihood(z, t, par) + len(par) * (4 if self.timed else 2) * math.log(len(z) / (2 * math.pi))

    def fit(self, z: np.ndarray, t: np.ndarray, par: np.ndarray) -> np.ndarray:
        """Parameters after turns of expectation and maximisation, until the likelihood rises no more."""
        last = -math.inf
        for _ in range(self.tries):
            share = self.scores(z, t, par) * par[:, 0]
            total = share.sum(axis=1)
            now = float(np.log(np.maximum(total, 1e-300)).sum())
            if now - last < self.tolerance:
                break
            last = now
            share /= np.maximum(total, 1e-300)[:, None]
            n = share.sum(axis=0) + 1e-12
            m = (share * z[:, None]).sum(0) / n
            s = np.sqrt(np.maximum((share * (z[:, None] - m) ** 2).sum(0) / n, self.floor**2))
            d = np.maximum((share * t[:, None]).sum(0) / n, self.floor)
            par = np.column_stack([n / n.sum(), m, s, d])
        return par


#: Numbers of value, peak and fit that are held at once.
CELLS = 1 << 18


def fit_all(model: Model, z: np.ndarray, t: np.ndarray, starts: list[np.ndarray]) -> list[np.ndarray]:
    """``model.fit`` from each of ``starts``, in step; a fit leaves when its likelihood rises no more."""
    most = max(map(len, starts), default=0)
    at_once = max(1, CELLS // max(1, most * len(z)))
    if len(starts) > at_once:
        return [par for i in range(0, len(starts), at_once) for par in fit_all(model, z, t, starts[i : i + at_once])]
    par = np.zeros((len(starts), 4, most))
    par[:, 2:] = 1.0
    for own, start in zip(par, starts):
        own[:, : len(start)] = start.T
    used = np.arange(most) < np.array([[len(x)] for x in starts])
    out, fits, last = par.copy(), np.arange(len(starts)), np.full(len(starts), -math.inf)
    sums = np.column_stack([np.ones(len(z)), z, t])
    off = (z - par[:, 1, :, None]) ** 2
    for _ in range(model.tries):
        w, m, s, d = par[:, 0], par[:, 1], par[:, 2], par[:, 3]
        with np.errstate(divide="ignore"):
            log = np.log(w) - np.log(s * math.sqrt(2 * math.pi))
        share = off * (-0.5 / s**2)[:, :, None]
        if model.timed:
            scale = d / model.sharpness
            share -= t / scale[:, :, None]
            log = log - np.log(scale)
        share += log[:, :, None]
        np.exp(share, out=share)
        total = np.maximum(share.sum(axis=1), 1e-300)
        now = np.log(total).sum(axis=1)
        going = ~(now - last < model.tolerance)
        if not going.all():
            out[fits[~going]] = par[~going]
            share, total, now, used, fits = share[going], total[going], now[going], used[going], fits[going]
            if not len(fits):
                break
        last = now
        share /= total[:, None, :]
        n, m, d = np.moveaxis((share.reshape(-1, len(z)) @ sums).reshape(len(share), most, 3), 2, 0)
        n = n + 1e-12
        m, d = m / n, np.maximum(d / n, model.floor)
        off = z - m[:, :, None]
        off *= off
        s = np.sqrt(np.maximum(np.einsum("bkn,bkn->bk", share, off) / n, model.floor**2))
        n = np.where(used, n, 0.0)
        par = np.stack([n / n.sum(axis=1, keepdims=True), m, s, d], axis=1)
    out[fits] = par[: len(fits)]
    return [x[:, : len(start)].T for x, start in zip(out, starts)]


def from_groups(z: np.ndarray, t: np.ndarray, ids: np.ndarray, least: int = 1, floor: float = 1e-5) -> np.ndarray:
    """Parameters of the groups with ``least`` values or more."""
    _, ids, n = np.unique(ids, return_inverse=True, return_counts=True)
    mean = lambda x: np.bincount(ids, weights=x, minlength=len(n)) / n
    m = mean(z)
    par = np.column_stack([n, m, np.maximum(np.sqrt(mean((z - m[ids]) ** 2)), floor), np.maximum(mean(t), floor)])[n >= least]
    par[:, 0] /= par[:, 0].sum() or 1.0
    return par


def from_centres(z: np.ndarray, t: np.ndarray, centres: np.ndarray, least: int = 1, floor: float = 1e-5) -> np.ndarray:
    """Parameters of the values nearest to each centre."""
    return from_groups(z, t, np.abs(z[:, None] - np.asarray(centres)[None, :]).argmin(axis=1), least, floor)


def halves(par: np.ndarray, i: int) -> np.ndarray:
    """Peak ``i`` as two, a sigma to each side."""
    w, m, s, d = par[i]
    return np.vstack([par[:i], [(w / 2, m - s, s / 2, d), (w / 2, m + s, s / 2, d)], par[i + 1 :]])


def split_wide(model: Model, z: np.ndarray, t: np.ndarray, par: np.ndarray, widest: float) -> np.ndarray:
    """The widest peak in two, again and again, until none is wider than ``widest``; there are no more peaks than values."""
    par = model.fit(z, t, par)
    while par[:, 2].max() > widest and len(par) < len(z):
        par = model.fit(z, t, halves(par, int(np.argmax(par[:, 2]))))
    return par


def split_by_bic(model: Model, z: np.ndarray, t: np.ndarray, par: np.ndarray, precision: float, least: int) -> np.ndarray:
    """Each peak in two while that lowers the criterion: those wider than the precision, with values for two."""
    par = model.fit(z, t, par)
    bic = model.bic(z, t, par)
    kept: set[tuple[float, ...]] = set()  # peaks that are better whole
    while True:
        large = np.round(par[:, 0] * len(z)) > 2 * least
        todo = [i for i in np.flatnonzero(large & (par[:, 2] > precision)) if tuple(par[i]) not in kept]
        if not todo:
            return par
        new = model.fit(z, t, halves(par, int(todo[0])))
        other = model.bic(z, t, new)
        if other < bic:
            par, bic = new, other
            kept.clear()
        else:
            kept.add(tuple(par[todo[0]]))


def random_starts(model: Model, z: np.ndarray, t: np.ndarray, sizes: list[int], repeats: int = 10, seed: int = 0) -> np.ndarray:
    """The best by the criterion of fits that begin at values drawn at random, ``repeats`` for each number of peaks."""
    rng = np.random.default_rng(seed)
    fits = fit_all(model, z, t, [from_centres(z, t, rng.choice(z, k), floor=model.floor) for k in sizes for _ in range(repeats)])
    return min(fits, key=lambda par: model.bic(z, t, par))


def assign(model: Model, z: np.ndarray, t: np.ndarray, par: np.ndarray, least: int = 3, lowest: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(positions, index of each value's peak): peaks with ``least`` values by their weight, in order; -1 where no score exceeds ``lowest``."""
    par = par[par[:, 0] * len(z) >= least]
    par = par[np.argsort(par[:, 1], kind="stable")]
    if not len(par):
        return par[:, 1], np.full(len(z), -1)
    scores = model.scores(z, t, par)
    return par[:, 1], np.where(scores.max(axis=1) > lowest, scores.argmax(axis=1), -1)


#: Models and methods by name.
MODELS = {"gauss": Model(timed=False), "even": Model(even=True), "weighted": Model(sharpness=10.0)}
METHODS = ("width", "bic", "full", "even", "weighted", "gauss", "random")


def find(z: np.ndarray, t: np.ndarray, centres: np.ndarray, method: str = "full", *, precision: float = 1e-3, least: int = 3, widest: float | None = None, repeats: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(positions, index of each value's peak) by one of ``METHODS``.

    ``width`` and ``gauss`` (positions alone) split what is wider than ``widest``,
    twice the precision if not given; ``bic`` splits by the criterion; ``full``
    does both, as do ``even`` and ``weighted`` with their own scores; ``random``
    begins at random, with as many peaks as there are centres or one or two less or more.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method}")
    model = MODELS.get(method, Model())
    if not len(z):
        return np.zeros(0), np.zeros(0, int)
    if method == "random":
        k = max(1, len(centres))
        return assign(model, z, t, random_starts(model, z, t, [x for x in range(k - 2, k + 3) if 0 < x <= len(z)], repeats, seed), least)
    par = from_centres(z, t, centres, least, model.floor) if len(centres) else np.zeros((0, 4))
    if not len(par):
        par = from_groups(z, t, np.zeros(len(z)), floor=model.floor)
    if method != "bic":
        par = split_wide(model, z, t, par, 2 * precision if widest is None else widest)
    if method not in ("width", "gauss"):
        par = split_by_bic(model, z, t, par, precision, least)
    return assign(model, z, t, par, least)
