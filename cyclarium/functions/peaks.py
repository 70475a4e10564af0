"""Peaks of one bead's events, their alignment over cycles, and their match to theory; arrays of doubles."""

from __future__ import annotations

import itertools

import numpy as np


def local_maxima(density: np.ndarray, half: int = 3, least: float = 1e-12) -> np.ndarray:
    """Bins that are the first largest of the ``half`` bins to each side."""
    n = len(density)
    return np.array([i for i in range(n) if density[i] > least and i == max(0, i - half) + int(np.argmax(density[max(0, i - half) : i + half + 1]))], int)


def subpixel(density: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Vertex of the parabola through each maximum and its neighbours."""
    out = at.astype(float)
    for k, i in enumerate(at):
        if 0 < i < len(density) - 1:
            a, b, c = density[i - 1 : i + 2]
            bend = a - 2 * b + c
            if bend < 0:
                out[k] += 0.5 * (a - c) / bend
    return out


def flag(values: np.ndarray, peaks: np.ndarray, window: float, least: int = 3, base: float | None = None) -> np.ndarray:
    """Index of the nearest peak within ``window`` of each value, -1 without one; peaks with too few values go.

    With ``base`` the fullest peak within that of the lowest one stays; of equals the lowest.
    """
    if not len(peaks):
        return np.full(len(values), -1)
    nearest = np.abs(values[:, None] - peaks[None, :]).argmin(axis=1)
    ids = np.where(np.abs(values - peaks[nearest]) <= window, nearest, -1)
    count = np.bincount(ids[ids >= 0], minlength=len(peaks))
    if base is not None:
        low = np.flatnonzero(peaks <= peaks.min() + base)
        low = low[np.argsort(peaks[low], kind="stable")]
        kept = low[np.argmax(count[low])]
        count[kept] = max(count[kept], least)
    return np.where((ids >= 0) & (count[np.maximum(ids, 0)] < least), -1, ids)


def mixture(z: np.ndarray, t: np.ndarray, k: int, *, tries: int = 200, tolerance: float = 1e-5, floor: float = 1e-5, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """EM of ``k`` gaussians of z times exponentials of the duration t, from ``start`` or quantiles of z: (weight, mean, sigma, scale) rows, responsibilities, BIC."""
    par = start
    if par is None:
        centres = np.quantile(z, (np.arange(k) + 0.5) / k) if k > 1 else np.array([z.mean()])
        par = np.column_stack([np.full(k, 1 / k), centres, np.full(k, max(z.std() / k, floor)), np.full(k, max(t.mean(), floor))])
    last = -np.inf
    for _ in range(tries):
        w, m, s, d = par.T
        log = np.log(w) - 0.5 * ((z[:, None] - m) / s) ** 2 - np.log(s * np.sqrt(2 * np.pi)) - t[:, None] / d - np.log(d)
        top = log.max(axis=1, keepdims=True)
        like = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        resp = np.exp(log - like[:, None])
        n = resp.sum(axis=0) + 1e-12
        m = (resp * z[:, None]).sum(0) / n
        s = np.sqrt(np.maximum((resp * (z[:, None] - m) ** 2).sum(0) / n, floor**2))
        d = np.maximum((resp * t[:, None]).sum(0) / n, floor)
        par = np.column_stack([n / n.sum(), m, s, d])
        if like.sum() - last < tolerance:
            break
        last = like.sum()
    return par, resp, (4 * k - 1) * np.log(len(z)) - 2 * like.sum()


#: Numbers of components that are fitted from quantiles, as starts; splits go on from there.
STARTS = 8


def _from_centres(z: np.ndarray, t: np.ndarray, centres: np.ndarray, least: int, floor: float = 1e-5) -> np.ndarray:
    """(weight, mean, sigma, scale) rows of the values nearest to each centre, where there are ``least`` of them."""
    nearest = np.abs(z[:, None] - centres[None, :]).argmin(axis=1)
    groups = [nearest == i for i in range(len(centres))]
    rows = [(g.sum(), z[g].mean(), max(z[g].std(), floor), max(t[g].mean(), floor)) for g in groups if g.sum() >= least]
    par = np.array(rows, float).reshape(-1, 4)
    par[:, 0] /= par[:, 0].sum() or 1
    return par


def _moves(par: np.ndarray, n: int, precision: float, least: int):
    """Starts with one component more or less: splits of those wider than ``precision`` with values for two, the widest first, and drops."""
    for i in np.argsort(-par[:, 2]):
        w, m, s, d = par[i]
        if s > precision and round(w * n) >= 2 * least:
            yield np.vstack([np.delete(par, i, axis=0), [(w / 2, m - s, s / 2, d), (w / 2, m + s, s / 2, d)]])
    if len(par) > 1:
        for i in np.argsort(par[:, 0]):
            rest = np.delete(par, i, axis=0)
            yield np.column_stack([rest[:, 0] / rest[:, 0].sum(), rest[:, 1:]])


def best_mixture(z: np.ndarray, t: np.ndarray, most: int | None = None, *, centres: np.ndarray | None = None, precision: float = 0.0, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The mixture that no split or drop of a component betters by BIC, in order of the means; ``most`` bounds its components if given.

    It begins at the best of mixtures from ``centres`` (a histogram's peaks) and
    from quantiles. A split counts where each component keeps ``least`` values.
    """
    n, limit = len(z), min(len(z), most or len(z))
    fits = [mixture(z, t, k) for k in range(1, min(limit, STARTS) + 1)]
    if centres is not None and len(centres) and 0 < len(start := _from_centres(z, t, centres, least)) <= limit:
        fits.append(mixture(z, t, len(start), start=start))
    par, resp, bic = min(fits, key=lambda x: x[2])
    better = True
    while better:
        better = False
        for start in _moves(par, n, precision, least):
            if len(start) > limit:
                continue
            new = mixture(z, t, len(start), start=start)
            if new[2] < bic - 1e-6 and (len(start) < len(par) or np.bincount(new[1].argmax(axis=1), minlength=len(start)).min() >= least):
                (par, resp, bic), better = new, True
                break
    order = np.argsort(par[:, 1])
    return par[order], resp[:, order]


def cycle_biases(cycles: list[np.ndarray], precision: float, repeats: int = 6, reach: int = 15) -> np.ndarray:
    """Shift of each cycle's values that makes its histogram agree best with the mean of all; centred on the median."""
    every = np.concatenate(cycles) if cycles else np.zeros(0)
    biases = np.zeros(len(cycles))
    if not len(every):
        return biases
    low, width = every.min() - reach * precision, precision / 2
    n = int(np.ceil((every.max() + reach * precision - low) / width)) + 1
    kernel = np.exp(-0.5 * (np.arange(-8, 9) / 2) ** 2)
    each = [np.convolve(np.bincount(np.rint((c - low) / width).astype(int), minlength=n)[:n].astype(float), kernel, "same") for c in cycles]
    shifts = np.zeros(len(cycles), int)
    for _ in range(repeats):
        mean = sum(np.roll(e, s) for e, s in zip(each, shifts))
        new = shifts.copy()
        for i, e in enumerate(each):
            ref = mean - np.roll(e, shifts[i])
            scores = [float(ref @ np.roll(e, s)) - 1e-9 * abs(s) for s in range(-reach, reach + 1)]
            new[i] = int(np.argmax(scores)) - reach
        new -= int(np.median(new))
        if (new == shifts).all():
            break
        shifts = new
    return shifts * width


def min_bias(weights: np.ndarray, means: np.ndarray, repeats: int = 10) -> np.ndarray:
    """Cycle biases by turns of weighted peak means and weighted cycle residuals; rows are peaks, columns cycles."""
    w = np.where(np.isfinite(means), weights, 0.0)
    m = np.where(w > 0, means, 0.0)
    bias = np.zeros(m.shape[1])
    for _ in range(repeats):
        peak = (w * (m + bias)).sum(1) / np.maximum(w.sum(1), 1e-12)
        total = w.sum(0)
        bias = np.where(total > 0, (w * (peak[:, None] - m)).sum(0) / np.maximum(total, 1e-12), 0.0)
    return bias - np.median(bias)


def least_squares_bias(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The same in one least-squares solve for peaks and biases together, with biases of mean zero."""
    peaks, cycles = means.shape
    p, c = np.nonzero(np.isfinite(means) & (weights > 0))
    root = np.sqrt(weights[p, c])
    a = np.zeros((len(p) + 1, peaks + cycles))
    a[np.arange(len(p)), p], a[np.arange(len(p)), peaks + c] = root, -root
    a[-1, peaks:] = 1
    return np.linalg.lstsq(a, np.append(root * means[p, c], 0.0), rcond=None)[0][peaks:]


def chains(reference: np.ndarray, experiment: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sorted lists in one line: list (0 is the reference) and index of each, and the distance to the one before.

    The distance is infinite where a chain ends: at one of the same list, or
    beyond the window. At equal positions the list that had the last place
    goes on.
    """
    x = np.concatenate([reference, experiment]).astype(float)
    side = np.repeat([0, 1], [len(reference), len(experiment)])
    index = np.concatenate([np.arange(len(reference)), np.arange(len(experiment))])
    order = np.lexsort((side, x))
    x, side, index = x[order], side[order], index[order]
    last = 0
    for start, stop in zip(*_equal_runs(x)):
        own = side[start:stop]
        if last == 1 and own[0] != own[-1]:
            turned = np.argsort(1 - own, kind="stable") + start
            side[start:stop], index[start:stop] = side[turned], index[turned]
        last = side[stop - 1]
    gap = np.full(len(x), np.inf)
    going = (side[1:] != side[:-1]) & ~(x[:-1] < x[1:] - window)
    gap[1:][going] = (x[1:] - x[:-1])[going]
    return side, index, gap


def _equal_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x) != 0) + 1]) if len(x) else np.zeros(0, int)
    return starts, np.append(starts[1:], len(x)) if len(x) else starts


def match(reference: np.ndarray, experiment: np.ndarray, window: float) -> list[tuple[int, int]]:
    """One-to-one pairs of sorted lists: of neighbours in chains of both lists' turns, the closest first."""
    side, index, gap = chains(reference, experiment, window)
    free = np.ones(len(gap), bool)
    out = []
    for i in np.argsort(gap, kind="stable"):
        if gap[i] == np.inf:
            break
        if free[i - 1] and free[i]:
            free[i - 1] = free[i] = False
            pair = index[i - 1], index[i]
            out.append(tuple(int(k) for k in (pair if side[i] == 1 else pair[::-1])))
    return sorted(out)


#: The cost where nothing matches: the largest 32-bit number.
NO_MATCH = 3.4028234663852886e38


def chi_squared(theory: np.ndarray, peaks: np.ndarray, stretch: float, bias: float, window: float = 10.0, *, symmetry: str = "both", singlestrand: bool = False) -> float:
    """Root of (squared distances of pairs over the window's + squared number of unmatched ones) per matched one.

    Unmatched are those of both lists, of the theory (``left``) or of the peaks
    (``right``). Peaks beyond the theory's ends count by their distance to the
    end: to the first position if it is 0, the baseline, and to the last with
    ``singlestrand``.
    """
    placed = (peaks - bias) * stretch
    pairs = match(theory, placed, window)
    if not pairs:
        return NO_MATCH
    square = sum((theory[i] - placed[j]) ** 2 for i, j in pairs) if len(pairs) > 1 else 0.0
    if singlestrand:
        square += float(((placed[placed >= theory[-1]] - theory[-1]) ** 2).sum())
    if theory[0] == 0:
        square += float(((placed[placed < 0]) ** 2).sum())
    total = {"both": len(theory) + len(peaks), "left": len(theory), "right": len(peaks)}[symmetry]
    paired = len(pairs) * (2 if symmetry == "both" else 1)
    return float(np.sqrt((square / window**2 + (total - paired) ** 2) / paired))


def refit(theory: np.ndarray, peaks: np.ndarray, stretch: float, bias: float, window: float = 10.0) -> tuple[float, float]:
    """Stretch and bias of the line through the matched pairs."""
    pairs = match(theory, (peaks - bias) * stretch, window)
    if len(pairs) < 2:
        return stretch, bias
    x, y = peaks[[j for _, j in pairs]], theory[[i for i, _ in pairs]]
    var = x.var()
    if var <= 0:
        return stretch, bias
    slope = ((x - x.mean()) * (y - y.mean())).mean() / var
    return (slope, x.mean() - y.mean() / slope) if slope > 0 else (stretch, bias)


def pair_candidates(theory: np.ndarray, peaks: np.ndarray, stretches: tuple[float, float], biases: tuple[float, float]) -> np.ndarray:
    """(stretch, bias) rows that lay two peaks on two positions, within bounds; sorted, each once."""
    found = []
    a, b = np.triu_indices(len(theory), 1)
    span, low = theory[b] - theory[a], theory[a]
    for i, j in itertools.combinations(range(len(peaks)), 2):
        if peaks[j] > peaks[i]:
            s = span / (peaks[j] - peaks[i])
            good = (s >= stretches[0]) & (s <= stretches[1])
            q = peaks[i] - low[good] / s[good]
            inside = (q >= biases[0]) & (q <= biases[1])
            found.append(np.column_stack([s[good][inside], q[inside]]))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2))


def least_cost(theory: np.ndarray, peaks: np.ndarray, options: np.ndarray, window: float) -> np.ndarray:
    """For each (stretch, bias) row a cost that none of its matches can be below: each position within the window of a peak counts as matched."""
    placed = (peaks[None, :] - options[:, 1:]) * options[:, :1]
    near = np.minimum.reduce([np.abs(placed - t) for t in theory]) <= window * (1 + 1e-9)
    back = np.minimum.reduce([np.abs(placed[:, [k]] - theory[None, :]) for k in range(len(peaks))]) <= window * (1 + 1e-9)
    pairs = np.minimum(near.sum(1), back.sum(1))
    lost = len(theory) + len(peaks) - 2 * pairs
    return np.where(pairs > 0, np.sqrt(lost**2 / np.maximum(2 * pairs, 1)), NO_MATCH)


def grid_fit(theory: np.ndarray, peaks: np.ndarray, stretch: float = 1 / 8.8e-4, spread: float = 0.1, bias: tuple[float, float] = (-0.05, 0.05), window: float = 10.0) -> tuple[float, float, float]:
    """(cost, stretch, bias) of the best candidate, each also refitted; candidates whose bound exceeds the best cost aren't matched."""
    theory, peaks = np.sort(theory), np.sort(peaks)
    if not len(theory) or not len(peaks):
        return NO_MATCH, stretch, 0.0
    options = np.vstack([[(stretch, 0.0)], pair_candidates(theory, peaks, (stretch * (1 - spread), stretch * (1 + spread)), bias)])
    bounds = np.concatenate([least_cost(theory, peaks, part, window) for part in np.array_split(options, max(1, len(options) // 1024))])
    best = (NO_MATCH, stretch, 0.0)
    for i in np.argsort(bounds, kind="stable"):
        if bounds[i] > best[0]:
            break
        s, b = (float(x) for x in options[i])
        again = refit(theory, peaks, s, b, window)
        best = min(best, (chi_squared(theory, peaks, s, b, window), s, b), (chi_squared(theory, peaks, *again, window), *map(float, again)))
    return best


def gaussian_cost(theory: np.ndarray, peaks: np.ndarray, stretch: float, bias: float, sigma: float = 15.0) -> float:
    """1 - R(x, y) / sqrt(R(x, x) R(y, y)), where R sums gaussians of all differences."""
    placed = (peaks - bias) * stretch
    r = lambda x, y: np.exp(-0.5 * ((x[:, None] - y[None, :]) / sigma) ** 2).sum()
    return float(1 - r(theory, placed) / np.sqrt(r(theory, theory) * r(placed, placed)))


def gaussian_fit(theory: np.ndarray, peaks: np.ndarray, stretch: float = 1 / 8.8e-4, spread: float = 0.1, bias: tuple[float, float] = (-0.05, 0.05), sigma: float = 15.0, size: int = 21) -> tuple[float, float, float]:
    """(cost, stretch, bias) by a grid that shrinks about its best point."""
    centre, reach = (stretch, sum(bias) / 2), (stretch * spread, (bias[1] - bias[0]) / 2)
    best = (gaussian_cost(theory, peaks, *centre, sigma), *centre)
    for _ in range(6):
        for s in np.linspace(best[1] - reach[0], best[1] + reach[0], size):
            for b in np.linspace(best[2] - reach[1], best[2] + reach[1], size):
                best = min(best, (gaussian_cost(theory, peaks, s, b, sigma), s, b))
        reach = reach[0] / 5, reach[1] / 5
    return best
