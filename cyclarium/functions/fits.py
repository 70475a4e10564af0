"""Fits of a bead's peaks to parts of a hairpin; arrays of doubles, positions ascending."""

from __future__ import annotations

import numpy as np

from cyclarium.functions.peaks import NO_MATCH, chi_squared, match, pair_candidates, refit

Distance = tuple[float, float, float]


def edges(theory: np.ndarray, peaks: np.ndarray, stretches: tuple[float, float]) -> np.ndarray:
    """Rows (i, j, k, l, stretch): positions i < j of the theory laid on peaks k < l, by stretch.

    For each pair of peaks the pairs of positions that fit are a slice of the
    positions' distances in order, so others aren't listed.
    """
    i, j = np.triu_indices(len(theory), 1)
    span = theory[j] - theory[i]
    order = np.argsort(span, kind="stable")
    i, j, span = i[order], j[order], span[order]
    out = [np.zeros((0, 5))]
    for k, low in enumerate(peaks):
        for m in range(k + 1, len(peaks)):
            width = peaks[m] - low
            if width > 0:
                a, b = np.searchsorted(span, [stretches[0] * width, stretches[1] * width], side="left")
                b = int(np.searchsorted(span, stretches[1] * width, side="right"))
                out.append(np.column_stack([i[a:b], j[a:b], np.full(b - a, k), np.full(b - a, m), span[a:b] / width]))
    found = np.concatenate(out)
    return found[np.argsort(found[:, 4], kind="stable")]


def together(theory: list[np.ndarray], peaks: list[np.ndarray], one: np.ndarray, two: np.ndarray, window: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges of the two ends that some stretch lays within the window of both their ends.

    An edge of width w and stretch s stays within the window for stretches
    about s by 2 * window / w, so edges meet whose ranges of stretches overlap:
    a merge along both lists in order of their ranges' lower ends.
    """
    reach = lambda e, p: 2 * window / (p[e[:, 3].astype(int)] - p[e[:, 2].astype(int)])
    out = []
    low, high = [], []
    for e, p in ((one, peaks[0]), (two, peaks[1])):
        r = reach(e, p)
        low.append(e[:, 4] - r)
        high.append(e[:, 4] + r)
    order = np.argsort(low[1], kind="stable")
    starts = low[1][order]
    for x in range(len(one)):
        last = int(np.searchsorted(starts, high[0][x], side="right"))
        near = order[:last]
        near = near[high[1][near] >= low[0][x]]
        out += [(one[x], two[y]) for y in near]
    return out


def shared_line(theory: list[np.ndarray], peaks: list[np.ndarray], pairs: list[np.ndarray]) -> tuple[float, list[float]] | None:
    """The stretch that all ends share and each end's shift, by least squares over the pairs (position, peak) of each."""
    up = down = 0.0
    middles = []
    for t, p, ij in zip(theory, peaks, pairs):
        y, x = t[ij[:, 0]], p[ij[:, 1]]
        up += float(((x - x.mean()) * (y - y.mean())).sum())
        down += float(((x - x.mean()) ** 2).sum())
        middles.append((x.mean(), y.mean()))
    if down <= 0:
        return None
    stretch = up / down
    return stretch, [float(y - x * stretch) for x, y in middles]


def edge_cost(theory: list[np.ndarray], peaks: list[np.ndarray], pairs: list[np.ndarray], window: float) -> tuple[float, float, tuple[float, ...]] | None:
    """(cost, stretch, biases): a line through ``pairs``, again through what it matches, and the cost of what that matches."""
    for _ in range(2):
        line = shared_line(theory, peaks, pairs)
        if line is None or line[0] <= 0:
            return None
        stretch, shifts = line
        found = [match(t, p * stretch + b, window) for t, p, b in zip(theory, peaks, shifts)]
        if not all(found):
            return None
        pairs = [np.array(x) for x in found]
    # the last match is judged by the line that made it
    square = sum(float(((t[ij[:, 0]] - stretch * p[ij[:, 1]] - b) ** 2).sum()) for t, p, ij, b in zip(theory, peaks, pairs, shifts))
    n = sum(map(len, theory))
    lost = n - sum(map(len, pairs))
    return float(np.sqrt((square / window**2 + lost**2) / n)), float(stretch), tuple(-b / stretch for b in shifts)


def ends_of(theory: list[np.ndarray], peaks: np.ndarray, stretches: tuple[float, float], slack: float) -> list[np.ndarray]:
    """The peaks that the first list may reach from the bottom, and those that the last may reach from the top."""
    reach = [(t[-1] - t[0]) / stretches[0] + slack for t in theory]
    return [peaks[peaks < peaks[0] + reach[0]], peaks[peaks >= peaks[-1] - reach[1]]]


def edge_fit(theory: list[np.ndarray], peaks: np.ndarray, stretch: float = 1 / 8.8e-4, spread: float = 0.1, slack: float = 0.05, window: float = 10.0, tried: list | None = None) -> tuple[float, float, tuple[float, float]]:
    """(cost, stretch, (bottom bias, top bias)) of two lists of positions, one for the lowest peaks and one for the highest.

    Both share the stretch and have a bias each. Candidates lay two positions
    of each list on two peaks; ``tried`` gets them if given. Without any the
    cost is ``NO_MATCH``.
    """
    theory = [np.sort(np.asarray(t, float)) for t in theory]
    peaks = np.sort(np.asarray(peaks, float))
    none = (NO_MATCH, stretch, (0.0, 0.0))
    if any(len(t) < 2 for t in theory) or len(peaks) < 2:
        return none
    bounds = stretch * (1 - spread), stretch * (1 + spread)
    own = ends_of(theory, peaks, bounds, slack)
    if any(len(p) < 2 for p in own):
        return none
    lists = [edges(t, p, bounds) for t, p in zip(theory, own)]
    best, seen = none, set()
    for one, two in together(theory, own, *lists, window):
        pairs = [np.array([[e[0], e[2]], [e[1], e[3]]], int) for e in (one, two)]
        if tried is not None:
            tried.append(pairs)
        line = shared_line(theory, own, pairs)
        if line is None or line[0] <= 0:
            continue
        # many candidates match the same pairs and lead to the same line
        found = tuple(tuple(match(t, p * line[0] + b, window)) for t, p, b in zip(theory, own, line[1]))
        if found in seen or not all(found):
            continue
        seen.add(found)
        made = edge_cost(theory, own, pairs, window)
        if made and made < best:
            best = made
    return best


def candidates(theory: np.ndarray, peaks: np.ndarray, stretches: tuple[float, float], biases: tuple[float, float], window: float) -> list[Distance]:
    """(cost, stretch, bias) of all candidates of a list, each refitted to what it matches, the cheapest first."""
    if len(peaks) < 2 or not len(theory):
        return []
    centre = ((stretches[0] + stretches[1]) / 2, (biases[0] + biases[1]) / 2)
    options = np.vstack([[centre], pair_candidates(theory, peaks, stretches, biases)])
    out = set()
    for s, b in options:
        again = refit(theory, peaks, float(s), float(b), window)
        for own in ((float(s), float(b)), (float(again[0]), float(again[1]))):
            if stretches[0] <= own[0] <= stretches[1] and biases[0] <= own[1] <= biases[1]:
                out.add((chi_squared(theory, peaks, *own, window), *own))
    return sorted(out)


def _rest(theory: np.ndarray, peaks: np.ndarray, fit: Distance, window: float, ordered: bool, first: bool) -> np.ndarray:
    """Peaks left for the other pieces: those without a match, or those above (below) all matches."""
    used = [j for _, j in match(theory, (peaks - fit[2]) * fit[1], window)]
    if not used:
        return peaks[:0]
    if not ordered:
        return np.delete(peaks, used)
    return peaks[max(used) + 1 :] if first else peaks[: min(used)]


def pieces_fit(pieces: list[np.ndarray], peaks: np.ndarray, stretch: float = 1 / 8.8e-4, spread: float = 0.1, bias: tuple[float, float] = (-0.05, 0.05), window: float = 10.0, stretch_step: float = 10.0, bias_step: float = 3.0, ordered: bool = True) -> list[Distance]:
    """(cost, stretch, bias) of each piece of a hairpin, with the least sum of costs.

    One piece is fitted to all peaks, the others to what it leaves, with
    stretches within ``stretch_step`` and biases within ``bias_step`` of its
    own; each piece has its turn as the first. ``ordered`` pieces, two at most,
    don't overlap: all of the first's peaks lie below the second's, and its
    last position stays below the second's first. Without a fit each piece has
    the cost ``NO_MATCH``.
    """
    pieces, peaks = [np.sort(np.asarray(p, float)) for p in pieces], np.sort(np.asarray(peaks, float))
    if ordered and len(pieces) > 2:
        raise ValueError("more than two pieces have no order")
    best: list[Distance] = [(NO_MATCH, stretch, 0.0)] * len(pieces)
    total = sum(x[0] for x in best)

    def search(left: list[int], peaks: np.ndarray, stretches: tuple[float, float], biases: tuple[float, float], fitted: dict[int, Distance], cost: float) -> None:
        nonlocal best, total
        for i in left:
            for fit in candidates(pieces[i], peaks, stretches, biases, window):
                if cost + fit[0] >= total:
                    break  # costs aren't negative, and the next ones are dearer
                now = fitted | {i: fit}
                if ordered and len(now) == 2:
                    place = lambda k, at: pieces[k][at] / now[k][1] + now[k][2]  # noqa: B023, E731
                    if not place(0, -1) < place(1, 0):
                        continue
                if len(left) == 1:
                    best, total = [now[k] for k in range(len(pieces))], cost + fit[0]
                    continue
                rest = _rest(pieces[i], peaks, fit, window, ordered, i == 0)
                if len(rest) >= 2:
                    around = lambda x, step: (x - step, x + step)
                    search([k for k in left if k != i], rest, around(fit[1], stretch_step), around(fit[2], bias_step), now, cost + fit[0])

    search(list(range(len(pieces))), peaks, (stretch * (1 - spread), stretch * (1 + spread)), bias, {}, 0.0)
    return best


def joined(pieces: list[np.ndarray], fits: list[Distance]) -> list[np.ndarray]:
    """All pieces' positions on the first's axis."""
    _, stretch, bias = fits[0]
    return [np.asarray(pieces[0], float), *(((np.asarray(p, float) / s + b) - bias) * stretch for p, (_, s, b) in zip(pieces[1:], fits[1:]))]
