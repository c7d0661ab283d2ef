"""Time-series distances: dynamic time warping and its relatives (NumPy, row by row of the table)."""

from __future__ import annotations

import numpy as np


def dtw_path(a: np.ndarray, b: np.ndarray, window: int = 0, squared: bool = False) -> tuple[float, list[tuple[int, int]]]:
    """(distance, aligned positions); window 0 is none, else |j - floor(i m / n)| <= window."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if window and abs(j - i * m // n) > window:
                continue
            d = abs(a[i - 1] - b[j - 1])
            cost[i, j] = (d * d if squared else d) + min(cost[i - 1, j - 1], cost[i, j - 1], cost[i - 1, j])
    path, i, j = [], n, m
    while i > 0 and j > 0 and np.isfinite(cost[i, j]):
        path.append((i - 1, j - 1))
        steps = (cost[i - 1, j - 1], cost[i, j - 1], cost[i - 1, j])
        k = int(np.argmin(steps))
        i, j = (i - 1, j - 1) if k == 0 else (i, j - 1) if k == 1 else (i - 1, j)
    return float(cost[n, m]), path[::-1]


def dtw(a: np.ndarray, b: np.ndarray, window: int = 0) -> float:
    return dtw_path(a, b, window)[0]


def soft_dtw(a: np.ndarray, b: np.ndarray, gamma: float = 1.0, window: int = 0) -> float:
    n, m = len(a), len(b)
    r = np.full((n + 1, m + 1), np.inf)
    r[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if window and abs(j - i * m // n) > window:
                continue
            v = np.array([r[i - 1, j - 1], r[i, j - 1], r[i - 1, j]])
            low = v.min()
            least = low if not np.isfinite(low) else low - gamma * np.log(np.exp(-(v[np.isfinite(v)] - low) / gamma).sum())
            r[i, j] = (a[i - 1] - b[j - 1]) ** 2 + least
    return float(r[n, m])


def alignment_kernel(a: np.ndarray, b: np.ndarray, sigma: float = 1.0, triangular: bool = False) -> float:
    """Global alignment kernel."""
    delta = a[:, None] - b[None, :]
    local = np.maximum(0.0, 1 - np.abs(delta) / sigma) if triangular else np.exp(-(delta**2) / (2 * sigma**2))
    g = np.zeros((len(a) + 1, len(b) + 1))
    g[0, 0] = 1.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            g[i, j] = local[i - 1, j - 1] * (g[i - 1, j - 1] + g[i - 1, j] + g[i, j - 1])
    return float(g[-1, -1])


def derivative(x: np.ndarray) -> np.ndarray:
    return np.diff(x) if len(x) > 1 else np.zeros(1)


def distance(kind: str, a: np.ndarray, b: np.ndarray, window: int = 0, gamma: float = 1.0, sigma: float = 1.0) -> float:
    """What time-series clustering compares: DTW as it is, other kinds squared or as kernel distance."""
    if kind == "dtw":
        return dtw(a, b, window)
    if kind == "derivative":
        return dtw(derivative(a), derivative(b), window) ** 2
    if kind == "softdtw":
        return soft_dtw(a, b, gamma, window)
    if kind == "gak":
        cross = alignment_kernel(a, b, sigma)
        return alignment_kernel(a, a, sigma) + alignment_kernel(b, b, sigma) - 2 * cross
    raise ValueError(f"unknown sequence kernel {kind!r}")


def _table(a: np.ndarray, b: np.ndarray, window: int, squared: bool = False) -> np.ndarray:
    """(n + 1, m + 1, p, q) costs of warping p series of length n onto q of length m, cell by cell for all pairs at once."""
    (p, n), (q, m) = a.shape, b.shape
    cost = np.full((n + 1, m + 1, p, q), np.inf)
    cost[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if window and abs(j - i * m // n) > window:
                continue
            d = np.abs(a[:, i - 1, None] - b[:, j - 1])
            cost[i, j] = (d * d if squared else d) + np.minimum(np.minimum(cost[i - 1, j - 1], cost[i, j - 1]), cost[i - 1, j])
    return cost


def by_length(series: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the series of each length."""
    n = np.array([len(s) for s in series])
    return [(at, np.array([series[i] for i in at], dtype=float)) for at in (np.flatnonzero(n == k) for k in np.unique(n))]


def cross(kind: str, a: list[np.ndarray], b: list[tuple[np.ndarray, np.ndarray]], window: int = 0, gamma: float = 1.0, sigma: float = 1.0) -> np.ndarray:
    """``distance`` of every series of ``a`` to those of ``b`` (as by ``by_length``): DTW for all pairs at once, others pair by pair."""
    out = np.zeros((len(a), sum(len(at) for at, _ in b)))
    for i, x in by_length(a):
        for j, y in b:
            if kind in ("dtw", "derivative"):
                u, v = (np.diff(z) if z.shape[1] > 1 else np.zeros((len(z), 1)) for z in (x, y)) if kind == "derivative" else (x, y)
                d = _table(u, v, window)[-1, -1]
                out[np.ix_(i, j)] = d**2 if kind == "derivative" else d
            else:
                out[np.ix_(i, j)] = [[distance(kind, s, t, window, gamma, sigma) for t in y] for s in x]
    return out


def aligned(centre: np.ndarray, series: list[np.ndarray], weights: np.ndarray, window: int = 0, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums of what is aligned to each position, their weights), as by the paths of ``dtw_path``."""
    sums, n = np.zeros(len(centre)), np.zeros(len(centre))
    for at, x in by_length(series):
        for low in range(0, len(at), chunk):
            s, w = x[low : low + chunk], weights[at[low : low + chunk]]
            cost = _table(np.asarray(centre, dtype=float)[None], s, window)[:, :, 0]
            row = np.arange(len(s))
            i, j = np.full(len(s), len(centre)), np.full(len(s), s.shape[1])
            while len(row := row[(i[row] > 0) & (j[row] > 0)]):
                a, b = i[row], j[row]
                on = np.isfinite(cost[a, b, row])
                row, a, b = row[on], a[on], b[on]
                if not len(row):
                    break
                np.add.at(sums, a - 1, w[row] * s[row, b - 1])
                np.add.at(n, a - 1, w[row])
                step = np.argmin([cost[a - 1, b - 1, row], cost[a, b - 1, row], cost[a - 1, b, row]], axis=0)
                i[row], j[row] = a - (step != 1), b - (step != 2)
    return sums, n


def barycentre(series: list[np.ndarray], weights: list[float] | None = None, rounds: int = 10, window: int = 0, total: np.ndarray | None = None) -> np.ndarray:
    """DTW barycentre: starts at the medoid; each position becomes the weighted mean of what is aligned to it.

    ``total``: each series' weighted sum of distances, if known.
    """
    w = np.ones(len(series)) if weights is None else np.asarray(weights, dtype=float)
    if total is None:
        b = by_length(series)
        total = np.concatenate([cross("dtw", [s], b, window) @ w for s in series])
    centre = series[int(np.argmin(total))].astype(float).copy()
    for _ in range(rounds):
        sums, n = aligned(centre, series, w, window)
        new = np.where(n > 0, sums / np.maximum(n, 1e-300), centre)
        if np.allclose(new, centre):
            break
        centre = new
    return centre
