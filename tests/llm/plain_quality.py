"""Minimum covariance determinant in numpy, group by group."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

from tapewright.llm import quality as q


def _vector(r) -> list[int]:
    n = r[4]
    fixed = lambda x: math.floor(math.log2(x) * q.UNIT + 0.5)
    return [fixed(r[5] / n), *[fixed(1 + 100 * v / n) for v in r[6:9]]]


def _at(values: np.ndarray, share: float) -> float:
    return np.sort(values)[math.ceil(len(values) * share) - 1]


def _floored(mean, cov):
    cov = cov.copy()
    for j, f in enumerate(q.FLOORS):
        cov[j, j] = max(cov[j, j], (f * q.UNIT) ** 2)
    return mean, cov


def _fit(x: np.ndarray, share: float):
    mean = x.mean(axis=0)
    return _floored(mean, (x.T @ x / len(x) - np.outer(mean, mean)) * q.consistency(share))


def _d2(x: np.ndarray, fit) -> np.ndarray:
    d = x - fit[0]
    return np.einsum("ij,ij->i", d, np.linalg.solve(fit[1], d.T).T)


def _starts(x: np.ndarray):
    low, mid, high = (np.array([_at(x[:, j], s) for j in range(4)]) for s in (0.25, 0.5, 0.75))
    spread = np.maximum((high - low) / 1.349, np.array(q.FLOORS) * q.UNIT)
    z = (x - mid) / spread
    norm = np.sqrt((z * z).sum(axis=1))
    for kind in q.STARTS:
        if kind == "median":
            yield mid, np.diag(spread**2)
            continue
        u = np.tanh(z) if kind == "tanh" else z / np.where(norm > 0, norm, 1)[:, None]
        u = np.floor(u * q.UNIT + 0.5)
        c = u.T @ u
        dev = np.sqrt(np.maximum(np.diag(c), 1.0))
        c = c / np.outer(dev, dev)
        np.fill_diagonal(c, 1.0 + q.RIDGE)
        yield mid, c * np.outer(spread, spread)


def _concentrated(x: np.ndarray):
    best = None
    for fit in _starts(x):
        det = math.inf
        for _ in range(q.MOST_STEPS):
            bins = np.floor(np.log2(1 + _d2(x, fit)) * 64)
            new = _fit(x[bins <= _at(bins, q.H)], q.H)
            logdet = float(np.linalg.slogdet(new[1])[1])
            if not logdet < det - q.TOLERANCE:
                break
            fit, det = new, logdet
        if best is None or det < best[0]:
            best = (det, fit)
    return best[1]


def _shrunk(x, fit, parent):
    """The reweighted fit, drawn to the parent's."""
    near = x[_d2(x, fit) <= q.chi2_quantile(q.NEAR, 4)]
    n = len(near)
    if parent is None:
        return _fit(near, q.NEAR)
    own = _fit(near, q.NEAR) if n else parent
    w = n / (n + q.PRIOR_ROWS)
    return w * own[0] + (1 - w) * parent[0], w * own[1] + (1 - w) * parent[1]


def fit_groups(rows) -> dict[int, float]:
    levels = [defaultdict(list) for _ in range(3)]
    for r in rows:
        for level, key in enumerate(((), (r[1],), (r[1], r[2]))):
            levels[level][key].append(r)
    fits, out = {}, {}
    for groups in levels:
        for key, members in groups.items():
            x = np.array([_vector(r) for r in members], float)
            fits[key] = _shrunk(x, _concentrated(x), fits[key[:-1]] if key else None)
            if len(key) == 2:
                out |= dict(zip([r[0] for r in members], _d2(x, fits[key]), strict=True))
    return out
