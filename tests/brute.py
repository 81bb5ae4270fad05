"""Brute-force NumPy references used by the tests (small inputs only)."""

from __future__ import annotations

import numpy as np


def dbscan_brute(P: np.ndarray, eps: float, min_samples: int):
    """core mask and labels (border → smallest adjacent core component, by first member index)."""
    n = len(P)
    d2 = ((P[:, None, :] - P[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= min_samples
    comp = -np.ones(n, dtype=int)
    cur = 0
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack = [i]
            comp[i] = cur
            while stack:
                j = stack.pop()
                for k in np.nonzero(nb[j] & core)[0]:
                    if comp[k] < 0:
                        comp[k] = cur
                        stack.append(k)
            cur += 1
    labels = comp.copy()
    for i in range(n):
        if not core[i]:
            cand = comp[nb[i] & core]
            labels[i] = cand.min() if len(cand) else -1
    return core, labels


def silhouette_sq(P: np.ndarray, labels: np.ndarray) -> float:
    """Silhouette with squared Euclidean distances (MLlib definition)."""
    d = ((P[:, None, :] - P[None, :, :]) ** 2).sum(-1)
    uniq = np.unique(labels)
    s = np.zeros(len(P))
    for i in range(len(P)):
        own = labels == labels[i]
        if own.sum() <= 1:
            s[i] = 0.0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == u].mean() for u in uniq if u != labels[i])
        s[i] = (b - a) / max(a, b)
    return float(s.mean())
