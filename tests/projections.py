"""The portfolio problem solved in memory by projections, to compare with."""

from __future__ import annotations

import numpy as np


def low_carbon_weights(base: np.ndarray, carbon: np.ndarray, group: np.ndarray, tilt: np.ndarray, cap: float, cut: float = 0.5, strength: float = 0.0) -> np.ndarray:
    """Weights next to the benchmark: sum 1, each in [0, cap], group weights as the benchmark's,
    carbon at most (1 - cut) of the benchmark's.  A convex problem, by Dykstra's projections."""
    target = base + strength / 2 * tilt
    bound = (1 - cut) * float(base @ carbon)
    groups = [np.flatnonzero(group == g) for g in np.unique(group)]
    sums = [float(base[g].sum()) for g in groups]
    norm = float(carbon @ carbon)

    def onto_groups(w):
        w = w.copy()
        for g, s in zip(groups, sums, strict=True):
            w[g] += (s - w[g].sum()) / len(g)
        return w

    def onto_carbon(w):
        over = float(w @ carbon) - bound
        return w - max(0.0, over) / norm * carbon if norm else w

    sets = (onto_groups, onto_carbon, lambda w: np.clip(w, 0.0, cap))
    w, rest = target.copy(), [np.zeros_like(base) for _ in sets]
    for _ in range(20_000):
        start = w.copy()
        for i, project in enumerate(sets):
            y = project(w + rest[i])
            rest[i] = w + rest[i] - y
            w = y
        if np.abs(w - start).max() < 1e-13:
            break
    return w
