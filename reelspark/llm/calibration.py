"""Isotonic calibration of raw scores by pooling adjacent violators over bins."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, rate) of the non-decreasing rate that fits bins sorted by x best; x is a pool's mean."""
    pools: list[list[float]] = []
    for at, y, n in zip(x.tolist(), positives.tolist(), counts.tolist()):
        pools.append([at * n, y, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    knots = np.array(pools, float).reshape(-1, 3)
    return knots[:, 0] / knots[:, 2], knots[:, 1] / knots[:, 2]


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rates at raw scores, linear between the knots; one half without knots."""
    x, rate = knots
    return np.clip(np.interp(raw, x, rate), 0.0, 1.0) if len(x) else np.full(len(raw), 0.5)
