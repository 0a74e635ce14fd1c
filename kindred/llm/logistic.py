"""Logistic calibration of a few features by Newton's method, for bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the constant), and the means and scales that features are taken relative to.

    With one class only, or no rows, the constant alone is fitted, with half a row of either class added.
    """
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(x.std(0), 1e-9) if len(x) else np.ones(x.shape[1])
    w = np.zeros(x.shape[1] + 1)
    if len(set(y.tolist())) < 2:
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w, mean, scale
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(len(w), ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w, mean, scale


def apply(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))
