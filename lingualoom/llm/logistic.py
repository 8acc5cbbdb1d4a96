"""Logistic regression on a bounded sample, by Newton's method."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights for the columns of ``x`` and, last, the constant.  Without rows all are 0."""
    x = np.c_[x, np.ones(len(x))]
    weights = np.zeros(x.shape[1])
    # The constant is hardly held back, so that one class alone still moves it.
    hold = np.diag(np.r_[np.full(x.shape[1] - 1, ridge), 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - hold @ weights
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + hold, slope)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return weights
