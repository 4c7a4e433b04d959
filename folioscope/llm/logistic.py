"""Logistic regression on the driver, for bounded samples: standardised features, L2, Newton steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30, prior: float = 0.5) -> Logistic:
    """Without rows, or with one class only, the answer is near the share of ones (``prior`` without rows)."""
    n, d = x.shape
    mean = x.mean(axis=0) if n else np.zeros(d)
    scale = x.std(axis=0) if n else np.ones(d)
    scale = np.where(scale > 1e-9, scale, 1.0)
    share = (y.sum() + prior) / (n + 1)
    w = np.zeros(d + 1)
    w[-1] = np.log(share / (1 - share))
    if n and 0 < y.sum() < n:
        z = np.hstack([(x - mean) / scale, np.ones((n, 1))])
        ridge = np.diag([l2] * d + [1e-6])
        for _ in range(steps):
            p = sigmoid(z @ w)
            hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge
            step = np.linalg.solve(hessian, z.T @ (y - p) - ridge @ w)
            w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
    return Logistic(mean, scale, w)
