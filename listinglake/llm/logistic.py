"""Logistic regression on a bounded table of features, by Newton steps."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Standardises the features; ``ridge`` keeps weights finite where classes separate fully."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 25):
        width = features.shape[1]
        self.mean = features.mean(axis=0) if len(features) else np.zeros(width)
        scale = features.std(axis=0) if len(features) else np.ones(width)
        self.scale = np.where(scale > 1e-9, scale, 1.0)
        self.weights = np.zeros(width + 1)
        if not len(features):
            return
        x = self._design(features)
        penalty = np.full(width + 1, ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):
            p = sigmoid(x @ self.weights)
            slope = x.T @ (labels - p) - penalty * self.weights
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, features: np.ndarray) -> np.ndarray:
        scaled = np.clip((features - self.mean) / self.scale, -20, 20)
        return np.column_stack((scaled, np.ones(len(features))))

    def probability(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self._design(features) @ self.weights)
