"""Follow-the-regularised-leader with per-coordinate rates, L1 and L2, for one or many classes."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights for `size` features and `classes` outputs. One output is logistic, several are a softmax."""

    def __init__(self, size: int, classes: int = 1, rate: float = 0.1, smooth: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.bias = np.zeros(classes)
        self.bias_n = np.zeros(classes)

    def weights(self, rows=slice(None)) -> np.ndarray:
        """Closed form of the weights from the sums: zero wherever L1 isn't exceeded."""
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.smooth + np.sqrt(n)) / self.rate + self.l2))

    def step(self, rows: np.ndarray, values: np.ndarray | float, want: int) -> None:
        """One example: distinct features with values. want: its class, or 0 or 1 for one output."""
        w = self.weights(rows)
        v = values[:, None] if isinstance(values, np.ndarray) else values
        s = (w * v).sum(axis=0) + self.bias
        if len(s) == 1:
            g = 1 / (1 + np.exp(-np.clip(s, -35, 35))) - want
        else:
            g = np.exp(s - s.max())
            g /= g.sum()
            g[want] -= 1
        gv = g * v if isinstance(values, np.ndarray) else np.broadcast_to(g * v, w.shape)
        g2 = gv * gv
        n = self.n[rows]
        self.z[rows] += gv - (np.sqrt(n + g2) - np.sqrt(n)) / self.rate * w
        self.n[rows] = n + g2
        self.bias_n += g * g
        self.bias -= self.rate * g / (self.smooth + np.sqrt(self.bias_n))
