"""Training on the driver over a bounded sample, for the classifiers."""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, *shapes, rate: float = 0.02):
        self.m = [np.zeros(s, np.float32) for s in shapes]
        self.v = [np.zeros(s, np.float32) for s in shapes]
        self.rate, self.t = rate, 0

    def step(self, values: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(values, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
