"""Small linear models that are fitted on bounded samples with numpy."""

from __future__ import annotations

import numpy as np


def accelerated(gradient, start: np.ndarray, step: float, rounds: int) -> np.ndarray:
    """Nesterov's gradient method with a fixed step."""
    now = ahead = start
    for k in range(rounds):
        new = ahead - step * gradient(ahead)
        ahead, now = new + k / (k + 3) * (new - now), new
    return now


def _smoothness(x: np.ndarray, rounds: int = 20) -> float:
    """The largest eigenvalue of x'x / n, by power iteration."""
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(rounds):
        v = x.T @ (x @ v) / len(x)
        v /= max(np.linalg.norm(v), 1e-12)
    return float(np.linalg.norm(x.T @ (x @ v)) / len(x))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss; y is -1 or 1, weighted to balance."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype) * len(y)

    def gradient(w: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - y * (x @ w)) * weight
        return -2 * x.T @ (slack * y) / len(x) + 2 * penalty * w

    step = 1 / (2 * _smoothness(x) * float(weight.max()) + 2 * penalty)
    return accelerated(gradient, np.zeros(x.shape[1], x.dtype), step, rounds)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1e-5, rounds: int = 150) -> np.ndarray:
    """Weights (columns by class) of a multinomial logistic regression."""
    target = np.eye(classes, dtype=x.dtype)[y]

    def gradient(w: np.ndarray) -> np.ndarray:
        return x.T @ (softmax(x @ w) - target) / len(x) + penalty * w

    step = 1 / (0.5 * _smoothness(x) + penalty)
    return accelerated(gradient, np.zeros((x.shape[1], classes), x.dtype), step, rounds)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
