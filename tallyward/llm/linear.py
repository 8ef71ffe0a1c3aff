"""Linear hinge-loss models on sparse rows, fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


def dual_coordinate_descent(rows: list[Row], signs: np.ndarray, width: int, cost: float = 1.0, rounds: int = 12,
                            seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss machine for rows of (feature, value) arrays and signs +1 / -1.

    One dual variable per row, kept in [0, cost] and moved to its optimum in random order; the bias is
    one more feature of value one.
    """
    weights, bias = np.zeros(width), 0.0
    dual = np.zeros(len(rows))
    squares = np.array([values @ values + 1.0 for _, values in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            features, values = rows[i]
            slope = signs[i] * (weights[features] @ values + bias) - 1.0
            new = min(max(dual[i] - slope / squares[i], 0.0), cost)
            if new != dual[i]:
                step = (new - dual[i]) * signs[i]
                weights[features] += step * values
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-4:
            break
    return weights, bias


def sigmoid(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))
