"""Sparse rows, linear models and calibration for classifiers that learn from a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction


class Rows:
    """Binary features of many rows: row i has the features ``index[start[i]:start[i + 1]]``."""

    def __init__(self, listed: list[np.ndarray]):
        self.start = np.append(0, np.cumsum([len(x) for x in listed])).astype(np.int64)
        self.index = np.concatenate(listed).astype(np.int64) if listed else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.start) - 1

    def times(self, w: np.ndarray) -> np.ndarray:
        """The sum of the weights of each row's features."""
        run = np.append(0.0, np.cumsum(w[self.index]))
        return run[self.start[1:]] - run[self.start[:-1]]

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        """The sum over rows of ``g``, by feature."""
        return np.bincount(self.index, np.repeat(g, np.diff(self.start)), width)

    def take(self, which: np.ndarray) -> "Rows":
        return Rows([self.index[self.start[i] : self.start[i + 1]] for i in which])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a m + b) gives the share of ones, with smoothed targets; a is not negative."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        w, d = np.maximum(p * (1 - p), 1e-9), p - target
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(d * margin).sum(), d.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def dual_coordinate_descent(rows: Rows, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model with squared norm, fit in its dual.

    ``scale`` is the value of each feature where it is present; rows are brought to unit length. One
    dual variable at a time takes its best value between 0 and the row's cost.
    """
    n, sign = len(rows), np.where(y > 0, 1.0, -1.0)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(n)
    values = []
    for i in range(n):
        j = rows.index[rows.start[i] : rows.start[i + 1]]
        x = scale[j]
        length = np.sqrt(x @ x)
        values.append((j, x / length if length else x, 2.0 if length else 1.0))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(n):
            j, x, q = values[i]
            g = sign[i] * (w[j] @ x + bias) - 1.0
            new = min(max(alpha[i] - g / q, 0.0), cost[i])
            d = (new - alpha[i]) * sign[i]
            if d:
                alpha[i] = new
                w[j] += d * x
                bias += d
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def logistic(rows: Rows, width: int, dense: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 80) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the binary features, of the dense columns, and the bias, by scaled accelerated descent."""
    n, k = len(rows), dense.shape[1]
    # A bound of the curvature by feature: no row's margin moves more than its features' number allows.
    many = np.maximum(np.diff(rows.start) + (dense**2).sum(axis=1) + 1, 1)
    curve_w = 0.25 * rows.back(many, width) + ridge
    curve_d = 0.25 * (many[:, None] * np.abs(dense)).sum(axis=0) + ridge if k else np.zeros(0)
    curve_b = 0.25 * many.sum() + 1e-6
    w, v, b = np.zeros(width), np.zeros(k), 0.0
    back_w, back_v, back_b = w.copy(), v.copy(), b
    t = 1.0
    for _ in range(steps):
        g = sigmoid(rows.times(back_w) + dense @ back_v + back_b) - y
        new_w = back_w - (rows.back(g, width) + ridge * back_w) / curve_w
        new_v = back_v - (dense.T @ g + ridge * back_v) / curve_d if k else back_v
        new_b = back_b - g.sum() / curve_b
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / t_next
        back_w, back_v, back_b = new_w + pull * (new_w - w), new_v + pull * (new_v - v), new_b + pull * (new_b - b)
        w, v, b, t = new_w, new_v, new_b, t_next
    return w, v, float(b)


def labelled_sample(labels: DataFrame, classes: dict[str, Column], bound: int, train: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """Labels of about ``bound`` rows of each named class, chosen by a hash of the id.

    Each class is a condition on the label columns. A row that several conditions select appears once.
    Of rows that share an id the smallest by its other columns, in their order, counts. Rows without an
    id, or for which ``train`` (a condition on ``doc_id``) doesn't hold, are left out.
    """
    ready = labels.filter(F.col(id_col).isNotNull() & (F.lit(True) if train is None else train))
    sizes = ready.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in classes.items()]).first().asDict()
    chosen = F.lit(False)
    for name, c in classes.items():
        chosen = chosen | (F.coalesce(c, F.lit(False)) & (hash_fraction(F.col(id_col).cast("long")) < min(1.0, bound / max(sizes[name], 1))))
    rest = F.struct(*[c for c in labels.columns if c != id_col and not labels.schema[c].dataType.simpleString().startswith("map")])
    return ready.filter(chosen).groupBy(id_col).agg(F.min(rest).alias("_rest")).select(id_col, "_rest.*")
