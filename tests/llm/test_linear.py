"""The solvers of the classifiers against dense ones in plain numpy."""

import numpy as np
import pytest

from strandline.llm import linear, quality


def some_rows(seed, n=40, width=30):
    rng = np.random.default_rng(seed)
    listed = [np.unique(rng.integers(0, width, rng.integers(1, 9))) for _ in range(n)]
    return linear.Rows(listed), listed, rng


def test_dual_coordinate_descent_equals_a_dense_solve():
    """The same dual by projected gradient: rows of unit length and a one for the bias, between 0 and each row's cost."""
    rows, listed, rng = some_rows(3)
    y, scale, cost = (rng.random(40) < 0.4).astype(float), rng.normal(size=30), rng.uniform(0.2, 2.0, 40)
    w, bias = linear.dual_coordinate_descent(rows, scale, y, cost, passes=3000)
    x = np.zeros((40, 31))
    for i, j in enumerate(listed):
        x[i, j] = scale[j] / np.linalg.norm(scale[j])
        x[i, 30] = 1.0
    z = x * np.where(y > 0, 1.0, -1.0)[:, None]
    q, alpha = z @ z.T, np.zeros(40)
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    dense = z.T @ alpha
    hinge = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - z @ v)).sum()
    assert hinge(np.append(w, bias)) == pytest.approx(hinge(dense), rel=1e-2) and np.abs(np.append(w, bias) - dense).max() < 0.05


def test_log_count_ratios_and_score_by_hand():
    listed = [np.array([1, 2]), np.array([1]), np.array([2, 3])]
    y = np.array([1.0, 1.0, 0.0])
    ratio = quality._ratios(linear.Rows(listed), y)
    size = 1 << quality.BITS
    one, zero = {1: 2, 2: 1}, {2: 1, 3: 1}
    for f in (1, 2, 3, 4):
        want = np.log((one.get(f, 0) + 1) / (3 + size)) - np.log((zero.get(f, 0) + 1) / (2 + size))
        assert ratio[f] == pytest.approx(want)
    model = quality.fit([quality.features(t) for t in ("good words here", "good text", "bad bad", "bad words!!")], np.array([1, 1, 0, 0]), np.arange(4))
    found = quality.features("good words, bad text")
    x = model.product[found].sum() / np.sqrt(model.square[found].sum())
    assert model.score("good words, bad text") == pytest.approx(1 / (1 + np.exp(-(model.a * (x + model.bias) + model.b))))


def test_logistic_reaches_the_optimum():
    """At the end the gradient of the loss with its ridge is zero, as in a dense solve."""
    rows, listed, rng = some_rows(8)
    y, dense = (rng.random(40) < 0.5).astype(float), rng.random((40, 2))
    w, v, b = linear.logistic(rows, 30, dense, y, steps=20_000)
    x = np.zeros((40, 30))
    for i, j in enumerate(listed):
        x[i, j] = 1.0
    g = 1 / (1 + np.exp(-(x @ w + dense @ v + b))) - y
    assert np.abs(x.T @ g + w).max() < 1e-3 and np.abs(dense.T @ g + v).max() < 1e-3 and abs(g.sum()) < 1e-3


def test_calibration_maximises_the_likelihood():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * margin + 0.5))).astype(float)
    a, b = linear.calibrate(margin, y)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (300 - y.sum() + 2))
    p = 1 / (1 + np.exp(-(a * margin + b)))
    assert abs(((p - target) * margin).sum()) < 1e-3 and abs((p - target).sum()) < 1e-3
