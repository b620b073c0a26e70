"""Lasso weights against the conditions that hold at the minimum, and rules against plain comparisons."""

import numpy as np

from cadastrum.llm import quality


def test_weights_are_at_the_minimum():
    chance = np.random.default_rng(4)
    marks = chance.random((3000, 12)) < 0.4
    marks[:, 5] = marks[:, 4]  # two rules alike
    ones = (chance.random(3000) < 1 / (1 + np.exp(-(2.0 * marks[:, 0] - 1.5 * marks[:, 1] - 0.3)))).astype(float)
    weights, intercept = quality.lasso_weights(marks, ones, 0.01)
    slope = marks.T @ (1 / (1 + np.exp(-(marks @ weights + intercept))) - ones) / 3000
    assert abs((1 / (1 + np.exp(-(marks @ weights + intercept))) - ones).mean()) < 1e-4
    assert (np.abs(slope[weights == 0]) <= 0.01 + 1e-4).all()
    assert np.allclose(slope[weights != 0], -0.01 * np.sign(weights[weights != 0]), atol=1e-4)
    assert weights[0] > 1 and weights[1] < -0.8 and (weights == 0).sum() >= 6


def test_marks_and_columns_agree(spark):
    rule = quality.Rule((("a", "<=", 2.0), ("a", ">", 0.5), ("b", ">", -1.0)))
    rows = [(x / 4, y / 2) for x in range(12) for y in range(-4, 4)]
    found = [r.m for r in spark.createDataFrame(rows, "a double, b double").select(rule.column().alias("m")).collect()]
    assert found == list(rule.marks({"a": np.array([r[0] for r in rows]), "b": np.array([r[1] for r in rows])}))
