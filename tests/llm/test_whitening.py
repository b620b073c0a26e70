"""Whitening against plain exact arithmetic and numpy."""

import random
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastrum.llm import queries, whitening

SF_DIR = "/root/testdata/sf0.001"


def usable(vectors):
    kept = [(k, v) for k, v in vectors if v is not None and all(c is not None and isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    return [(k, tuple(floor(64 * float(c)) + 1000000 for c in v)) for k, v in kept if len(v) == width]


def brute(vectors):
    """(n, {x: deviation}, mean, covariance as fractions) of the distinct integer vectors."""
    fit = sorted(set(x for _, x in usable(vectors)))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = [[n * x[i] - sums[i] for i in range(d)] for x in fit]
    covariance = [[Fraction(sum(c[i] * c[j] for c in centred), n**3) for j in range(d)] for i in range(d)]
    return n, {x: sum(v * v for v in c) for x, c in zip(fit, centred, strict=True)}, [Fraction(s, n) for s in sums], covariance


def leverrier(matrix):
    """Characteristic polynomial by Faddeev and LeVerrier, exact, from the constant up."""
    d = len(matrix)
    found, m = [1], [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (found[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        trace = sum(sum(matrix[i][t] * m[t][i] for t in range(d)) for i in range(d))
        found.append(-trace // k)
    return found[::-1]


def checked(df, vectors, tolerance=1e-9):
    n, deviations, mean, covariance = brute(vectors)
    rows = df.collect()
    values, axes = np.linalg.eigh(np.array(covariance, dtype=float))
    values = values[::-1]
    kept = min(16, int((values > 1e-9 * values[0]).sum()))
    own = {}
    for r in rows:
        own.setdefault(r.vec_id, []).append(r)
    expected = usable(vectors)
    assert len(rows) == kept * len(expected)
    whole = np.zeros((kept, kept))
    for key, x in expected:
        found = sorted((r for r in own[key]), key=lambda r: r.component)
        assert [r.component for r in found] == [c for c in range(1, kept + 1) for _ in range(len(found) // kept)]
        assert {r.n for r in found} == {n}
        assert deviations[x] in {int(r.deviation) for r in found}
        assert max(r.identity_error for r in found) <= 1e-4
        np.testing.assert_allclose([r.explained for r in found][:: len(found) // kept], values[:kept] / sum(values), rtol=1e-9)
    fit = {x: [r.whitened for r in sorted(own[key], key=lambda r: r.component)] for key, x in expected if len(own[key]) == kept}
    if len(fit) == n:
        w = np.array(list(fit.values()))
        np.testing.assert_allclose(w.T @ w / n, np.eye(kept), atol=tolerance)
        centred = np.array([[float(Fraction(v) - m) for v, m in zip(x, mean, strict=True)] for x in fit])
        axes = centred.T @ w / n / np.sqrt(values[:kept])  # the components themselves
        np.testing.assert_allclose(np.array(covariance, dtype=float) @ axes, axes * values[:kept], atol=tolerance * values[0])
    assert whole.shape == (kept, kept)


def frame(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for name in ("key", "y", "n", "component", "whitened", "number", "deviation"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


def test_query_equals_plain_arithmetic(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    checked(queries.op11_whitening(spark, SF_DIR), vectors)


def test_odd_rows(spark):
    chance = random.Random(1)
    vectors = [(i, [chance.gauss(0, 3) for _ in range(5)]) for i in range(40)]
    vectors += [(100 + i, list(vectors[0][1])) for i in range(20)]
    vectors += [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("-inf"), 1.0, 1.0, 1.0, 1.0])]
    vectors += [(204, []), (205, [1.0]), (206, [1e3, -1e3, 3.0, 5.0, 7.0])]
    checked(whitening.whiten(frame(spark, vectors)), vectors)


def test_null_and_repeated_ids_stay(spark):
    vectors = [(None, [1.0, 2.0]), (None, [3.0, 5.0]), (1, [0.0, 9.0]), (1, [0.0, 9.0])]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert sorted((r.vec_id is None, r.component) for r in rows) == [(False, 1)] * 2 + [(False, 2)] * 2 + [(True, 1)] * 2 + [(True, 2)] * 2


def test_multiple_and_zero_eigenvalues(spark):
    """The corners of a cube have one eigenvalue three times; a fourth entry is constant."""
    corners = [(i, [float(i >> b & 1) for b in range(3)] + [7.0]) for i in range(8)]
    checked(whitening.whiten(frame(spark, corners)), corners)


def test_close_eigenvalues(spark):
    vectors = [(i, [sign * (10.0 if k == a else 0.0) for k in range(3)]) for i, (a, sign) in enumerate((a, s) for a in range(3) for s in (1, -1))]
    vectors.append((6, [10 + 1 / 64, 0.0, 0.0]))
    checked(whitening.whiten(frame(spark, vectors)), vectors)


def test_huge_entries_stay_exact(spark):
    chance = random.Random(2)
    vectors = [(i, [chance.uniform(-1, 1) * 2.0**45 for _ in range(3)]) for i in range(30)]
    checked(whitening.whiten(frame(spark, vectors)), vectors)


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_without_two_distinct_vectors_there_is_no_result(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).collect() == []


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_polynomial(spark, d):
    chance = random.Random(d)
    rows = [[chance.randrange(-(10**6), 10**6) if chance.random() < 0.6 else 0 for _ in range(d)] for _ in range(d + 2)]
    matrix = [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]
    assert whitening.characteristic_polynomial(spark.range(1), matrix) == leverrier(matrix)


def test_root_counts():
    polynomial = [1]
    for root in (0, 3, 3, 8, 20):
        polynomial = [(polynomial[k - 1] if k else 0) - root * (polynomial[k] if k < len(polynomial) else 0) for k in range(len(polynomial) + 1)]
    for at in range(-1, 22):
        assert whitening.roots_above(polynomial, 2 * at + 1, 1) == sum(root > at + 0.5 for root in (0, 3, 3, 8, 20))
    assert [(r.count, r.above) for r in whitening.largest_roots(polynomial, 4)] == [(1, 0), (1, 1), (2, 2)]


def test_scatter_sums_do_not_depend_on_the_path(spark):
    rows = np.array([[2**20, -(2**20) - 5], [3, 2**40], [-7, 1]])
    assert (whitening._products(rows) == rows.astype(object).T @ rows.astype(object)).all()
    assert sum(part << (30 * k) for k, part in enumerate(whitening._limbs(-(2**95) + 3))) == -(2**95) + 3
