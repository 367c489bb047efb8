"""Whitening against numpy on the whole matrix, and its defined cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from saltmarsh.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, i string"


def expected(vectors):
    """Fit by brute force: distinct x in Python integers, covariance in long doubles."""
    x = {i: [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v] for i, v in vectors.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    c = np.array((fit * n - sums) / n, dtype=np.longdouble)
    return x, n, sums, np.array(c.T @ c / n, dtype=np.float64)


def check(spark, vectors, more=()):
    rows = [(i, v, "clash", None) for i, v in vectors.items()] + list(more)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    x, n, sums, cov = expected(vectors)
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(16, int((values > 1e-12 * values.sum()).sum()))
    by = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-6
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) <= 1e-9
        by.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    assert set(by) == set(vectors) and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    # The projections are those on unit eigenvectors: they determine the axes by least squares over the fit.
    ids = list(vectors)
    c = np.array([[float((n * a - s) / n) for a, s in zip(x[i], sums, strict=True)] for i in ids])
    w = np.array([[by[i][j] for j in range(1, k + 1)] for i in ids]) * np.sqrt(values[:k])
    axes = np.linalg.lstsq(c, w, rcond=1e-12)[0]
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-6
    assert np.abs(cov @ axes - axes * values[:k]).max() < 1e-7 * values[0]


def test_equals_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24)) + 3
    vectors = {i: [float(e) for e in v] for i, v in enumerate(base)}
    vectors[900] = vectors[5]
    vectors[901] = [e + 1e-9 for e in vectors[6]]  # another vector, the same steps
    check(spark, vectors, [(-1, None, None, None), (-2, [1.0] * 23 + [None], None, None), (-3, [math.nan] * 24, None, None), (-4, [math.inf] * 24, None, None), (-5, [1.0], None, None), (-6, [], None, None)])


def test_badly_scaled_and_dependent_dimensions(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 6)) * [2e4, 4e3, 300.0, 20.0, 5.0, 1.0]
    wide = np.column_stack([base, base[:, 0].astype(np.float32), np.full(200, 7.0)])  # one repeated, one constant
    check(spark, {i: [float(e) for e in v] for i, v in enumerate(wide)})


def test_fewer_vectors_than_dimensions(spark):
    rng = np.random.default_rng(3)
    check(spark, {i: [float(e) for e in v] for i, v in enumerate(rng.normal(size=(9, 40)))})


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], None, None)], [(1, [1.0, 2.0], None, None)] * 3, [(1, None, None, None)]])
def test_without_variance_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_repeated_rows_null_ids_and_large_entries(spark):
    rows = [(None, [1.0, 0.0], None, None), (2, [3.0, 1.0], None, None), (2, [3.0, 1.0], None, None), (3, [1e30, 1.0], None, None), (4, [-2.0**40, 5.0], None, None)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    k = max(r["component"] for r in got)
    assert sorted(str(r["vec_id"]) for r in got) == ["2"] * 2 * k + ["4"] * k + ["None"] * k
    assert {r["n"] for r in got} == {3} and all(r["deviation"] is None for r in got if r["vec_id"] == 4)
    assert all(r["identity_error"] < 1e-4 for r in got)
