import math
from decimal import Decimal

import numpy as np
import pytest

from panelspark.llm import whitening

VEC = "vec_id long, embedding array<float>, label int, y array<long>, n long, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, [1], 7, "c") for i, v in rows], VEC)


def plain(rows, scale=1024):
    """(ids, y, eigenvalues, eigenvectors) by a dense decomposition."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    y = np.floor(scale * np.array([v for _, v in kept], dtype=np.float32).astype(float))
    centred = y - y.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(y))
    return [i for i, _ in kept], y, values[::-1], vectors[:, ::-1]


def gaussian(n, d, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * (np.ones(d) if spread is None else spread) + rng.standard_normal(d)
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("spread", [None, 0.8 ** np.arange(40.0), np.r_[np.full(5, 3.0), np.full(35, 1e-2)]])
def test_equals_a_dense_decomposition(spark, spread):
    rows = [*gaussian(300, 40, spread=spread), (1000, None), (1001, [1.0, None] * 20), (1002, [math.nan] * 40),
            (1003, [math.inf] * 40), (None, [0.5] * 40), (1004, [])]
    ids, y, values, vectors = plain(rows)
    ready = whitening.integer_vectors(table(spark, rows))
    model = whitening.fit(ready, components=8, block=16)
    assert model.n == len(ids) and model.sums == y.sum(0).astype(int).tolist()
    np.testing.assert_allclose(model.values, values[:8], rtol=1e-11)
    np.testing.assert_allclose(model.trace, values.sum(), rtol=1e-11)
    if spread is None or spread[1] != spread[0]:  # else the first five may turn among themselves
        np.testing.assert_allclose(np.abs(np.sum(model.vectors * vectors[:, :8], 0)), 1, atol=1e-11)
    out = whitening.whiten(ready, model).collect()
    assert len(out) == 8 * len(ids) and {r.vec_id for r in out} == set(ids)
    n = len(ids)
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, y.sum(0))) for i, row in zip(ids, y)}
    assert all(int(r.deviation) == exact[r.vec_id] for r in out)
    z = np.zeros((n, 8))
    for r in out:
        z[ids.index(r.vec_id), r.component - 1] = r.whitened
    np.testing.assert_allclose(z, (y - y.mean(0)) @ model.vectors / np.sqrt(model.values), rtol=1e-9, atol=1e-9)
    assert out[0].identity_error <= 1e-9
    assert abs(np.abs(z.T @ z / n - np.eye(8)).max() - out[0].identity_error) < 1e-10
    for r in out:
        assert abs(r.explained * values.sum() / values[r.component - 1] - 1) < 1e-9


def test_filter_damps_the_unwanted_spectrum():
    values = np.r_[np.linspace(2, 1.5, 8), np.linspace(1.0, 0, 56)]
    out = whitening._filtered(lambda q: values[:, None] * q, np.ones((64, 1)), values[:, None] * np.ones((64, 1)), 1.0, 2.0, 12)
    assert np.abs(out[8:]).max() < 1e-4 * np.abs(out[0]).max()
    assert np.abs(out[7]) > 50 * np.abs(out[8:]).max()


def test_few_directions_repeats_and_odd_lengths(spark):
    rows = [(0, [0.0, 0.0, 1.0]), (0, [0.0, 0.0, 1.0]), (1, [1.0, 0.0, 1.0]), (2, [2.0, 0.0, 1.0]), (3, [1.0]), (4, [1e30, 0.0, 0.0])]
    ready = whitening.integer_vectors(table(spark, rows))
    model = whitening.fit(ready)
    assert model.n == 4 and len(model.values) == 1
    out = whitening.whiten(ready, model).collect()
    assert sorted(r.vec_id for r in out) == [0, 0, 1, 2] and {r.component for r in out} == {1}
    assert abs(out[0].explained - 1) < 1e-12 and out[0].identity_error < 1e-12


def test_equal_vectors_and_empty_table_give_no_rows(spark):
    for rows in ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [3.0])], [], [(1, None)]):
        ready = whitening.integer_vectors(table(spark, rows))
        assert whitening.whiten(ready, whitening.fit(ready)).collect() == []


def test_large_sums_stay_exact():
    y = np.array([[2**51, -(2**51)], [3, 4]])
    sums = [2**51 + 3, 4 - 2**51]
    got = whitening._deviations(y, 10**6, sums)
    expected = [sum((10**6 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in y]
    assert got == [None if e >= 10**38 else Decimal(e) for e in expected]
