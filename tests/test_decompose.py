"""Decompositions against NumPy, on blocks so small that the tree has several levels."""

import numpy as np
import pytest

from chronomesh.operators import corpus as C
from chronomesh.operators import decompose as D
from chronomesh.operators import tensor as K


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 32)
    monkeypatch.setattr(D, "FAN", 2)


def table(spark, a, ids):
    return spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, a, strict=True)], "i bigint, row array<double>").repartition(4)


def gathered(u, ids):
    own = {r.i: r.u for r in u.collect()}
    assert len(own) == len(ids)
    return np.array([own[i] for i in ids])


def test_svd_of_an_ill_conditioned_matrix(spark, small):
    rng = np.random.default_rng(4)
    left, right = np.linalg.qr(rng.normal(size=(60, 5)))[0], np.linalg.qr(rng.normal(size=(5, 5)))[0]
    s = np.array([1e4, 10.0, 1.0, 1e-3, 1e-6])  # squared, the last ones drown
    a = left * s @ right
    ids = [3 * k - 20 for k in range(60)]
    u, got, vt = D.svd(table(spark, a, ids), 5)
    want = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(got, want[1], rtol=1e-10, atol=1e-12 * s[0])
    own = gathered(u, ids)
    assert np.abs(own.T @ own - np.eye(5)).max() < 1e-10 and np.abs(own * got @ vt - a).max() < 1e-10 * s[0]
    u, got, vt = D.svd(table(spark, a, ids), 5, 2)
    assert np.abs(gathered(u, ids) * got @ vt - want[0][:, :2] * want[1][:2] @ want[2][:2]).max() < 1e-9


def test_few_rows_and_none(spark, small):
    a = np.arange(6.0).reshape(2, 3) ** 2
    u, s, vt = D.svd(table(spark, a, [0, 100]), 3)
    assert np.abs(gathered(u, [0, 100]) * s @ vt - a).max() < 1e-12
    u, s, vt = D.svd(table(spark, a, [0, 100]).where("false"), 3)
    assert u.count() == 0 and len(s) == 0


def test_low_rank_keeps_the_places(spark, small):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20, 4))
    cells = [(i, j, float(a[i, j])) for i in range(20) for j in range(4)]
    got = {(r.i, r.j): r.v for r in K.low_rank(spark.createDataFrame(cells, "i int, j int, v double"), 2).collect()}
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    want = u[:, :2] * s[:2] @ vt[:2]
    assert len(got) == 80 and all(abs(v - want[k]) < 1e-10 for k, v in got.items())
    with pytest.raises(ValueError, match="columns"):
        D.dense_rows(spark.createDataFrame([(0, 5000, 1.0)], "i int, j int, v double"))


def test_embedding_spans_the_leading_space(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = np.linalg.qr(rng.normal(size=(30, 3)))[0]
    a = base * [9.0, 5.0, 3.0] @ base.T  # of rank three, so three columns catch it whole
    cells = [(i, j, float(a[i, j])) for i in range(30) for j in range(30)]
    got = {r.token_id: (r.x, r.y, r.z) for r in C.embed(spark.createDataFrame(cells, "i bigint, j bigint, pmi double")).collect()}
    e = np.array([got[k] for k in range(30)])
    want = base * [9.0, 5.0, 3.0]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(e @ e.T, want @ want.T, atol=1e-8)  # the same up to rotation and sign
