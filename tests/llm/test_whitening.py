"""Whitening against NumPy on the whole matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, label int, index int, v string"


def made(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.2 + 0.3


@pytest.mark.parametrize("rows_of_block", [4096, 7])
def test_whitening(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(whitening, "ROWS", rows_of_block)
    x = made(150, 9)
    rows = [(k if k % 50 else None, v.tolist(), 1, 5, "clash") for k, v in enumerate(x)] + [(3, x[3].tolist(), 1, 5, "again")]
    odd = [(900, None), (901, [1.0] * 8 + [None]), (902, [math.nan] * 9), (903, [math.inf] * 9), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(k, v, 0, 0, "") for k, v in odd], SCHEMA).repartition(4)
    got = whitening.whiten(df, 6).collect()
    whole = np.floor(64 * np.array([r[1] for r in rows])).astype(int) + 1000000
    n = len(rows)
    mid = whole - whole.mean(axis=0)
    v = mid.T @ mid / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:6], u[:, ::-1][:, :6]
    want = mid @ (u / np.sqrt(e))
    assert len(got) == n and sorted(map(str, (r.vec_id for r in got))) == sorted(str(r[0]) for r in rows)
    total = [int(s) for s in whole.sum(axis=0)]
    exact = {}
    for row, w, y in zip(rows, whole, want, strict=True):
        exact.setdefault(row[0], []).append((sum((n * int(a) - s) ** 2 for a, s in zip(w, total, strict=True)), y))
    sign = None
    for r in got:
        assert r.n == n and r.deviation in [a for a, _ in exact[r.vec_id]] and r.identity_error < 1e-9
        y = next(y for a, y in exact[r.vec_id] if a == r.deviation)
        sign = np.sign(np.array(r.whitened) * y) if sign is None else sign
        assert np.allclose(np.array(r.whitened) * sign, y, atol=1e-8) and np.allclose(r.explained, e / np.trace(v), rtol=1e-9)


def test_without_variance(spark):
    rows = [(k, [0.5, 0.25 * (k % 2), -0.5 * (k % 2)], 0, 0, "") for k in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = whitening.whiten(df).collect()
    assert all(len(r.whitened) == 1 and abs(abs(r.whitened[0]) - 1) < 1e-12 for r in got) and len(got) == 10
    same = whitening.whiten(df.where("vec_id % 2 = 0")).collect()
    assert [r.whitened for r in same] == [[]] * 5 and {r.deviation for r in same} == {0}
    assert whitening.whiten(df.where("false")).count() == 0
    huge = whitening.whiten(df.withColumn("embedding", F.transform("embedding", lambda e: e * 1e300))).collect()
    assert len(huge) == 10 and all(r.deviation is None for r in huge)


def test_rows_of_a_matrix_outlive_a_collection(spark, monkeypatch):
    """The JVM's matrix is held until its rows are asked for, whenever Python collects garbage."""
    import gc
    import time

    call, x = whitening.callMLlibFunc, made(30, 3)

    def late(name, *args):
        gc.collect()
        time.sleep(0.5)  # the JVM is told in the background
        return call(name, *args)

    monkeypatch.setattr(whitening, "callMLlibFunc", late)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "index bigint, v array<double>")
    got = {r["index"]: r["v"] for r in whitening.rows_of(whitening.block_matrix(df, 30, 3)).collect()}
    assert np.allclose([got[k] for k in range(30)], x, atol=1e-12)
