"""Training on the cluster against the same training on the driver, model files, learned codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.operators import learning as L


def points(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [3, 1, 0.2] + [5, 0, -1]
    return x, (x[:, 0] + 2 * x[:, 1] > 5).astype(int)


def on_driver(x, y, net, epochs, rate=0.01):
    adam, losses = L.Adam(len(net.flat), rate), []
    for _ in range(epochs):
        g, loss, _ = net.sums(x, y)
        losses.append(loss / len(x))
        net.flat = net.flat - adam.step(g / len(x))
    return [*losses, net.sums(x, y)[1] / len(x)]


@pytest.mark.parametrize("classes", [True, False])
def test_gradients_are_those_of_small_steps(classes):
    x, y = points(20)
    net = L.Network(3, 4, 2, classes=classes)
    if not classes:
        y = np.stack([y, 1 - y], axis=1).astype(float)
    w = np.linspace(1, 2, 20)
    g, loss, by_input = net.sums(x, y, w)
    flat = net.flat
    for k in range(len(flat)):
        net.flat = flat + 1e-6 * (np.arange(len(flat)) == k)
        assert (net.sums(x, y, w)[1] - loss) / 1e-6 == pytest.approx(g[k], rel=1e-3, abs=1e-3)
    net.flat = flat
    moved = x.copy()
    moved[7, 1] += 1e-6
    assert (net.sums(moved, y, w)[1] - loss) / 1e-6 == pytest.approx(by_input[7, 1], rel=1e-3, abs=1e-3)


def test_training_equals_that_on_the_driver(spark, tmp_path):
    x, y = points()
    rows = spark.createDataFrame([(k, *map(float, v), int(t)) for k, (v, t) in enumerate(zip(x, y))], "id bigint, x double, y double, z double, target int").repartition(7)
    predicted, losses, net, used = L.position_classifier(rows, 8, 3, 25)
    mean, std = x.mean(axis=0), x.std(axis=0)
    plain = L.Network(3, 8, 2, 3)
    want = on_driver((x - mean) / std, y, plain, 25)
    assert losses == pytest.approx(want, rel=1e-9) and net.flat == pytest.approx(plain.flat, rel=1e-6, abs=1e-9)
    assert losses[-1] < losses[0]
    h = plain.forward((x - mean) / std)[1]
    got = {r.id: r for r in predicted.collect()}
    assert len(got) == len(x) and all(got[k].p_one == pytest.approx(h[k, 1], abs=1e-9) for k in got)
    assert L.summary(predicted).first().accuracy == pytest.approx((h.argmax(axis=1) == y).mean())
    L.save_network(spark, net, str(tmp_path / "model"), used)
    again, used_again = L.load_network(spark, str(tmp_path / "model"))
    assert np.array_equal(again.flat, net.flat) and used_again == used and again.classes
    same = {r.id: r.p_one for r in L.classify(rows, again, used_again).collect()}
    assert all(same[k] == got[k].p_one for k in got)
    with pytest.raises(ValueError, match="parameters"):
        again.flat = np.zeros(3)


def test_training_passes_over_unsound_rows_and_empty_tables(spark):
    x, y = points(60)
    schema = "id bigint, x double, y double, z double, target int"
    good = [(k, *map(float, v), int(t)) for k, (v, t) in enumerate(zip(x, y))]
    bad = [(90, None, 0.0, 0.0, 1), (91, float("nan"), 0.0, 0.0, 1), (92, 0.0, float("inf"), 0.0, 0), (93, 0.0, 0.0, 0.0, None)]
    nets = []
    for rows in (good, good + bad):
        nets.append(L.Network(3, 4, 2))
        losses = L.train(spark.createDataFrame(rows, schema), ["x", "y", "z"], "target", nets[-1], 3)
        assert len(losses) == 4
    assert nets[0].flat == pytest.approx(nets[1].flat, rel=1e-9)
    before = nets[0].flat
    assert L.train(spark.createDataFrame([], schema), ["x", "y", "z"], "target", nets[0], 3) == [] and np.array_equal(before, nets[0].flat)


def test_codes_learn_the_mean_place_of_each_token(spark):
    rng = np.random.default_rng(2)
    at = {k: rng.uniform(-1, 1, 3) for k in range(6)}
    rows = [(10 * k + j, k, *map(float, at[k] + (0.1 if j else -0.1) * (j < 2))) for k in at for j in range(3)]
    df = spark.createDataFrame([*rows, (99, None, 0.0, 0.0, 0.0), (98, 3, None, 0.0, 0.0)], "id bigint, token_id bigint, x double, y double, z double")
    out, losses = L.coordinate_branch(df, 4, 12, epochs=60)
    assert len(losses) == 61 and losses[-1] < losses[0] / 4
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows) + 2 and got[99].px is None and got[98].px is not None and got[98].l2_error is None
    each = [got[r[0]] for r in rows]
    error = np.mean([(r.x - r.px) ** 2 + (r.y - r.py) ** 2 + (r.z - r.pz) ** 2 for r in each])
    assert error == pytest.approx(losses[-1], rel=1e-6)
    own = out.where("l2_error is not null")
    assert L.error_summary(own).first().max_l2 == pytest.approx(own.agg(F.max("l2_error")).first()[0])
    assert L.CoordinateBranch().fit(df.limit(0)) == []
