"""The network's gradient, its training and its early stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsense.operators import models, network


@pytest.mark.parametrize("classes", [0, 3])
def test_gradient_by_differences(classes):
    rng = np.random.default_rng(7)
    net = network.random_network([4, 6, 5, classes or 1], classes, 3)
    net.params = [p + 0.1 * rng.normal(size=p.shape) for p in net.params]
    x = rng.normal(size=(9, 4))
    y = rng.integers(0, 3, 9).astype(float) if classes else rng.normal(size=9)
    grads = net.loss_and_gradient(x, y)[1]
    for p, g in zip(net.params, grads):
        for at in list(np.ndindex(p.shape))[:12]:
            keep, h = p[at], 1e-6
            p[at] = keep + h
            up = net.loss_and_gradient(x, y)[0]
            p[at] = keep - h
            down = net.loss_and_gradient(x, y)[0]
            p[at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-6)


def _rows(spark, n=600):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 2))
    return x, spark.createDataFrame([(v.tolist(), float(v[0] > v[1]), bool(k % 10)) for k, v in enumerate(x)],
                                    "x array<double>, y double, fit boolean").repartition(4)


def test_batches_and_partitions_sum_to_the_gradient(spark):
    x, rows = _rows(spark)
    net = network.random_network([2, 5, 2], 2, 3)
    want_loss, want = net.loss_and_gradient(x[[k for k in range(600) if k % 10]], (x[:, 0] > x[:, 1]).astype(float)[[k for k in range(600) if k % 10]])
    unseen = net.loss_and_gradient(x[::10], (x[:, 0] > x[:, 1]).astype(float)[::10])[0]
    blocks = network._pack(rows, 4, 0)
    for many in (False, True):
        found = [network._totals(blocks, net, many)]
        assert np.allclose(found[0][0], np.concatenate([g.ravel() for g in want]))
        assert found[0][1] == pytest.approx(want_loss) and found[0][2] == pytest.approx(unseen)


def test_training_stops_early_and_keeps_the_best(spark, monkeypatch):
    monkeypatch.setattr(network, "BATCH_ROWS", 200)  # two mini-batches
    x, rows = _rows(spark)
    net = network.train(rows, (8,), 2, 60, 0.001, 0.05, 3, 1e-2, 5)
    assert net.converged and net.epochs < 60
    held = network.Network(net.params, 2)
    loss = held.loss_and_gradient(x[::10], (x[:, 0] > x[:, 1]).astype(float)[::10])[0] / 60
    assert loss == pytest.approx(min(net.losses), rel=0.02)
    assert (held.output(x).argmax(axis=1) == (x[:, 0] > x[:, 1])).mean() > 0.95
    assert network.train(rows.where("false"), (8,), 2, 5, 0.001, 0.05, 3, 1e-2, 5).epochs == 0
    only = network.train(rows.where("fit"), (8,), 2, 5, 0.001, 0.05, 3, 1e-2, 5)
    assert len(only.losses) == 5


@pytest.mark.parametrize("kind", [lambda k: k, lambda k: F.concat(F.lit("kind "), k.cast("string"))])
def test_classes_as_numbers_and_as_text(spark, kind):
    df = spark.range(900).select("id", ((F.col("id") % 3) * 50 + F.rand(3)).alias("a"), F.rand(4).alias("b"), kind(F.col("id") % 3).alias("c"))
    metrics, net = models.mlp_classification(df, ["a", "b"], "c", key_cols=["id"], max_iter=80)
    found = {r["metric"]: r["value"] for r in metrics.collect()}
    assert found["accuracy"] == 1.0 and found["roc_auc"] == 1.0
    assert net.classes == 3 and net.epochs <= 80


def test_a_block_is_worked_out_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    net = network.random_network([2, 5, 3], 3, 3)
    x, y = rng.normal(size=(10_000, 2)), rng.integers(0, 3, 10_000).astype(float)
    want_loss, want = net.loss_and_gradient(x, y)
    sizes, whole = [], net.loss_and_gradient
    monkeypatch.setattr(net, "loss_and_gradient", lambda a, b: sizes.append(len(b)) or whole(a, b))
    loss, gradient = network._block_sums(net, x, y)
    assert loss == pytest.approx(want_loss) and np.allclose(gradient, np.concatenate([g.ravel() for g in want]))
    assert sum(sizes) == 10_000 and max(sizes) <= network.SLICE_ROWS
