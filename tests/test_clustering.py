"""Euclidean silhouettes and shared-scan k-means against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsense.operators import clustering, kmeans, silhouette


def _silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1 or len(set(labels)) == 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != own)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(180, 5)) + rng.integers(0, 4, 180)[:, None]
    x[100:160] = x[100]  # equal rows, far from the origin
    x[100:160] += 1e6
    labels = rng.integers(0, 5, 180)
    labels[:70] = 7  # a cluster of more than a third
    labels[179] = 99  # alone
    return x, labels


@pytest.mark.parametrize("blocks", [(2048, 32), (16, 2)])
def test_euclidean_silhouette(spark, vectors, monkeypatch, blocks):
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(silhouette, "RUN", blocks[1])
    x, labels = vectors
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))] + [(500, [0.0] * 5, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, c int").repartition(3)
    want = _silhouette(x, labels)
    got = {r.id: r.silhouette for r in clustering.silhouette_values(df, "v", "c").collect()}
    assert sorted(got) == list(range(180))
    assert np.allclose([got[i] for i in range(180)], want, atol=1e-7)
    assert clustering.cluster_silhouette(df, "v", "c").first()[0] == pytest.approx(want.mean(), abs=1e-7)
    some = {r.id: r.silhouette for r in clustering.silhouette_values(df, "v", "c", queries=40).collect()}
    assert len(some) == 40 and all(some[i] == pytest.approx(want[i], abs=1e-7) for i in some)


def test_silhouette_blocks_are_sent_once_a_group(spark, vectors, monkeypatch):
    """Not once a block; each pair of rows is met once, however few sums a task holds."""
    x, labels = vectors
    rows = spark.createDataFrame([(i, v.tolist(), [str(c), str(i % 2)]) for i, (v, c) in enumerate(zip(x, labels))],
                                 "_row long, _x array<double>, _labels array<string>")
    dealt, tiles = silhouette._dealt(rows, 180, 2, None, 180)
    groups = int((2 * tiles) ** 0.5)
    assert tiles == groups * (groups + 1) // 2 and groups < 30
    blocks = rows.select(F.pmod(F.xxhash64("_row"), F.lit(90))).distinct().count()
    assert dealt.count() == blocks * groups
    batches = dealt.toArrow().to_batches()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for most in (silhouette.MOST_SUMS, 40):
        monkeypatch.setattr(silhouette, "MOST_SUMS", most)
        got = {}
        for batch in silhouette._sums(iter(batches)):
            for r in batch.to_pylist():
                key = r["row"], r["labelling"], r["label"]
                got[key] = got.get(key, 0.0) + r["total"]
                assert r["own"] == (r["label"] == (str(labels[r["row"]]), str(r["row"] % 2))[r["labelling"]])
        assert len(got) == 180 * (len(set(labels)) + 2)
        for (i, k, name), total in got.items():
            mine = labels.astype(str) == name if k == 0 else (np.arange(180) % 2).astype(str) == name
            assert total == pytest.approx(d[i, mine].sum(), rel=1e-9, abs=1e-6)


def test_silhouette_edges(spark):
    one = spark.createDataFrame([(1.0, "a"), (2.0, "a")], "x double, c string")
    assert clustering.cluster_silhouette(one, ["x"], "c").first()[0] == 0.0
    none = one.limit(0)
    assert clustering.cluster_silhouette(none, ["x"], "c").first()[0] is None
    assert clustering.silhouette_values(none, ["x"], "c").collect() == []


def _groups(spark, n=900):
    rng = np.random.default_rng(8)
    x = rng.normal(scale=0.3, size=(n, 2)) + np.array([[0, 0], [8, 0], [0, 8], [8, 8], [4, 20]])[rng.integers(0, 5, n)]
    return x, spark.createDataFrame([(v.tolist(),) for v in x], "_x array<double>").repartition(4)


def _inertia(x, centres):
    return ((x[:, None] - centres[None]) ** 2).sum(-1).min(axis=1).sum()


@pytest.mark.parametrize("mini_batch", [False, True])
def test_starts_share_their_jobs(spark, monkeypatch, mini_batch):
    x, df = _groups(spark)
    asked = []
    totals = kmeans.cluster_totals
    monkeypatch.setattr(kmeans, "cluster_totals", lambda b, models: asked.append(len(models)) or totals(b, models))
    fits = kmeans.fit_all(df, [2, 5], 4, mini_batch=mini_batch)
    assert [(f.k, f.start) for f in fits] == [(k, s) for k in (2, 5) for s in range(4)]
    assert len(asked) == max(f.steps for f in fits) + 1  # and not their sum
    assert asked[-1] == 8
    for f in fits:
        assert f.inertia == pytest.approx(_inertia(x, f.centres))
    best = kmeans.best_of(fits)
    assert all(best[f.k].inertia <= f.inertia for f in fits)
    truth = [x[np.argmin(((x - c) ** 2).sum(1))] for c in best[5].centres]
    assert best[5].inertia < 1.05 * _inertia(x, np.array([x[np.abs(x - t).sum(1) < 3].mean(0) for t in truth]))


def test_mini_batches_read_a_part(spark):
    x, df = _groups(spark)
    blocks = kmeans.pack(df, batches=kmeans.BATCHES)
    by_batch = {r.batch: r.n for r in blocks.groupBy("batch").agg(F.sum("n").alias("n")).collect()}
    assert sum(by_batch.values()) == len(x) and max(by_batch.values()) < len(x) / 8
    fits = kmeans.fit_all(df, [5], 3, mini_batch=True)
    assert all(f.steps <= kmeans.BATCHES * kmeans.BATCH_PASSES for f in fits)
    full = kmeans.best_of(kmeans.fit_all(df, [5], 3))[5]
    best = kmeans.best_of(fits)[5]
    own = kmeans.nearest(x, best.centres)
    assert len({(a, b) for a, b in zip(own.tolist(), kmeans.nearest(x, full.centres).tolist())}) == 5  # the same partition


def test_lloyd_is_lloyd(spark):
    x, df = _groups(spark, 300)
    fit = kmeans.fit_all(df, [4], 1, max_iter=3)[0]
    blocks = kmeans.pack(df)
    centres = kmeans.spread_start(kmeans.start_sample(blocks, 300, kmeans.START_ROWS, 42), 4, np.random.default_rng([42, 4, 0]))
    for _ in range(fit.steps):
        own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(4)])
    assert np.allclose(np.sort(fit.centres, axis=0), np.sort(centres, axis=0))


def test_few_rows(spark):
    df = spark.createDataFrame([([1.0],), ([1.0],), ([float("nan")],)], "_x array<double>")
    fit = kmeans.best_of(kmeans.fit_all(df, [3], 2))[3]
    assert fit.inertia == 0.0 and len(fit.clusterCenters()) == 3
    assert kmeans.fit_all(df.limit(0), [2], 2) == []
    with pytest.raises(ValueError):
        clustering.kmeans_fit(spark.createDataFrame([], "x double"), ["x"], 2)


def test_sweep_shares_labellings(spark):
    x, df = _groups(spark, 400)
    got = {r.k: r for r in clustering.kmeans_sweep(df.withColumnRenamed("_x", "v"), "v", [2, 5], queries=None).collect()}
    fits = kmeans.best_of(kmeans.fit_all(df, [2, 5], clustering.SWEEP_STARTS))
    for k in (2, 5):
        assert got[k].inertia == pytest.approx(fits[k].inertia)
        assert got[k].silhouette == pytest.approx(_silhouette(x, kmeans.nearest(x, fits[k].centres)).mean(), abs=1e-7)


def _davies_bouldin(x, labels):
    names = sorted(set(labels))
    mu = {c: x[labels == c].mean(0) for c in names}
    s = {c: np.sqrt(((x[labels == c] - mu[c]) ** 2).sum(1)).mean() for c in names}
    return np.mean([max((s[a] + s[b]) / np.sqrt(((mu[a] - mu[b]) ** 2).sum()) for b in names if b != a) for a in names])


@pytest.mark.parametrize("sent,block", [(1 << 26, 1024), (0, 2)])
def test_davies_bouldin_in_blocks(spark, monkeypatch, sent, block):
    monkeypatch.setattr(clustering, "SENT_BYTES", sent)
    monkeypatch.setattr(clustering, "CENTROID_BLOCK", block)
    monkeypatch.setattr(clustering, "CENTROID_RUN", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    labels = rng.integers(0, 11, 200)
    labels[:80] = 4
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, labels)] + [([0.0] * 3, None)], "v array<double>, c int").repartition(3)
    assert clustering.cluster_davies_bouldin(df, "v", "c").first()[0] == pytest.approx(_davies_bouldin(x, labels))
    assert clustering.cluster_davies_bouldin(df.where("c = 4"), "v", "c").first()[0] is None
    assert clustering.cluster_davies_bouldin(df.limit(0), "v", "c").first()[0] is None


def test_more_clusters_than_a_driver_takes(spark):
    n = clustering.MAX_CLUSTERS + 50
    df = spark.range(2 * n).select((F.col("id") % n).alias("c"), (F.col("id") % n + F.col("id") / n).cast("double").alias("x"))
    x = np.arange(2 * n) % n + np.arange(2 * n) / n
    mu = np.add.reduce(x.reshape(2, n)) / 2
    wcss = ((x.reshape(2, n) - mu) ** 2).sum()
    bcss = 2 * ((mu - x.mean()) ** 2).sum()
    got = clustering.cluster_wcss_ratio(df, ["x"], "c").first()
    assert got["wcss"] == pytest.approx(wcss, rel=1e-4) and got["bcss"] == pytest.approx(bcss, rel=1e-9)
    assert clustering.cluster_calinski_harabasz(df, ["x"], "c").first()[0] == pytest.approx((bcss / (n - 1)) / (wcss / n), rel=1e-4)
    assert clustering.cluster_wcss_ratio(df.limit(0), ["x"], "c").first()["variance_ratio"] == 0.0
