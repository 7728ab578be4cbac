"""Forests grown to the end: brute force, minimum split, block sizes, planted labels."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.operators import forest


def brute_force(x, y, min_split, max_depth=None, classes=0, depth=0, leaves=None, rows=None):
    """A CART tree, node by node: all features, every midpoint, first best split.  Returns the leaf values by row."""
    rows = np.arange(len(y)) if rows is None else rows
    out = np.zeros(len(y)) if depth == 0 else leaves
    own = y[rows]

    def purity(v):
        return sum((v == k).sum() ** 2 for k in range(classes)) / len(v) if classes else v.sum() ** 2 / len(v)

    best = None
    if len(rows) >= min_split and own.min() < own.max() and depth != max_depth:
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for a in values[:-1]:
                go = x[rows, f] <= a
                score = purity(own[go]) + purity(own[~go])
                if best is None or score > best[0]:
                    best = (score, go)
    if best is None:
        out[rows] = np.bincount(own.astype(int)).argmax() if classes else own.mean()
    else:
        for part in (rows[best[1]], rows[~best[1]]):
            brute_force(x, y, min_split, max_depth, classes, depth + 1, out, part)
    return out


def frame(spark, x, y, parts=3):
    d = pd.DataFrame({f"f{i}": x[:, i] for i in range(x.shape[1])} | {"y": y.astype(float), "id": range(len(y))})
    return spark.createDataFrame(d).repartition(parts), [f"f{i}" for i in range(x.shape[1])]


def predicted(f, df):
    return np.array([r["prediction"] for r in f.predict(df).orderBy("id").collect()])


@pytest.mark.parametrize("classes,min_split,block", [(0, 2, 10_000), (0, 7, 60), (3, 2, 60), (3, 11, 10_000)])
def test_one_tree_is_the_brute_force_tree(spark, classes, min_split, block):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, (300, 3)).astype(float)
    y = rng.integers(0, classes or 50, 300)
    df, names = frame(spark, x, y)
    f = forest.grow_forest(df, names, "y", classes, trees=1, min_split=min_split, bootstrap=False, key_cols=["id"], block_rows=block)
    assert np.allclose(predicted(f, df), brute_force(x, y, min_split, classes=classes))
    inner = f.subtrees(spark).select(F.explode(F.arrays_zip("feature", "rows")).alias("e")).where("e.feature >= 0").select("e.rows").collect()
    assert min(r["rows"] for r in inner) >= min_split


def test_depth_limit_of_a_tree(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 30, (200, 2)).astype(float), rng.integers(0, 9, 200)
    df, names = frame(spark, x, y)
    for block in (20, 1000):
        f = forest.grow_forest(df, names, "y", trees=1, max_depth=3, bootstrap=False, key_cols=["id"], block_rows=block)
        assert np.allclose(predicted(f, df), brute_force(x, y, 2, 3))


def test_blocks_and_partitions_change_nothing(spark):
    """Drawn rows and features included: nodes above the blocks are split as those within."""
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 25, (400, 4)).astype(float), rng.integers(0, 4, 400)
    df, names = frame(spark, x, y)
    runs = [(df, 10_000), (df.repartition(7), 50), (df.coalesce(1), 120)]
    out = [predicted(forest.grow_forest(d, names, "y", 4, trees=6, tried=2, key_cols=["id"], block_rows=b), df) for d, b in runs]
    assert (out[0] == out[1]).all() and (out[0] == out[2]).all()


def test_cuts_of_a_node_of_its_own(spark):
    """A third of the rows lies between two global cuts and is far over a block: it is split all the same."""
    x = np.concatenate([np.arange(400) * 1000.0, 5 + np.arange(200) / 1000.0])[:, None]
    y = np.concatenate([np.zeros(400), np.arange(200) % 2])
    df, names = frame(spark, x, y)
    f = forest.grow_forest(df, names, "y", 2, trees=1, bootstrap=False, key_cols=["id"], block_rows=20, bins=4)
    assert (predicted(f, df) == y).all()


def test_missing_features_ties_and_small_tables(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1), (2.0, 0.0, 2), (None, 1.0, 3), (float("nan"), 1.0, 4), (5.0, None, 5)], "`f 0` double, y double, id int")
    f = forest.grow_forest(df, ["f 0"], "y", 2, trees=1, bootstrap=False, key_cols=["id"])
    assert predicted(f, df).tolist() == [0.0, 0.0, 1.0, 1.0, 0.0]
    same = spark.createDataFrame([(1.0, float(i), i) for i in range(30)], "x double, y double, id int")
    for block in (5, 100):
        f = forest.grow_forest(same, ["x"], "y", trees=1, bootstrap=False, key_cols=["id"], block_rows=block)
        assert predicted(f, same).tolist() == [14.5] * 30
    pure = same.withColumn("y", F.lit(3.0)).withColumn("x", F.col("id").cast("double"))
    for block in (5, 100):
        assert predicted(forest.grow_forest(pure, ["x"], "y", trees=3, key_cols=["id"], block_rows=block), pure).tolist() == [3.0] * 30
    with pytest.raises(ValueError):
        forest.grow_forest(same.where("false"), ["x"], "y")
    with pytest.raises(ValueError):
        forest.grow_forest(same, ["x"], "y", min_split=1)


def test_rows_crowding_a_leaf_are_scored_in_parts(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(120, 2)), rng.integers(0, 2, 120)
    df, names = frame(spark, x, y)
    f = forest.grow_forest(df, names, "y", 2, trees=4, key_cols=["id"], block_rows=30)
    f.block = 10
    crowd = df.where("id < 40").crossJoin(spark.range(5).select(F.col("id").alias("copy")))
    out = f.predict(crowd)
    assert out.count() == 200 and out.select("id", "prediction").distinct().count() == 40


def test_importances_and_draws(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    df, names = frame(spark, x, (x[:, 1] > 0).astype(int))
    for block in (50, 10_000):
        imp = forest.grow_forest(df, names, "y", 2, trees=8, key_cols=["id"], block_rows=block).importances(spark)
        assert abs(sum(imp) - 1) < 1e-9 and imp[1] > 0.99
    w = np.concatenate([forest.row_weights(np.arange(20_000), t, 1) for t in range(3)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01


@pytest.mark.parametrize("classes,tried", [(0, 3), (3, 2)])
def test_rows_are_read_once_for_all_levels(spark, monkeypatch, classes, tried):
    """From the cells of crossed cuts come the levels that a job each would give; nodes between cuts included."""
    rng = np.random.default_rng(11)
    x, y = rng.integers(0, 30, (500, 3)).astype(float), rng.integers(0, classes or 40, 500)
    x[rng.random((500, 3)) < 0.1] = np.nan
    df, names = frame(spark, x, y)
    made, jobs = [], []
    levels = forest._histograms
    monkeypatch.setattr(forest, "_histograms", lambda *a: jobs.append(1) or levels(*a))
    for most in (forest.MOST_CELLS, 0):
        monkeypatch.setattr(forest, "MOST_CELLS", most)
        monkeypatch.setattr(forest, "HELD_CELLS", 50)
        f = forest.grow_forest(df.repartition(3), names, "y", classes, trees=3, tried=tried, key_cols=["id"], block_rows=15, bins=8)
        assert bool(jobs) == (not most)
        made.append(predicted(f, df))
    assert (made[0] == made[1]).all()


@pytest.mark.parametrize("classes,most,block", [(0, 1 << 18, 60), (3, 0, 150)])
def test_views_are_the_forests_under_their_limits(spark, monkeypatch, classes, most, block):
    """Cut off above the blocks and within them, one pass for all."""
    monkeypatch.setattr(forest, "MOST_CELLS", most)
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 30, (400, 3)).astype(float), rng.integers(0, classes or 40, 400)
    df, names = frame(spark, x, y)
    def grown(trees, depth, split):
        return forest.grow_forest(df, names, "y", classes, trees, depth, split, tried=2, key_cols=["id"], block_rows=block, bins=64)
    views = [forest.View(3), forest.View(2, 1, 2), forest.View(3, 6, 5), forest.View(2, None, 90)]
    column = "probability" if classes else "prediction"
    got = grown(3, None, 2).predict(df, views).orderBy("id").collect()
    for k, v in enumerate(views):
        want = grown(v.trees, v.max_depth, v.min_split).predict(df).orderBy("id").collect()
        assert np.allclose([r[f"{column}_{k}"] for r in got], [r[column] for r in want], atol=1e-12)


def test_a_fold_is_grown_once_for_all_draws(spark, monkeypatch):
    """Under the widest limits of the draws, and the best draw on the whole train split."""
    from tabsense.operators import models

    class Score(dict):
        def first(self):
            return self

    data = spark.createDataFrame([(1, "train")], "id int, split string")
    grown, asked = [], []
    monkeypatch.setattr(models, "prepare", lambda *a: (data, ["id"]))
    monkeypatch.setattr(models, "deep_forest", lambda prepared, task, t, d, m, *a: grown.append((t, d, m)))

    def metrics(forest_, rows, task, views=None):
        asked.append(views)
        return [Score(f1=v.trees + (v.max_depth or 0) / 100) for v in views] if views else Score(f1=0.5)

    monkeypatch.setattr(models, "deep_forest_metrics", metrics)
    out = models.rf_tuned(data, ["id"], "y", "classification", key_cols=["id"]).collect()
    draws = [(r.num_trees, r.max_depth, r.min_split) for r in out]
    widest = (max(t for t, _, _ in draws), None if any(d is None for _, d, _ in draws) else max(d for _, d, _ in draws), min(m for _, _, m in draws))
    best = next(r for r in out if r.is_best)
    assert grown == [widest] * 3 + [(best.num_trees, best.max_depth, best.min_split)] and best.test_score == 0.5
    assert all([(v.trees, v.max_depth, v.min_split) for v in views] == draws for views in asked[:3])
    assert [r.cv_mean for r in out] == pytest.approx([t + (d or 0) / 100 for t, d, _ in draws])


def test_few_bytes_are_work_for_all_cores(spark):
    rows = spark.range(100).coalesce(1)
    assert forest._spread(rows, "t").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert forest._spread(rows, "t").count() == 100
