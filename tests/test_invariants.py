"""Invariants for operators checked by row counts only (models, sampling, splits)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tabsense.operators import anomaly, clustering, features
from tabsense.plans.catalog import table
from tests.conftest import SF_SMALL


def test_isolation_forest_share(spark):
    li = table(spark, SF_SMALL, "lineitem")
    out = anomaly.anomaly_isolation_forest(li, ["l_quantity", "l_extendedprice", "l_discount"],
                                           contamination=0.1, key_cols=["l_orderkey", "l_linenumber"])
    n = out.count()
    flagged = out.where("is_anomaly").count()
    assert n == li.count()
    assert abs(flagged / n - 0.1) < 0.01
    assert out.where((F.col("anomaly_score") <= 0) | (F.col("anomaly_score") >= 1)).count() == 0


def test_isolation_forest_finds_planted_outliers(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(500)] + [(1000 + i, 500.0 + i, -400.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = anomaly.anomaly_isolation_forest(df, ["a", "b"], contamination=0.01, key_cols=["id"])
    top = {r["id"] for r in out.orderBy(F.desc("anomaly_score")).limit(5).collect()}
    assert top == {1000, 1001, 1002, 1003, 1004}


def test_split_sizes(spark):
    li = table(spark, SF_SMALL, "lineitem")
    out = features.train_test_split(li, ["l_orderkey", "l_linenumber"], 0.2, 42, stratify="l_returnflag")
    by = {(r["l_returnflag"], r["split"]): r["count"] for r in out.groupBy("l_returnflag", "split").count().collect()}
    for flag in {k[0] for k in by}:
        share = by.get((flag, "test"), 0) / (by.get((flag, "test"), 0) + by.get((flag, "train"), 0))
        assert abs(share - 0.2) < 0.01
    plain = features.train_test_split(li, ["l_orderkey", "l_linenumber"], 0.2, 42)
    share = plain.where("split = 'test'").count() / li.count()
    assert 0.15 < share < 0.25


def test_kmeans_elbow_inertia_non_increasing(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    rows = clustering.kmeans_elbow(emb, "embedding", range(2, 6)).orderBy("k").collect()
    inertia = [r["inertia"] for r in rows]
    assert all(b <= a * 1.05 for a, b in zip(inertia, inertia[1:]))
    assert sum(r["is_elbow"] for r in rows) == 1


def test_kmeans_fit_cluster_count(spark):
    cust = table(spark, SF_SMALL, "customer")
    out, _ = clustering.kmeans_fit(cust, ["c_acctbal", "c_nationkey"], k=3, scale=True, remove_outliers=True)
    assert out.count() == cust.count()
    labels = {r["cluster"] for r in out.select("cluster").distinct().collect()}
    assert labels - {-1} == {0, 1, 2}


def test_silhouette_bounds(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    s = clustering.cluster_silhouette(emb, "embedding", "label").first()["silhouette"]
    assert -1.0 <= s <= 1.0


@pytest.mark.parametrize("name", ["sample_rows", "chart_scatter", "chart_map", "select_k_best"])
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_random_forest_metrics_bounds(spark):
    out = {r["metric"]: r["value"] for r in E.queries()["rf_classification"](spark, SF_SMALL).collect()}
    for m in ("accuracy", "precision", "recall", "f1", "balanced_accuracy"):
        assert 0.0 <= out[m] <= 1.0


def test_isolation_forest_large_input_path(spark):
    # n >= 2 x trees x 256 takes the one-hash-per-row subsample path
    base = spark.range(30000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("a"),
                                     (F.col("id") % 89).cast("double").alias("b"))
    planted = spark.createDataFrame([(100000 + i, 5000.0 + i, -3000.0) for i in range(5)], "id long, a double, b double")
    out = anomaly.anomaly_isolation_forest(base.unionByName(planted), ["a", "b"], contamination=0.05, key_cols=["id"])
    # points outside every subsample's range take the extreme path: they must all be flagged
    flagged = {r["id"] for r in out.where("is_anomaly").select("id").collect()}
    assert {100000 + i for i in range(5)} <= flagged
    share = len(flagged) / 30005
    assert abs(share - 0.05) < 0.005


def test_models_learn_a_real_relation(spark):
    from tabsense.operators import models
    df = spark.range(3000).select(
        F.col("id"), (F.col("id") % 100 / 10.0).alias("x1"), ((F.col("id") * 7) % 13).cast("double").alias("x2"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"))
    df = df.withColumn("y", 3 * F.col("x1") - 2 * F.col("x2") + F.when(F.col("g") == "a", 5.0).otherwise(0.0))
    mlp, _, info = models.mlp_regression(df, ["x1", "x2", "g"], "y", key_cols=["id"])
    r2 = {r["metric"]: r["value"] for r in mlp.collect()}["r2"]
    assert r2 > 0.95, r2
    rf, _, _ = models.random_forest(df, ["x1", "x2", "g"], "y", "regression", n_trees=20, key_cols=["id"])
    assert {r["metric"]: r["value"] for r in rf.collect()}["r2"] > 0.9
    df2 = df.withColumn("cls", F.when(F.col("y") > 5, "hi").otherwise("lo"))
    mc, _ = models.mlp_classification(df2, ["x1", "x2", "g"], "cls", key_cols=["id"], max_iter=100)
    assert {r["metric"]: r["value"] for r in mc.collect()}["accuracy"] > 0.9


def test_outlier_removal_options(spark):
    from tabsense.operators import models
    cust = table(spark, SF_SMALL, "customer")
    out, _ = clustering.kmeans_fit(cust, ["c_acctbal", "c_nationkey"], k=3, remove_outliers="isolation_forest",
                                   key_cols=["c_custkey"])
    assert out.count() == cust.count()
    excluded = out.where("cluster = -1").count()
    assert abs(excluded - 0.1 * cust.count()) <= 2
    part = table(spark, SF_SMALL, "part")
    metrics, _, _ = models.random_forest(part, ["p_size", "p_brand"], "p_retailprice", n_trees=10,
                                         key_cols=["p_partkey"], remove_outliers=True)
    assert {r["metric"] for r in metrics.collect()} >= {"r2", "mae"}


def test_forest_selects_k_best_on_request(spark):
    from tabsense.operators import models
    cols = [(F.col("id") * (i + 1) % 17).cast("double").alias(f"f{i}") for i in range(55)]
    df = spark.range(400).select("id", *cols).withColumn("y", F.col("f0") * 2 + F.col("f1"))
    _, model, feats = models.random_forest(df, [f"f{i}" for i in range(55)], "y", n_trees=5, key_cols=["id"], select_k=20)
    assert len(feats) == 20 and "f0" in feats


def test_cluster_metrics_numpy_path_matches_literal_path(spark, monkeypatch):
    emb = table(spark, SF_SMALL, "embeddings")
    lit_s = clustering.cluster_silhouette_squared(emb, "embedding", "label").first()["silhouette"]
    lit_db = clustering.cluster_davies_bouldin(emb, "embedding", "label").first()["davies_bouldin"]
    monkeypatch.setattr(clustering, "LITERAL_MAX", 1)
    np_s = clustering.cluster_silhouette_squared(emb, "embedding", "label").first()["silhouette"]
    np_db = clustering.cluster_davies_bouldin(emb, "embedding", "label").first()["davies_bouldin"]
    assert np_s == pytest.approx(lit_s, abs=1e-9)
    assert np_db == pytest.approx(lit_db, abs=1e-9)
