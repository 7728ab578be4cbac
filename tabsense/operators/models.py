"""Supervised models on spark.ml, evaluated with ``operators.metrics``.

Preparation follows the reference: rows with a NULL target are dropped, string features are
replaced by their alphabetical index, numeric NULLs take the column mean (then 0); the split
is a seeded hash split (stratified by class for classification) instead of a sampled one.
All rows are used (no training-size cap).
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.schema import is_string, qcol
from tabsense.functions.stats import stats_row
from tabsense.operators import metrics as met
from tabsense.operators import forest, network
from tabsense.operators.features import (adaptive_test_fraction, label_encode, label_mapping, select_k_best,
                                         train_test_split)
from tabsense.session import checkpoint_dir, scratch_path

DEFAULT_SEED = 42
# The reference's model settings.
RF_TREES = 100
RF_DEPTH = 10
MLP_HIDDEN = (50, 50)
MLP_MAX_ITER = 200
MLP_ALPHA = 0.001
VALIDATION_FRACTION = 0.1
# Features tried per split, as the reference's forests do: all for regression, sqrt for classes.
FEATURE_SUBSET = {"regression": "all", "classification": "sqrt"}
# The reference's grid: trees 50/100, depth unlimited/10/20, minimum split 2/5.
TUNE_GRID = {"trees": [50, 100], "max_depth": [None, 10, 20], "min_split": [2, 5]}
TUNE_DRAWS = 5
TUNE_FOLDS = 3
MLP_TOL, MLP_PATIENCE = 1e-4, 10
FIT_THREADS = 4  # concurrent Spark jobs for independent fits (CV folds, compared models)
MIN_ROWS = 10
OUTLIER_CONTAMINATION = 0.05


def prepare(df: DataFrame, features, label: str, task: str, key_cols=None, seed: int = DEFAULT_SEED,
            test_fraction: float | str = 0.2, remove_outliers: bool = False) -> tuple[DataFrame, list[str]]:
    """Returns (frame with ``_label`` double, numeric features, ``split``; feature names).
    Raises when fewer than 10 labelled rows (or, for classification, fewer than 2 classes).

    The needed columns of the labelled rows are materialized once (checkpoint in the shared
    folder); the statistics passes, encodings and the final training frame read from it.
    ``remove_outliers``: drop the rows an Isolation Forest (contamination 0.05) flags on the
    prepared features, before the split.
    """
    feats = list(features)
    keys = list(key_cols) if key_cols else feats + [label]
    needed = list(dict.fromkeys(keys + feats + [label]))
    spark = df.sparkSession
    checkpoint_dir(spark)
    base = df.where(F.col(f"`{label}`").isNotNull()).select(*[F.col(f"`{c}`") for c in needed]) \
        .checkpoint(eager=True)
    strings = [c for c in feats if is_string(base.schema[c].dataType)]
    nums = [c for c in feats if c not in strings]
    check = base.agg(F.count(F.lit(1)).alias("__n"), F.approx_count_distinct(f"`{label}`").alias("__k"),
                     *[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in nums]).first()
    if check["__n"] < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} rows with a target, got {check['__n']}")
    if task == "classification" and check["__k"] < 2:
        raise ValueError("need at least two classes")
    data = label_encode(base, strings) if strings else base
    fill = {c: (check[c] if c in nums and check[c] is not None else 0.0) for c in feats}
    data = data.select(*[F.col(f"`{c}`") for c in data.columns if c not in feats],
                       *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill[c])).alias(c) for c in feats])
    if remove_outliers:
        from tabsense.operators.anomaly import anomaly_isolation_forest
        flagged = anomaly_isolation_forest(data, feats, contamination=OUTLIER_CONTAMINATION, key_cols=keys)
        data = flagged.where(~F.col("is_anomaly")).drop("is_anomaly", "anomaly_score")
    if test_fraction == "adaptive":
        test_fraction = adaptive_test_fraction(check["__n"])
    if task == "classification":
        idx, n_classes = label_mapping(base, label)
        idx = idx.withColumnRenamed("value", "_lv")
        idx = F.broadcast(idx) if n_classes is not None else idx  # size proven by the bounded probe
        data = data.join(idx, F.col(f"`{label}`").cast("string") == F.col("_lv")) \
                   .withColumn("_label", F.col("index").cast("double")).drop("_lv", "index")
        data = train_test_split(data, keys, test_fraction, seed, stratify="_label", n_rows=check["__n"])
    else:
        data = data.withColumn("_label", F.col(f"`{label}`").cast("double"))
        data = train_test_split(data, keys, test_fraction, seed)
    # Training reads this frame many times: materialize it once in the shared checkpoint dir.
    data = data.select(*keys, *[c for c in feats if c not in keys], "_label", "split").checkpoint(eager=True)
    return data, feats


def _assemble(data: DataFrame, feats, scale: bool = False):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    stages = [VectorAssembler(inputCols=feats, outputCol="_raw" if scale else "_features")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True))
    return stages


def _evaluate(pred: DataFrame, task: str, n_classes: int | None = None) -> DataFrame:
    """One wide metrics row: regression metrics plus residual analysis, or classification
    metrics plus ROC-AUC, PR-AUC (binary) and log-loss from the probability vector."""
    if task == "regression":
        reg = met.eval_regression(pred, "_label", "prediction").first()
        res = met.eval_residuals(pred, "_label", "prediction").first()
        values = {**reg.asDict(), **res.asDict()}  # two aggregate rows
    else:
        values = met.eval_classification(pred, "_label", "prediction").first().asDict()
        if n_classes and "probability" in pred.columns:
            from pyspark.ml.functions import vector_to_array
            probs = pred.withColumn("_pv", vector_to_array("probability")).select(
                "_label", *[F.col("_pv")[k].alias(f"_p{k}") for k in range(n_classes)])
            if n_classes == 2:
                values["roc_auc"] = met.eval_roc_auc(probs, "_label", "_p1", positive="1.0").first()["roc_auc"]
                values["pr_auc"] = met.eval_pr_auc(probs, "_label", "_p1", positive="1.0").first()["pr_auc"]
                values["log_loss"] = met.eval_log_loss(probs, "_label", "_p1", positive="1.0").first()["log_loss"]
            else:
                cols = {f"{float(k)}": f"_p{k}" for k in range(n_classes)}
                values["roc_auc"] = met.eval_roc_auc(probs, "_label", cols).first()["roc_auc"]
                values["log_loss"] = met.eval_log_loss(probs, "_label", cols).first()["log_loss"]
    spark = pred.sparkSession
    return spark.createDataFrame([tuple(float(v) if v is not None else None for v in values.values())],
                                 ", ".join(f"{k} double" for k in values))


def fit_forest(prepared: tuple[DataFrame, list[str]], task: str, n_trees: int = RF_TREES, max_depth: int = RF_DEPTH,
               min_instances: int = 1, seed: int = DEFAULT_SEED, select_k: int | None = None):
    """Fit a forest on the train split of a prepared frame; returns (PipelineModel, feature names).

    ``select_k`` keeps that many features, the best by univariate F statistic on the train split.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    data, feats = prepared
    train = data.where("split = 'train'")
    if select_k:
        chosen = select_k_best(train, feats, "_label", k=select_k, classification=task == "classification")
        keep = {r["feature"] for r in chosen.where("selected").collect()}  # one row per feature
        feats = [f for f in feats if f in keep]
    est_cls = RandomForestRegressor if task == "regression" else RandomForestClassifier
    est = est_cls(featuresCol="_features", labelCol="_label", numTrees=n_trees, maxDepth=max_depth,
                  minInstancesPerNode=min_instances, featureSubsetStrategy=FEATURE_SUBSET[task], seed=seed)
    return Pipeline(stages=_assemble(data, feats) + [est]).fit(train), feats


def forest_test_metrics(model, data: DataFrame, task: str) -> DataFrame:
    """One wide metrics row of a fitted forest on the test split."""
    n_classes = None if task == "regression" else int(model.stages[-1].numClasses)
    return _evaluate(model.transform(data.where("split = 'test'")), task, n_classes)


def random_forest(df: DataFrame, features, label: str, task: str = "regression", n_trees: int = RF_TREES,
                  max_depth: int = RF_DEPTH, min_instances: int = 1, seed: int = DEFAULT_SEED, key_cols=None,
                  remove_outliers: bool = False, select_k: int | None = None, test_fraction: float | str = 0.2,
                  prepared: tuple[DataFrame, list[str]] | None = None):
    """Fit on the train split, evaluate on the test split.
    Returns (metrics (model, metric, value), fitted PipelineModel, feature names)."""
    prepared = prepared or prepare(df, features, label, task, key_cols, seed, test_fraction, remove_outliers)
    model, feats = fit_forest(prepared, task, n_trees, max_depth, min_instances, seed, select_k)
    return met.metrics_long(forest_test_metrics(model, prepared[0], task), "RandomForest"), model, feats


def feature_importance(model, feats, top: int | None = None):
    """(feature, importance) of a fitted forest, descending (the first ``top`` if given)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(feats, [float(x) for x in imp]), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def deep_forest(prepared: tuple[DataFrame, list[str]], task: str, n_trees: int = RF_TREES, max_depth: int | None = None,
                min_split: int = 2, seed: int = DEFAULT_SEED, key_cols=None, rows: Column | None = None) -> forest.Forest:
    """A forest of any depth with a minimum split in rows (see ``forest``), grown on the train split of a
    prepared frame (on ``rows`` of it, if given)."""
    data, feats = prepared
    train = data.where("split = 'train'")
    n_classes = 0 if task == "regression" else max(int(data.agg(F.max("_label")).first()[0]) + 1, 2)
    tried = len(feats) if FEATURE_SUBSET[task] == "all" else max(int(math.sqrt(len(feats))), 1)
    return forest.grow_forest(train if rows is None else train.where(rows), feats, "_label", n_classes, n_trees, max_depth,
                              min_split, tried=tried, key_cols=key_cols, seed=seed)


def deep_forest_metrics(grown: forest.Forest, data: DataFrame, task: str, views: list[forest.View] | None = None):
    """One wide metrics row of a grown forest on the given rows; given ``views`` of it, a list of one for each.

    The rows are scored once and written: every metric reads the predictions.
    """
    from pyspark.ml.functions import array_to_vector
    spark, n_classes = data.sparkSession, grown.plan.classes or None
    found = grown.predict(data, views)
    ends = [f"_{k}" for k in range(len(views))] if views else [""]
    found = found.select("_label", *[f"{c}{e}" for e in ends for c in (["prediction", "probability"] if n_classes else ["prediction"])])
    path = scratch_path(spark, "forest-predictions")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)

    def metrics(end: str) -> DataFrame:
        pred = found.select("_label", F.col(f"prediction{end}").alias("prediction"),
                            *([array_to_vector(f"probability{end}").alias("probability")] if n_classes else []))
        return _evaluate(pred, task, n_classes)

    return [metrics(e) for e in ends] if views else metrics("")


def random_forest_deep(df: DataFrame, features, label: str, task: str = "regression", n_trees: int = RF_TREES,
                       max_depth: int | None = None, min_split: int = 2, seed: int = DEFAULT_SEED, key_cols=None,
                       remove_outliers: bool = False, test_fraction: float | str = 0.2):
    """As ``random_forest``, but without a depth limit (unless one is given) and with a minimum split in rows.
    Returns (metrics (model, metric, value), grown forest)."""
    prepared = prepare(df, features, label, task, key_cols, seed, test_fraction, remove_outliers)
    grown = deep_forest(prepared, task, n_trees, max_depth, min_split, seed, key_cols)
    return met.metrics_long(deep_forest_metrics(grown, prepared[0].where("split = 'test'"), task), "RandomForest"), grown


def rf_tuned(df: DataFrame, features, label: str, task: str = "regression", draws: int = TUNE_DRAWS,
             folds: int = TUNE_FOLDS, seed: int = DEFAULT_SEED, key_cols=None) -> DataFrame:
    """Seeded random search over the grid with k-fold cross-validation on the train split; the draw
    with the best mean score is fitted again on the whole train split and tested.

    Returns per draw: parameters (``max_depth`` NULL: no limit), mean / std / min of the fold score (r2 or
    weighted f1), ``is_best``, and for the best draw its score on the test split (else NULL)."""
    prepared = data, feats = prepare(df, features, label, task, key_cols, seed)
    keys = list(key_cols) if key_cols else feats + [label]
    fold = F.pmod(F.xxhash64(*[qcol(k) for k in keys], F.lit(seed + 1)), F.lit(folds))
    grid = [(t, d, m) for t in TUNE_GRID["trees"] for d in TUNE_GRID["max_depth"] for m in TUNE_GRID["min_split"]]
    picks = random.Random(seed).sample(grid, min(draws, len(grid)))
    score_name = "r2" if task == "regression" else "f1"

    # A fold's draws are parts of one forest under the widest of their limits: it is grown and scored once for all.
    views = [forest.View(*p) for p in picks]
    depth = None if any(v.max_depth is None for v in views) else max(v.max_depth for v in views)

    def fold_scores(k: int) -> list[float]:
        grown = deep_forest(prepared, task, max(v.trees for v in views), depth, min(v.min_split for v in views), seed, keys, fold != k)
        held_out = data.where((F.col("split") == "train") & (fold == k))
        return [float(r.first()[score_name]) for r in deep_forest_metrics(grown, held_out, task, views)]

    with ThreadPoolExecutor(max_workers=FIT_THREADS) as pool:
        by_fold = list(pool.map(fold_scores, range(folds)))
    scores = [by_fold[k][i] for i in range(len(picks)) for k in range(folds)]
    rows = []
    for i, (t, d, m) in enumerate(picks):
        sc = scores[i * folds:(i + 1) * folds]
        rows.append((t, d, m, float(np.mean(sc)), float(np.std(sc)), float(np.min(sc))))
    best = max(range(len(rows)), key=lambda i: rows[i][3])
    t, d, m = picks[best]
    score = deep_forest_metrics(deep_forest(prepared, task, t, d, m, seed, keys), data.where("split = 'test'"), task).first()[score_name]
    rows = [(*r, i == best, score if i == best else None) for i, r in enumerate(rows)]
    return df.sparkSession.createDataFrame(rows, "num_trees int, max_depth int, min_split int, cv_mean double, "
                                                 "cv_std double, cv_min double, is_best boolean, test_score double")


def _learning_rows(data: DataFrame, feats: list[str], keys: list[str], y, seed: int, stats: dict) -> DataFrame:
    """Rows of the training split: the vector x, the target y, and whether a row is fitted or validates (10 %, by hash)."""
    unseen = F.pmod(F.xxhash64(*[qcol(k) for k in keys], F.lit(seed + 7)), F.lit(1000)) < VALIDATION_FRACTION * 1000
    return data.where("split = 'train'").select(network.standardized(data, feats, stats).alias("x"), y.alias("y"), (~unseen).alias("fit"))


def _feature_stats(data: DataFrame, feats: list[str], **more) -> dict:
    return stats_row(data.where("split = 'train'"),
                     {**{k: e for c in feats for k, e in ((f"m|{c}", F.avg(qcol(c))), (f"s|{c}", F.stddev_pop(qcol(c))))}, **more})


def mlp_classification(df: DataFrame, features, label: str, hidden=MLP_HIDDEN, max_iter: int = MLP_MAX_ITER,
                       alpha: float = MLP_ALPHA, learning_rate: float = 0.01, patience: int = MLP_PATIENCE,
                       seed: int = DEFAULT_SEED, key_cols=None, prepared: tuple[DataFrame, list[str]] | None = None):
    """ReLU network with a softmax, Adam, L2 and early stop on standardized features (see ``network``).
    Returns (metrics, ``network.Network``)."""
    from pyspark.ml.functions import array_to_vector
    data, feats = prepared or prepare(df, features, label, "classification", key_cols, seed)
    keys = list(key_cols) if key_cols else [c for c in data.columns if c not in ("_label", "split")]
    n_classes = max(int(data.agg(F.max("_label")).first()[0]) + 1, 2)
    stats = _feature_stats(data, feats)
    net = network.train(_learning_rows(data, feats, keys, F.col("_label"), seed, stats), tuple(hidden), n_classes, max_iter, alpha,
                        learning_rate, patience, MLP_TOL, seed)
    test = data.where("split = 'test'").select(network.standardized(data, feats, stats).alias("x"), "_label")
    pred = network.predict(test, net, ["_label"]).withColumn("probability", array_to_vector("_probability")).drop("_probability")
    return met.metrics_long(_evaluate(pred, "classification", n_classes), "MLP"), net


def mlp_regression(df: DataFrame, features, label: str, hidden=MLP_HIDDEN, max_iter: int = MLP_MAX_ITER,
                   alpha: float = MLP_ALPHA, learning_rate: float = 0.01, patience: int = MLP_PATIENCE,
                   seed: int = DEFAULT_SEED, key_cols=None, prepared: tuple[DataFrame, list[str]] | None = None):
    """The same network with one linear output, on a standardized target.  Returns (metrics, predictions on
    the test split, weights)."""
    data, feats = prepared or prepare(df, features, label, "regression", key_cols, seed)
    keys = list(key_cols) if key_cols else feats + [label]
    stats = _feature_stats(data, feats, ym=F.avg("_label"), ys=F.stddev_pop("_label"))
    ym, ys = stats["ym"] or 0.0, stats["ys"] or 1.0
    y = (F.col("_label") - F.lit(ym)) / F.lit(ys)
    net = network.train(_learning_rows(data, feats, keys, y, seed, stats), tuple(hidden), 0, max_iter, alpha, learning_rate, patience, MLP_TOL, seed)
    test = data.where("split = 'test'").select(network.standardized(data, feats, stats).alias("x"), "_label")
    pred = network.predict(test, net, ["_label"], ys, ym)
    metrics = met.metrics_long(_evaluate(pred, "regression"), "MLP")
    return metrics, pred, {"params": net.params, "iterations": net.epochs, "converged": net.converged}


def model_comparison(df: DataFrame, features, label: str, task: str = "regression", seed: int = DEFAULT_SEED,
                     key_cols=None, n_trees: int = RF_TREES, max_iter: int = MLP_MAX_ITER) -> DataFrame:
    """Random forest vs MLP on the same split; (model, metric, value, is_best) with the best
    model by r2 (regression) or weighted f1 (classification)."""
    prepared = prepare(df, features, label, task, key_cols, seed)

    def run_rf():
        return random_forest(df, features, label, task, n_trees=n_trees, seed=seed, prepared=prepared)[0]

    def run_mlp():
        if task == "regression":
            return mlp_regression(df, features, label, max_iter=max_iter, seed=seed, key_cols=key_cols, prepared=prepared)[0]
        return mlp_classification(df, features, label, max_iter=max_iter, seed=seed, key_cols=key_cols, prepared=prepared)[0]

    key = "r2" if task == "regression" else "f1"
    with ThreadPoolExecutor(max_workers=2) as pool:
        rf_f, mlp_f = pool.submit(run_rf), pool.submit(run_mlp)
        rf, mlp = rf_f.result(), mlp_f.result()
    both = rf.unionByName(mlp)
    scores = {r["model"]: r["value"] for r in both.where(F.col("metric") == key).collect()}
    best = max(scores, key=lambda m: scores[m] if scores[m] is not None else float("-inf"))
    return both.withColumn("is_best", F.col("model") == F.lit(best))
