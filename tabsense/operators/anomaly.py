"""Outlier / anomaly detection over null-free rows, all features jointly.

Statistics (means, std, medians, MAD, quartiles) are one bounded row per feature; scoring is
a single projection with those values as literals (whole-stage codegen, no join).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.quantiles import quantile_table
from tabsense.functions.schema import numeric_columns, require_columns
from tabsense.functions.stats import count_if, greatest_of, stats_row
from tabsense.session import checkpoint_dir

# Default thresholds of the reference's methods.
Z_THRESHOLD = 3.0
MODIFIED_Z_THRESHOLD = 3.5
MODIFIED_Z_CONSTANT = 0.6745
IQR_MULTIPLIER = 1.5
CONTAMINATION = 0.1
N_TREES = 50
SUBSAMPLE = 256

INF = float("inf")


def _prepare(df: DataFrame, features) -> tuple[DataFrame, list[str]]:
    feats = list(features) if features else numeric_columns(df)
    if not feats:
        raise ValueError("no numeric features")
    require_columns(df, feats)
    return df.na.drop(how="any", subset=feats), feats


def _x(c) -> Column:
    return F.col(f"`{c}`").cast("double")


def anomaly_zscore(df: DataFrame, features=None, threshold: float = Z_THRESHOLD) -> DataFrame:
    """|z| with population std; score = max |z|; anomaly when any |z| > threshold."""
    data, feats = _prepare(df, features)
    row = stats_row(data, {**{f"m|{c}": F.avg(_x(c)) for c in feats},
                           **{f"s|{c}": F.stddev_pop(_x(c)) for c in feats}})
    zs = []
    for c in feats:
        m, s = row[f"m|{c}"], row[f"s|{c}"]
        zs.append(F.abs((_x(c) - F.lit(m)) / F.lit(s)) if s else F.lit(None).cast("double"))
    score = greatest_of(zs)
    flag = F.coalesce(F.greatest(*[z > threshold for z in zs]) if len(zs) > 1 else zs[0] > threshold, F.lit(False))
    return data.withColumn("anomaly_score", score).withColumn("is_anomaly", flag)


def anomaly_modified_zscore(df: DataFrame, features=None, threshold: float = MODIFIED_Z_THRESHOLD,
                            accuracy: int | None = None) -> DataFrame:
    """|0.6745 (x - median) / MAD|; MAD = 0: x == median -> NULL score, otherwise +inf."""
    data, feats = _prepare(df, features)
    med = quantile_table(data, feats, [0.5], accuracy=accuracy)
    dev = data.select(*[F.abs(_x(c) - F.lit(med[c][0])).alias(c) for c in feats])
    mad = quantile_table(dev, feats, [0.5], accuracy=accuracy)
    zs = []
    for c in feats:
        m, d = med[c][0], mad[c][0]
        if d:
            zs.append(F.abs(F.lit(MODIFIED_Z_CONSTANT) * (_x(c) - F.lit(m)) / F.lit(d)))
        else:
            zs.append(F.when(_x(c) == F.lit(m), F.lit(None).cast("double")).otherwise(F.lit(INF)))
    score = greatest_of(zs)
    flag = F.coalesce(F.greatest(*[z > threshold for z in zs]) if len(zs) > 1 else zs[0] > threshold, F.lit(False))
    return data.withColumn("anomaly_score", score).withColumn("is_anomaly", flag)


def anomaly_iqr(df: DataFrame, features=None, multiplier: float = IQR_MULTIPLIER,
                accuracy: int | None = None) -> DataFrame:
    """Outside [Q1 - m IQR, Q3 + m IQR] in any feature; score = max over features of
    max(lo - x, x - hi) (negative for inliers)."""
    data, feats = _prepare(df, features)
    qt = quantile_table(data, feats, [0.25, 0.75], accuracy=accuracy)
    below, above, out = [], [], []
    for c in feats:
        q1, q3 = qt[c]
        if q1 is None:  # no value: nothing can lie outside
            continue
        lo, hi = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
        below.append(F.lit(lo) - _x(c))
        above.append(_x(c) - F.lit(hi))
        out.append((_x(c) < F.lit(lo)) | (_x(c) > F.lit(hi)))
    score = greatest_of(below + above) if out else F.lit(None).cast("double")
    flag = reduce(lambda a, b: a | b, [F.coalesce(o, F.lit(False)) for o in out], F.lit(False))
    return data.withColumn("anomaly_score", score).withColumn("is_anomaly", flag)


def anomaly_summary(flagged: DataFrame, method: str, features) -> DataFrame:
    """method, anomaly count, rate %, rows analysed, features used (one aggregate)."""
    feats = ", ".join(features)
    return flagged.agg(count_if(F.col("is_anomaly")).alias("anomaly_count"),
                       F.count(F.lit(1)).alias("rows")).select(
        F.lit(method).alias("method"), "anomaly_count",
        F.when(F.col("rows") > 0, F.col("anomaly_count") * 100.0 / F.col("rows")).alias("anomaly_rate_pct"),
        "rows", F.lit(feats).alias("features"))


def remove_outliers_iqr(df: DataFrame, features, multiplier: float = IQR_MULTIPLIER,
                        accuracy: int | None = None) -> DataFrame:
    """Sequential per-feature IQR row removal; quartiles are recomputed after each feature.

    Each step's bounds are literals, so the final plan is one scan with a chain of range
    filters (pushed to parquet); the k-th quartile pass scans with the first k-1 filters.
    """
    data, feats = _prepare(df, features)
    for c in feats:
        q1, q3 = quantile_table(data, [c], [0.25, 0.75], accuracy=accuracy)[c]
        if q1 is None:
            break
        lo, hi = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
        data = data.where((_x(c) >= F.lit(lo)) & (_x(c) <= F.lit(hi)))
    return data


# ----------------------------------------------------------------------------- isolation forest

def _c(n):
    """Average path length of an unsuccessful BST search over n points (Liu et al. 2008)."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow_tree(x: np.ndarray, rng, max_depth: int):
    """Random isolation tree as parallel arrays (feature, threshold, left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        k = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return k
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:
            return k
        f = int(rng.choice(candidates))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[k], thr[k] = f, t
        go_left = sub[:, f] < t
        left[k] = node(idx[go_left], depth + 1)
        right[k] = node(idx[~go_left], depth + 1)
        return k

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, size


def tree_threshold(n_rows: int, subsample: int) -> int | None:
    """The signed 64-bit hash below which a row joins a tree's subsample; None: every row does."""
    share = 2 * subsample / n_rows
    return None if share >= 1 else (2 * subsample << 64) // n_rows - (1 << 63)


def anomaly_isolation_forest(df: DataFrame, features=None, contamination: float = CONTAMINATION,
                             n_trees: int = N_TREES, subsample: int = SUBSAMPLE, key_cols=None,
                             seed: int = 42) -> DataFrame:
    """Isolation Forest (Liu, Ting, Zhou 2008) as Spark jobs.

    1. Each tree's subsample: a seeded 64-bit hash of (row key, tree) below a threshold picks
       about 2 x ``subsample`` rows, whatever the number of rows; each tree keeps the
       ``subsample`` smallest hashes.  A tree without rows is an error.
    2. ``groupBy(tree).applyInPandas`` grows one tree per group (bounded by ``subsample``).
    3. The forest (n_trees x < 2 x subsample nodes, independent of the data size) is broadcast
       and every row is scored in ``mapInPandas``: s = 2^(-E[h(x)] / c(subsample)).
    4. ``is_anomaly`` = s above the exact (1 - contamination) quantile of s.
    """
    import pandas as pd
    data, feats = _prepare(df, features)
    keys = list(key_cols) if key_cols else list(data.columns)
    spark = data.sparkSession
    n = data.count()
    if n == 0:
        return data.withColumn("anomaly_score", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(False))
    psi = int(min(subsample, n))
    key_exprs = [F.col(f"`{k}`") for k in keys]
    feat_cols = [_x(c).alias(f"f{i}") for i, c in enumerate(feats)]
    row_hash = F.xxhash64(*key_exprs, F.lit(seed))
    every = F.sequence(F.lit(0), F.lit(n_trees - 1))
    limit = tree_threshold(n, psi)
    trees = every if limit is None else F.filter(every, lambda t: F.xxhash64(F.col("_row"), t) < F.lit(limit))
    picked = data.select(row_hash.alias("_row"), *feat_cols).withColumn("_tree", F.explode(trees)) \
        .withColumn("_h", F.xxhash64("_row", "_tree"))
    picked = picked.select("_tree", "_h", *[f"f{i}" for i in range(len(feats))])
    max_depth = int(np.ceil(np.log2(max(psi, 2))))
    fcols = [f"f{i}" for i in range(len(feats))]

    def grow(pdf):
        pdf = pdf.sort_values("_h").head(psi)
        t = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        ft, th, le, ri, sz = _grow_tree(pdf[fcols].to_numpy(dtype=float), rng, max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(ft)), "feature": ft, "threshold": th,
                             "left": le, "right": ri, "size": sz})

    nodes = picked.groupBy("_tree").applyInPandas(
        grow, "tree int, node int, feature int, threshold double, left int, right int, size long").collect()
    forest = {}
    for r in nodes:
        forest.setdefault(r["tree"], []).append(r)
    if len(forest) < n_trees:
        raise RuntimeError(f"only {len(forest)} of {n_trees} trees got rows; are the keys distinct?")
    packed = []
    for t in sorted(forest):
        rows = sorted(forest[t], key=lambda r: r["node"])
        packed.append((np.array([r["feature"] for r in rows]), np.array([r["threshold"] for r in rows]),
                       np.array([r["left"] for r in rows]), np.array([r["right"] for r in rows]),
                       np.array([r["size"] for r in rows], dtype=float)))
    bc = spark.sparkContext.broadcast((packed, float(_c([psi])[0])))

    @F.pandas_udf("double")
    def score(*features):
        forest_arrays, c_psi = bc.value
        x = np.column_stack([f.to_numpy(dtype=float) for f in features])
        total = np.zeros(len(x))
        for ft, th, le, ri, sz in forest_arrays:
            nodeid = np.zeros(len(x), dtype=int)
            depth = np.zeros(len(x))
            active = ft[nodeid] >= 0
            while active.any():
                idx = np.flatnonzero(active)
                cur = nodeid[idx]
                go_left = x[idx, ft[cur]] < th[cur]
                nodeid[idx] = np.where(go_left, le[cur], ri[cur])
                depth[idx] += 1
                active = ft[nodeid] >= 0
            total += depth + _c(sz[nodeid])
        return pd.Series(np.power(2.0, -(total / len(forest_arrays)) / c_psi) if c_psi > 0 else np.full(len(x), 0.5))

    # Scoring is per-row numpy work; an input scanned as fewer partitions than cores (e.g. one
    # parquet row group) is spread round-robin first so every core scores.
    cores = spark.sparkContext.defaultParallelism
    to_score = data.repartition(cores) if data.rdd.getNumPartitions() < cores else data
    scored = to_score.withColumn("anomaly_score", score(*[_x(c) for c in feats]))  # only the features go to Python
    checkpoint_dir(spark)
    scored = scored.checkpoint(eager=True)  # scored once; the quantile passes read the checkpoint
    cut = quantile_table(scored, ["anomaly_score"], [1.0 - contamination])["anomaly_score"][0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(cut))
