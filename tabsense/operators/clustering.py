"""Clustering: k-means and cluster-quality metrics.

Features are either a list of numeric columns or one array column (e.g. an embedding).
Metrics but the Euclidean silhouette need only per-cluster sums, which stay a table (a row a cluster,
map-side combined) that is joined to the rows; rows are never joined to each other.
The silhouette is in ``silhouette``, the fitting of many models at once in ``kmeans``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.quantiles import quantile_table
from tabsense.functions.schema import qcol
from tabsense.functions.stats import stats_row
from tabsense.operators import kmeans
from tabsense.operators.silhouette import distances, silhouettes
from tabsense.session import scratch_path

DEFAULT_SEED = 42
# Fixed values of the reference: starts of a fit and of each k in a sweep, k without any positive
# silhouette, rows whose silhouette a sweep takes.
FIT_STARTS, SWEEP_STARTS = 10, 5
FALLBACK_K = 3
SILHOUETTE_ROWS = 5000
LITERAL_MAX = 4096  # cluster statistics inlined as literals up to this many values
KMEANS_IF_CONTAMINATION = 0.1
MAX_CLUSTERS = 100_000  # clusters whose sums the squared silhouette's shortcut holds; the Euclidean one has no limit
SENT_BYTES, SALTS = 64 << 20, 16  # centroids that are broadcast; copies of each where they are joined
CENTROID_BLOCK, CENTROID_RUN = 1024, 32  # centroids in a block, blocks set against one block in a task


# ----------------------------------------------------------------------------- vectors

def vector_expr(df: DataFrame, features) -> tuple[Column, int | None]:
    """array<double> expression for ``features`` (array column name or list of columns)."""
    if isinstance(features, str) and isinstance(df.schema[features].dataType, T.ArrayType):
        return F.transform(F.col(f"`{features}`"), lambda v: v.cast("double")), None
    cols = [features] if isinstance(features, str) else list(features)
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols]), len(cols)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _sqnorm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def cluster_sums(df: DataFrame, features, label: str) -> tuple[dict, int]:
    """Per cluster: n, sum vector, sum of squared norms (collected: k x d numbers).

    Vector sums use spark.ml's ``Summarizer`` (a JVM aggregate over vectors, partial per task),
    so no per-element rows are created.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    vec, _ = vector_expr(df, features)
    data = df.select(qcol(label).alias("_c"), vec.alias("_x")).where(F.col("_c").isNotNull())
    per_c = data.groupBy("_c").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_sqnorm(F.col("_x"))).alias("q"),
        Summarizer.metrics("sum").summary(array_to_vector("_x")).alias("_m"))
    per_c = per_c.select("_c", "n", "q", vector_to_array(F.col("_m.sum")).alias("s"))
    out: dict = {}
    dim = 0
    rows = per_c.limit(MAX_CLUSTERS + 1).collect()  # one row per cluster
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters in {label!r}; is it a cluster label?")
    for r in rows:
        s = np.asarray(r["s"], dtype=float)
        out[r["_c"]] = {"n": int(r["n"]), "q": float(r["q"]), "s": s}
        dim = max(dim, len(s))
    return out, dim


# ----------------------------------------------------------------------------- metrics

def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per cluster and balance = population std / mean of the sizes."""
    sizes = df.where(F.col(f"`{label}`").isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    bal = stats_row(sizes, {"sd": F.stddev_pop("size"), "m": F.avg("size")})
    balance = (bal["sd"] / bal["m"]) if bal["m"] else None
    return sizes.withColumn("balance", F.lit(balance).cast("double"))


def _centroids(df: DataFrame, features, label: str) -> DataFrame:
    """A written row per cluster, however many there are: _c, _row, n, q (sum of squared norms), s (sum vector)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    vec, _ = vector_expr(df, features)
    data = df.select(qcol(label).alias("_c"), vec.alias("_x")).where(F.col("_c").isNotNull())
    sums = data.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.sum(_sqnorm(F.col("_x"))).alias("q"),
                                  Summarizer.metrics("sum").summary(array_to_vector("_x")).alias("_m"))
    sums = sums.select("_c", F.monotonically_increasing_id().alias("_row"), "n", "q", vector_to_array(F.col("_m.sum")).alias("s"))
    path = scratch_path(df.sparkSession, "centroids")
    sums.write.parquet(path)
    return df.sparkSession.read.schema(sums.schema).parquet(path)


def _scatter(centroids: DataFrame) -> tuple[float, float, int, int]:
    """WCSS, BCSS, rows and clusters, from aggregates over the centroids."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    total = centroids.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("q") - _sqnorm(F.col("s")) / F.col("n")).alias("w")).first()
    if not total["n"]:
        return 0.0, 0.0, 0, 0
    whole = centroids.agg(Summarizer.metrics("sum").summary(array_to_vector("s")).alias("m")).select(vector_to_array("m.sum")).first()[0]  # one row
    mean = F.array(*[F.lit(x / total["n"]) for x in whole])
    between = centroids.agg(F.sum(F.col("n") * _sqdist(F.transform("s", lambda x: x / F.col("n")), mean)).alias("b")).first()["b"]
    return float(total["w"]), float(between), int(total["n"]), int(total["k"])


def cluster_wcss_ratio(df: DataFrame, features, label: str) -> DataFrame:
    """WCSS, BCSS and BCSS / (WCSS + BCSS), for any number of clusters."""
    wcss, bcss, _, _ = _scatter(_centroids(df, features, label))
    ratio = bcss / (wcss + bcss) if (wcss + bcss) > 0 else 0.0
    return df.sparkSession.createDataFrame([(wcss, bcss, ratio)], "wcss double, bcss double, variance_ratio double")


def cluster_calinski_harabasz(df: DataFrame, features, label: str) -> DataFrame:
    wcss, bcss, n, k = _scatter(_centroids(df, features, label))
    ch = (bcss / (k - 1)) / (wcss / (n - k)) if k > 1 and wcss > 0 and n > k else None
    return df.sparkSession.createDataFrame([(ch,)], "calinski_harabasz double")


def _spreads(df: DataFrame, features, label: str, centroids: DataFrame, k: int) -> DataFrame:
    """(_row, mean, spread) of each cluster: its centroid and the mean distance of its rows to it.

    Few centroids are broadcast; more are joined, each in ``SALTS`` copies so that no cluster's rows meet in
    one task.
    """
    vec, _ = vector_expr(df, features)
    data = df.select(qcol(label).alias("_c"), vec.alias("_x")).where(F.col("_c").isNotNull())
    means = centroids.select("_c", "_row", F.transform("s", lambda x: x / F.col("n")).alias("mean"))
    width = means.select(F.size("mean")).first()[0]
    if 8 * k * width <= SENT_BYTES:
        both = data.join(F.broadcast(means), "_c")
    else:
        salted = means.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = data.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(SALTS)).cast("int")).join(salted, ["_c", "_salt"])
    spread = both.groupBy("_row").agg(F.avg(F.sqrt(_sqdist(F.col("_x"), F.col("mean")))).alias("spread"))
    return means.select("_row", "mean").join(spread, "_row")


def _pack_centroids(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([rows.column("_row").to_pylist()], pa.list_(pa.int64())),
                     "spread": pa.array([rows.column("spread").to_pylist()], pa.list_(pa.float64())),
                     "x": pa.array([kmeans.matrix(rows.column("mean").combine_chunks()).tobytes()], pa.binary())})


def _worst_of_blocks(key: tuple, own: pa.Table, others: pa.Table) -> pa.Table:
    """For each centroid of one block the greatest (S_i + S_j) / d_ij over the other blocks' centroids."""
    if not own.num_rows:  # no centroid has this block's hash
        return pa.table({"_row": pa.array([], pa.int64()), "worst": pa.array([], pa.float64())})
    (mine,) = own.to_pylist()
    x = np.frombuffer(mine["x"]).reshape(len(mine["rows"]), -1)
    rows, spread, worst = np.array(mine["rows"]), np.array(mine["spread"]), np.full(len(x), -np.inf)
    for part in others.to_batches(max_chunksize=1):
        (r,) = part.to_pylist()
        d = distances(x, np.frombuffer(r["x"]).reshape(len(r["rows"]), -1))
        both = spread[:, None] + np.array(r["spread"])[None, :]
        ratio = np.divide(both, d, out=np.full_like(d, np.inf), where=d > 0)
        ratio[rows[:, None] == np.array(r["rows"])[None, :]] = -np.inf
        worst = np.maximum(worst, ratio.max(axis=1))
    return pa.table({"_row": pa.array(rows, pa.int64()), "worst": pa.array(worst, pa.float64())})


def cluster_davies_bouldin(df: DataFrame, features, label: str) -> DataFrame:
    """Mean over clusters of the worst (S_i + S_j) / d(mu_i, mu_j); S = mean Euclidean distance of a cluster's
    points to its centroid.  Any number of clusters: centroids meet in blocks, and only each one's worst ratio
    leaves a task."""
    centroids = _centroids(df, features, label)
    k = centroids.count()
    if k < 2:
        return df.sparkSession.createDataFrame([(None,)], "davies_bouldin double")
    n_blocks = -(-k // CENTROID_BLOCK)
    runs = -(-n_blocks // CENTROID_RUN)
    packed = _spreads(df, features, label, centroids, k).groupBy(F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).alias("block")) \
        .applyInArrow(_pack_centroids, "block long, rows array<long>, spread array<double>, x binary")
    path = scratch_path(df.sparkSession, "centroid-blocks")
    packed.write.parquet(path)
    blocks = df.sparkSession.read.schema(packed.schema).parquet(path)
    own = blocks.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    others = blocks.select(F.pmod("block", F.lit(runs)).alias("run"), "rows", "spread", "x",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    worst = own.groupBy("block", "run").cogroup(others.groupBy("block", "run")).applyInArrow(_worst_of_blocks, "_row long, worst double")
    return worst.groupBy("_row").agg(F.max("worst").alias("worst")).where(F.col("worst") > float("-inf")).agg(F.avg("worst").alias("davies_bouldin"))


def _numbered(df: DataFrame, vec: Column, labels: Column, name: str) -> DataFrame:
    """``df`` with ``_row``, ``_x`` and ``_labels``, written so that a row keeps its number."""
    path = scratch_path(df.sparkSession, name)
    named = df.withColumn("_x", vec).withColumn("_labels", labels).withColumn("_row", F.monotonically_increasing_id())
    named.write.parquet(path)
    return df.sparkSession.read.schema(named.schema).parquet(path)


def silhouette_values(df: DataFrame, features, label: str, queries: int | None = None) -> DataFrame:
    """Rows with their Euclidean ``silhouette``: all that have a label, or ``queries`` of them picked by a hash.

    Each is measured against all rows (see ``silhouette``).
    """
    vec, _ = vector_expr(df, features)
    rows = _numbered(df.where(qcol(label).isNotNull()), vec, F.array(qcol(label).cast("string")), "silhouette-rows")
    found = silhouettes(rows.select("_row", "_x", "_labels"), queries)
    return rows.drop("_x", "_labels").join(found.select("_row", "silhouette"), "_row").drop("_row")


def cluster_silhouette(df: DataFrame, features, label: str, queries: int | None = None) -> DataFrame:
    """Mean Euclidean silhouette of all rows, or of ``queries`` of them."""
    vec, _ = vector_expr(df, features)
    rows = df.where(qcol(label).isNotNull()).select(vec.alias("_v"), qcol(label).cast("string").alias("_c"))
    rows = _numbered(rows, F.col("_v"), F.array("_c"), "silhouette-rows").select("_row", "_x", "_labels")
    return silhouettes(rows, queries).agg(F.avg("silhouette").alias("silhouette"))


def squared_silhouette_values(df: DataFrame, features, label: str) -> DataFrame:
    """Per-row silhouette with squared Euclidean distance in O(rows x k):
    mean distance from x to cluster C = |x|^2 - 2 x.S_C / n_C + Q_C / n_C.

    Up to LITERAL_MAX cluster-sum values are inlined as literal arrays (JVM expressions);
    beyond that the sums (k x d values, independent of the row count) are broadcast and rows
    are scored with numpy in ``mapInPandas``.
    """
    stats, dim = cluster_sums(df, features, label)
    order = sorted(stats)
    vec, _ = vector_expr(df, features)
    if len(order) * max(dim, 1) > LITERAL_MAX:
        return _silhouette_numpy(df, vec, label, stats, order)
    idx = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i + 1))])
    sums = F.array(*[F.array(*[F.lit(float(x)) for x in stats[c]["s"]]) for c in order])
    ns = F.array(*[F.lit(float(stats[c]["n"])) for c in order])
    qs = F.array(*[F.lit(float(stats[c]["q"])) for c in order])
    data = df.withColumn("_x", vec).withColumn("_i", F.element_at(idx, qcol(label))) \
        .where(F.col("_i").isNotNull()).withColumn("_xx", _sqnorm(F.col("_x")))
    pos = F.sequence(F.lit(1), F.lit(len(order)))
    mean_d = F.transform(pos, lambda j: F.col("_xx") - 2 * _dot(F.col("_x"), F.element_at(sums, j)) / F.element_at(ns, j)
                         + F.element_at(qs, j) / F.element_at(ns, j))
    data = data.withColumn("_d", mean_d)
    n_own = F.element_at(ns, F.col("_i"))
    a = F.try_divide(F.element_at(F.col("_d"), F.col("_i")) * n_own, n_own - 1)
    others = F.filter(F.transform(pos, lambda j: F.when(j != F.col("_i"), F.element_at(F.col("_d"), j))),
                      lambda v: v.isNotNull())
    b = F.array_min(others)
    s = F.when(n_own <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))  # a = b = 0: a tie
    return data.withColumn("silhouette", s).drop("_x", "_i", "_xx", "_d")


def _silhouette_numpy(df: DataFrame, vec, label: str, stats: dict, order) -> DataFrame:
    spark = df.sparkSession
    pos = {c: i for i, c in enumerate(order)}
    sums = np.stack([stats[c]["s"] for c in order])
    ns = np.array([float(stats[c]["n"]) for c in order])
    qs = np.array([float(stats[c]["q"]) for c in order])
    bc = spark.sparkContext.broadcast((pos, sums / ns[:, None], ns, qs / ns))
    data = df.withColumn("_x", vec).where(qcol(label).isNotNull())
    out_fields = [f for f in data.schema.fields if f.name != "_x"]
    schema = T.StructType(out_fields + [T.StructField("silhouette", T.DoubleType())])
    names = [f.name for f in out_fields]

    def run(batches):
        index, means, n, qbar = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["_x"].to_numpy()).astype(float)
            own = np.array([index[v] for v in pdf[label].tolist()])
            d = (x * x).sum(axis=1)[:, None] - 2.0 * x @ means.T + qbar[None, :]
            rows = np.arange(len(x))
            n_own = n[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                a = d[rows, own] * n_own / (n_own - 1)
                d[rows, own] = np.inf
                b = d.min(axis=1)
                sil = np.where((n_own <= 1) | (np.maximum(a, b) == 0), 0.0, (b - a) / np.maximum(a, b))
            out = pdf[names].copy()
            out["silhouette"] = sil
            yield out

    return data.mapInPandas(run, schema)


def cluster_silhouette_squared(df: DataFrame, features, label: str) -> DataFrame:
    """Mean silhouette (squared Euclidean) over all rows."""
    return squared_silhouette_values(df, features, label).agg(F.avg("silhouette").alias("silhouette"))


# ----------------------------------------------------------------------------- k-means

def _vectors(df: DataFrame, features, scale: bool) -> DataFrame:
    """``df`` with the vector ``_x``; rows that lack a feature are left out."""
    if isinstance(features, str) and isinstance(df.schema[features].dataType, T.ArrayType):
        data = df.where(F.col(f"`{features}`").isNotNull())
        return data.withColumn("_x", vector_expr(data, features)[0])
    cols = [features] if isinstance(features, str) else list(features)
    data = df.na.drop(subset=cols)
    if scale:
        stats = stats_row(data, {**{f"m|{c}": F.avg(qcol(c).cast("double")) for c in cols},
                                 **{f"s|{c}": F.stddev_pop(qcol(c).cast("double")) for c in cols}})
        arr = F.array(*[(qcol(c).cast("double") - F.lit(stats[f"m|{c}"])) / F.lit(stats[f"s|{c}"] or 1.0) for c in cols])
    else:
        arr = F.array(*[qcol(c).cast("double") for c in cols])
    return data.withColumn("_x", arr)


def kmeans_fit(df: DataFrame, features, k: int = 3, scale: bool = False, remove_outliers=False,
               seed: int = DEFAULT_SEED, max_iter: int = 20, key_cols=None, starts: int = FIT_STARTS,
               mini_batch: bool = False):
    """Fit k-means; returns (rows with ``cluster``, -1 where excluded; the ``kmeans.Fit`` of least inertia).

    ``starts`` are fitted together in shared scans; ``mini_batch`` fits them on hashed batches.

    Excluded rows: nulls in a feature, or with ``remove_outliers`` = True / "iqr" rows outside
    the sequential IQR bounds of any feature, with "isolation_forest" the rows an Isolation
    Forest (contamination 0.1) flags.  The full data is used (no sampling).
    """
    keep = F.lit(True)
    original = df
    cols = [features] if isinstance(features, str) else list(features)
    is_array = isinstance(features, str) and isinstance(df.schema[features].dataType, T.ArrayType)
    if remove_outliers == "isolation_forest" and not is_array:
        from tabsense.operators.anomaly import anomaly_isolation_forest
        flagged_if = anomaly_isolation_forest(df, cols, contamination=KMEANS_IF_CONTAMINATION, key_cols=key_cols)
        df = flagged_if.withColumn("_iso_keep", ~F.col("is_anomaly")).drop("is_anomaly", "anomaly_score")
        keep = F.col("_iso_keep")
        remove_outliers = False
    if remove_outliers and not is_array:
        data = df.na.drop(subset=cols)
        for c in cols:
            q1, q3 = quantile_table(data, [c], [0.25, 0.75])[c]
            if q1 is None:
                continue
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            pred = (qcol(c) >= F.lit(lo)) & (qcol(c) <= F.lit(hi))
            data = data.where(pred)
            keep = keep & pred
    flagged = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    assembled = _vectors(flagged, features, scale)
    fits = kmeans.fit_all(assembled.where("_keep").select("_x"), [k], starts, seed=seed, max_iter=max_iter, mini_batch=mini_batch)
    if not fits:
        raise ValueError("no row to cluster")
    model = kmeans.best_of(fits)[k]
    scored = kmeans.assign(assembled, [model], "_pred").withColumn(
        "cluster", F.when(F.col("_keep"), F.col("_pred")[0]).otherwise(F.lit(-1))).drop("_pred", "_x", "_keep")
    if "_iso_keep" in scored.columns:
        scored = scored.drop("_iso_keep")
    def missing_value(c):  # na.drop takes NaN for missing too
        x = qcol(c)
        return x.isNull() | F.isnan(x) if isinstance(original.schema[c].dataType, (T.DoubleType, T.FloatType)) else x.isNull()

    any_null = reduce(lambda a, b: a | b, [missing_value(c) for c in cols])
    missing = original.where(any_null).withColumn("cluster", F.lit(-1))
    scored = scored.unionByName(missing)
    return scored, model


def kmeans_sweep(df: DataFrame, features, k_values, scale: bool = True, seed: int = DEFAULT_SEED,
                 max_iter: int = 20, with_silhouette: bool = True, starts: int = SWEEP_STARTS,
                 queries: int | None = SILHOUETTE_ROWS) -> DataFrame:
    """Per k: least inertia of its starts, and the mean Euclidean silhouette of ``queries`` rows against all.

    All starts of all k are fitted in shared scans, and all silhouettes share one pass over the distances.
    """
    data = _vectors(df, features, scale).select("_x")
    best = kmeans.best_of(kmeans.fit_all(data, k_values, starts, seed=seed, max_iter=max_iter))
    silhouette: dict[int, float] = {}
    if with_silhouette and best:
        named = kmeans.assign(data, list(best.values()), "_own")
        rows = _numbered(named, F.col("_x"), F.transform("_own", lambda c: c.cast("string")), "sweep-rows")
        mean = silhouettes(rows.select("_row", "_x", "_labels"), queries).groupBy("labelling").agg(F.avg("silhouette").alias("s"))
        silhouette = {k: r["s"] for r in mean.collect() for k in [list(best)[r["labelling"]]]}  # a row for each k
    return df.sparkSession.createDataFrame([(int(k), f.inertia, silhouette.get(k)) for k, f in best.items()],
                                           "k int, inertia double, silhouette double")


def kmeans_elbow(df: DataFrame, features, k_values=range(2, 8), scale: bool = False, seed: int = DEFAULT_SEED) -> DataFrame:
    """Inertia per k; ``is_elbow`` marks the k just before the largest inertia drop."""
    sweep = kmeans_sweep(df, features, list(k_values), scale, seed, with_silhouette=False).orderBy("k").collect()
    ks = [r["k"] for r in sweep]
    inert = [r["inertia"] for r in sweep]
    elbow = ks[int(np.argmin(np.diff(inert)))] if len(inert) >= 2 else 3
    rows = [(k, i, k == elbow) for k, i in zip(ks, inert)]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, is_elbow boolean")


def kmeans_auto_k_silhouette(df: DataFrame, features, k_values=range(2, 9), scale: bool = True,
                             seed: int = DEFAULT_SEED) -> DataFrame:
    """Silhouette per k; ``is_best`` marks the argmax (first on ties), or k = 3 when no
    silhouette is positive (the reference's fallback)."""
    sweep = kmeans_sweep(df, features, list(k_values), scale, seed).orderBy("k").collect()
    best = max(sweep, key=lambda r: (r["silhouette"] if r["silhouette"] is not None else -2, -r["k"]))["k"]
    if all((r["silhouette"] is None or r["silhouette"] <= 0) for r in sweep):
        best = FALLBACK_K
    rows = [(r["k"], r["inertia"], r["silhouette"], r["k"] == best) for r in sweep]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, is_best boolean")


def cluster_analysis(df: DataFrame, features, seed: int = DEFAULT_SEED, k_values=range(2, 11)):
    """Scale, sweep ``k_values``, pick the best silhouette, fit the final model.
    Returns (sweep table, rows with ``cluster``)."""
    sweep = kmeans_auto_k_silhouette(df, features, list(k_values), True, seed)
    best = [r["k"] for r in sweep.collect() if r["is_best"]]
    final, _ = kmeans_fit(df, features, best[0] if best else 3, scale=True, seed=seed)
    return sweep, final
