"""The order-dependent and quantile helpers give the same answer however the data is
partitioned, including when one key holds a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.functions.ordered import cumulative_sums, ordered_fill
from tabsense.functions.quantiles import quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n))  # key 0 holds a third
    val = rng.normal(size=n)
    val[rng.random(n) < 0.3] = np.nan
    val[np.arange(n) % 5 == 0] = 1.5  # a hot value
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "ts": rng.permutation(n), "v": val})
    return spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_match_pandas(spark, skewed, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    try:
        got = {(r["k"], r["prob"]): r["quantile"] for r in quantiles(skewed, ["v"], probs, by=["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = skewed.toPandas().groupby("k")["v"].quantile(probs)
    assert set(got) == set(want.index)
    for key, value in want.items():
        assert (got[key] is None and np.isnan(value)) or got[key] == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize("kind", ["int", "double", "string"])
def test_quantiles_of_null_and_nan_groups(spark, kind):
    rng = np.random.default_rng(2)
    v = rng.normal(size=40_000).round(3)
    g = np.arange(40_000) % 4
    rows = [(None if k == 0 else int(k), float(x)) for k, x in zip(g, v)]
    df = spark.createDataFrame(rows, "g int, v double")
    if kind == "double":
        df = df.select(F.when(F.col("g") == 3, F.lit(float("nan"))).otherwise(F.col("g").cast("double")).alias("g"), "v")
    else:
        df = df.select(F.col("g").cast(kind).alias("g"), "v")
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = quantiles(df, ["v"], probs, by=["g"])
    assert got.columns == ["g", "column", "prob", "quantile"]
    found = {}
    for r in got.collect():
        found.setdefault(str(r["g"]), {})[r["prob"]] = r["quantile"]
    assert len(found) == 4
    for k, name in enumerate(["None", *({"int": "1 2 3", "string": "1 2 3", "double": "1.0 2.0 nan"}[kind].split())]):
        want = np.quantile(v[g == k], probs)
        assert [found[name][p] for p in probs] == pytest.approx(want.tolist(), abs=1e-12)


def test_tree_threshold_at_any_size():
    from tabsense.operators.anomaly import tree_threshold
    assert tree_threshold(100, 100) is None
    for n in (10_000, 10 ** 9, 3 * 10 ** 10, 10 ** 12, 10 ** 15):
        share = (tree_threshold(n, 256) + 2 ** 63) / 2 ** 64
        assert share == pytest.approx(512 / n, rel=1e-6)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("backward", [False, True])
def test_ordered_fill_matches_pandas(spark, skewed, parts, backward):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = ordered_fill(skewed, ["v"], ["ts"], ["k"], backward=backward).toPandas() \
            .sort_values("id").reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    pdf = skewed.toPandas().sort_values(["k", "ts"])
    g = pdf.groupby("k")["v"]
    pdf["exp"] = g.bfill() if backward else g.ffill()
    exp = pdf.sort_values("id").reset_index(drop=True)
    np.testing.assert_allclose(got["v"].to_numpy(dtype=float), exp["exp"].to_numpy(dtype=float), equal_nan=True)


def test_ordered_fill_without_key(spark, skewed):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = ordered_fill(skewed, ["v"], ["ts"]).toPandas().sort_values("ts")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    exp = skewed.toPandas().sort_values("ts")["v"].ffill()
    np.testing.assert_allclose(got["v"].to_numpy(dtype=float), exp.to_numpy(dtype=float), equal_nan=True)


def test_cumulative_sums(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("w"))
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        out = cumulative_sums(df, "id", ["w"]).toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    np.testing.assert_allclose(out["cum_w"].to_numpy(), np.cumsum((np.arange(1000) % 7).astype(float)))


def test_auc_distributed_path_matches_local(spark, monkeypatch):
    from tabsense.operators import metrics
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 2000)
    s = np.round(rng.random(2000) * 0.5 + y * 0.3, 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    local_auc = metrics.eval_roc_auc(df, "y", "s").first()["roc_auc"]
    local_ap = metrics.eval_pr_auc(df, "y", "s").first()["pr_auc"]
    monkeypatch.setattr(metrics, "LOCAL_HISTOGRAM_MAX", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        dist_auc = metrics.eval_roc_auc(df, "y", "s").first()["roc_auc"]
        dist_ap = metrics.eval_pr_auc(df, "y", "s").first()["pr_auc"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert dist_auc == pytest.approx(local_auc, abs=1e-12)
    assert dist_ap == pytest.approx(local_ap, abs=1e-12)
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert local_auc == pytest.approx(brute, abs=1e-12)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_leave_rows_where_they_are(spark, skewed):
    """No task gets, or sorts, all rows of a column or group, whatever the size estimates say."""
    from tabsense.operators.features import train_test_split
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = train_test_split(skewed, ["id"], 0.2, stratify="k")
        for df in (quantiles(skewed, ["v"], [0.5]), quantiles(skewed, ["v"], [0.5], by=["k"]), split):
            assert "SortMergeJoin" not in _plan(df) and "SortAggregate" not in _plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quantiles_of_more_groups_than_are_broadcast(spark, skewed, monkeypatch):
    from tabsense.functions import quantiles as qs
    from tabsense.operators.charts import chart_box
    from tabsense.operators.features import train_test_split
    keyed = skewed.withColumn("g", F.when(F.col("k") == 1, None).when(F.col("k") == 2, float("nan")).otherwise(F.col("k").cast("double")))

    def found():
        q = quantiles(keyed, ["v", "id"], [0.25, 0.5], by=["g"])
        split = train_test_split(keyed, ["id"], 0.2, stratify="g").select("id", "split")
        return [sorted(map(str, df.collect())) for df in (q, split, chart_box(keyed, "id", "g"))]

    sent = found()
    monkeypatch.setattr(qs, "MOST_SENT", 0)
    assert found() == sent
