"""Edge frames: empty, one row, constant / all-null columns, NaN and inf, zero MAD, mode
ties, single class, identical rows, messy column names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsense.operators import anomaly, charts, clean, clustering, features, filters, metrics, normalize, profile


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.0, 5.0, "a", None), (2, 2.0, 5.0, "b", None), (3, 3.0, 5.0, "b", None),
            (4, 4.0, 5.0, "a", None), (5, 100.0, 5.0, None, None)]
    return spark.createDataFrame(rows, "id long, x double, c double, s string, z double")


def test_normalize_names_and_nan(spark):
    df = spark.createDataFrame([(1.0, float("nan"), float("inf"), "q")], "`a b` double, `1x` double, `a-b` double, `(s)` string")
    out = normalize.normalize_table(df)
    assert out.columns == ["a_b", "col_1x", "a_b_2", "s"]
    r = out.first()
    assert r["col_1x"] is None and r["a_b_2"] is None and r["a_b"] == 1.0


def test_empty_frame_profiles(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert profile.missing_total(df).first()["missing_cells"] == 0
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 0
    assert profile.numeric_profile(df).count() == 0


def test_constant_and_all_null_columns(small):
    npf = {r["column"]: r for r in profile.numeric_profile(small, ["x", "c"]).collect()}
    assert npf["c"]["std"] == 0.0
    m = {r["column"]: r["missing_pct"] for r in profile.missing_by_column(small).collect()}
    assert m["z"] == 100.0 and m["x"] == 0.0
    hm = [r["column"] for r in profile.high_missing_columns(small).collect()]
    assert hm == ["z"]


def test_mode_tie_takes_smallest(small):
    cp = profile.categorical_profile(small, ["s"]).first()
    assert cp["most_frequent"] == "a"  # a and b both appear twice
    assert clean.column_modes(small, ["s"]) == {"s": "a"}
    filled = clean.impute_mode(small, ["s"]).where("id = 5").first()
    assert filled["s"] == "a"


def test_impute_all_null(small):
    out = clean.impute_mean(small, ["z"]).select(F.sum("z")).first()[0]
    assert out == 0.0


def test_zero_mad_modified_z(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 5, 5, 5, 9]], "x double")
    res = {r["x"]: r for r in anomaly.anomaly_modified_zscore(df, ["x"]).collect()}
    assert res[5.0]["anomaly_score"] is None and res[5.0]["is_anomaly"] is False
    assert math.isinf(res[9.0]["anomaly_score"]) and res[9.0]["is_anomaly"] is True


def test_zscore_flags_outlier(small):
    res = {r["id"]: r["is_anomaly"] for r in anomaly.anomaly_zscore(small, ["x"], threshold=1.5).collect()}
    assert res[5] is True and res[1] is False


def test_identical_rows_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (2, "b")], "a int, b string")
    d = profile.duplicate_rows(df).first()
    assert d["duplicate_rows"] == 2 and d["total_rows"] == 5


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "y int, p int")
    r = metrics.eval_classification(df, "y", "p").first()
    assert r["accuracy"] == pytest.approx(2 / 3)
    assert r["mcc"] == 0.0
    auc = metrics.eval_roc_auc(spark.createDataFrame([(1, 0.3), (1, 0.2)], "y int, s double"), "y", "s").first()
    assert auc["roc_auc"] is None


def test_roc_auc_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.eval_roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(0.875)
    ap = metrics.eval_pr_auc(df, "y", "s").first()["pr_auc"]
    assert ap == pytest.approx(0.5 * 1.0 + 0.5 * (2 / 3))


def test_bins_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["x_binned"] for r in features.feat_bins(df).collect()] == ["Medium", "Medium"]


def test_bins_minimum_in_first_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    got = [r["x_binned"] for r in features.feat_bins(df).orderBy("x").collect()]
    assert got[0] == "Low" and got[2] == "Low" and got[3] == "Low-Med" and got[-1] == "High"


def test_filters(small):
    assert filters.filter_in(small, "s", ["a", "null"]).count() == 3
    assert filters.filter_range(small, "x", 2, 2).count() == 5  # lo == hi: no filter
    assert filters.filter_compare(small, "x", ">=", "3").count() == 3
    with pytest.raises(ValueError):
        filters.filter_conjunction(small, {"filter_nope": [1, 2]})
    red = filters.filter_reduction(small, F.col("x") > 2).first()
    assert red["kept_rows"] == 3 and red["reduction_pct"] == 40.0


def test_label_encode_nulls_as_nan(small):
    out = {r["id"]: r["s"] for r in features.label_encode(small, ["s"]).collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: 0, 5: 2}


def test_standard_scale_zero_std(small):
    out = [r["c"] for r in features.standard_scale(small, ["c"]).collect()]
    assert out == [0.0] * 5


def test_sample_rows_exact_and_stable(spark):
    df = spark.range(500)
    a = sorted(r["id"] for r in normalize.sample_rows(df, 37, ["id"]).collect())
    b = sorted(r["id"] for r in normalize.sample_rows(df.repartition(7), 37, ["id"]).collect())
    assert len(a) == 37 and a == b


def test_multiclass_roc_auc_weighted(spark):
    rows = [(0, 0.8, 0.1, 0.1), (0, 0.6, 0.3, 0.1), (1, 0.2, 0.7, 0.1), (1, 0.3, 0.3, 0.4),
            (2, 0.1, 0.2, 0.7), (2, 0.3, 0.3, 0.4), (2, 0.5, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double")
    got = metrics.eval_roc_auc(df, "y", {0: "p0", 1: "p1", 2: "p2"}).first()["roc_auc"]

    def auc(pos, scores):
        p = [s for yy, s in zip([r[0] for r in rows], scores) if yy == pos]
        n = [s for yy, s in zip([r[0] for r in rows], scores) if yy != pos]
        return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    expected = sum(auc(c, [r[c + 1] for r in rows]) * sum(r[0] == c for r in rows) for c in range(3)) / len(rows)
    assert got == pytest.approx(expected)


def test_adaptive_split_fraction():
    assert features.adaptive_test_fraction(100) == 0.3
    assert features.adaptive_test_fraction(5000) == 0.2
    assert features.adaptive_test_fraction(1_000_000) == 0.1


def test_forest_needs_rows_and_classes(spark):
    from tabsense.operators import models
    tiny = spark.createDataFrame([(float(i), 1) for i in range(5)], "x double, y int")
    with pytest.raises(ValueError):
        models.random_forest(tiny, ["x"], "y", "classification")
    one_class = spark.createDataFrame([(float(i), 1) for i in range(20)], "x double, y int")
    with pytest.raises(ValueError):
        models.random_forest(one_class, ["x"], "y", "classification")


def test_binned_violin_close_to_exact_kde(spark):
    import numpy as np
    from tabsense.operators import charts
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 700), rng.normal(4, 0.5, 300)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = charts.chart_violin(df, "x").orderBy("point").toPandas()
    n, sd = len(vals), vals.std(ddof=1)
    h = sd * n ** -0.2
    grid = np.linspace(vals.min(), vals.max(), 50)
    exact = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / h) ** 2).sum(axis=1) / (n * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["y"].to_numpy(), grid, rtol=1e-9, atol=1e-9)
    assert np.max(np.abs(got["density"].to_numpy() - exact)) < 0.01 * exact.max()


def test_awkward_column_names(spark):
    from tabsense.functions.quantiles import quantile_table
    df = spark.createDataFrame([(1.0, "a", 2.0), (2.0, "b", None), (3.0, "a", 4.0), (10.0, None, 1.0)],
                               "`unit price` double, `seg.name` string, `q (x)` double")
    assert filters.filter_in(df, "seg.name", ["a"]).count() == 2
    assert filters.filter_range(df, "unit price", 1.5, 3).count() == 2
    assert quantile_table(df, ["unit price"], [0.5])["unit price"] == [2.5]
    npf = {r["column"] for r in profile.numeric_profile(df).collect()}
    assert npf == {"unit price", "q (x)"}
    assert profile.categorical_profile(df).first()["most_frequent"] == "a"
    cm = profile.corr_matrix(df).count()
    assert cm == 4
    assert anomaly.anomaly_iqr(df, ["unit price"]).where("is_anomaly").count() == 1
    assert clean.impute_median(df, ["q (x)"]).where("`q (x)` IS NULL").count() == 0
    assert features.label_encode(df, ["seg.name"]).where("`seg.name` = 2").count() == 1


def test_wide_table_profiles(spark):
    """120 numeric + 2 string columns: statistics passes are chunked and results stay right."""
    import numpy as np
    rng = np.random.default_rng(11)
    n_num = 120
    data = rng.normal(size=(200, n_num))
    data[::7, 5] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (f"s{i % 3}", None if i % 4 else "x")
            for i, r in enumerate(data)]
    schema = ", ".join([f"c{i} double" for i in range(n_num)] + ["g string", "h string"])
    df = spark.createDataFrame(rows, schema)
    m = {r["column"]: r["missing_count"] for r in profile.missing_by_column(df).collect()}
    assert m["c5"] == len(range(0, 200, 7)) and m["h"] == 150 and m["c0"] == 0
    npf = {r["column"]: r for r in profile.numeric_profile(df, limit=n_num).collect()}
    assert len(npf) == n_num
    assert npf["c7"]["mean"] == pytest.approx(float(np.mean(data[:, 7])))
    assert npf["c7"]["std"] == pytest.approx(float(np.std(data[:, 7], ddof=1)))
    sugg = clean.suggest_cleaning(df).collect()
    assert any(r["type"] == "drop_column" and r["column"] == "h" for r in sugg)
    cm = profile.corr_matrix(df, [f"c{i}" for i in range(40)])
    r = {(x["column1"], x["column2"]): x["correlation"] for x in cm.collect()}
    assert r[("c1", "c2")] == pytest.approx(float(np.corrcoef(data[:, 1], data[:, 2])[0, 1]))


def test_approximate_modes_close_to_exact(spark):
    from tabsense.plans.catalog import table
    from tests.conftest import SF_SMALL
    li = table(spark, SF_SMALL, "lineitem")
    exact = {(r["column"], r["stat"]): r["num_value"] for r in profile.describe_all(li, ["l_extendedprice"]).collect()}
    approx = {(r["column"], r["stat"]): r["num_value"] for r in
              profile.describe_all(li, ["l_extendedprice"], accuracy=10000).collect()}
    for stat in ("25%", "50%", "75%"):
        assert approx[("l_extendedprice", stat)] == pytest.approx(exact[("l_extendedprice", stat)], rel=0.01)
    e = anomaly.anomaly_iqr(li, ["l_extendedprice"]).where("is_anomaly").count()
    a = anomaly.anomaly_iqr(li, ["l_extendedprice"], accuracy=10000).where("is_anomaly").count()
    assert abs(e - a) <= max(3, 0.05 * e)
    qs = profile.quality_score(li, approx=True).first()["quality_score"]
    assert qs == pytest.approx(profile.quality_score(li).first()["quality_score"], abs=0.5)


def test_all_filter_values_and_columns_count(spark):
    df = spark.createDataFrame([(str(i), i % 2 == 0, *[str((i + k) % 3) for k in range(12)]) for i in range(60)],
                               "s string, flag boolean, " + ", ".join(f"c{k} string" for k in range(12)))
    assert filters.filter_in(df, "s", [str(i) for i in range(60)]).count() == 60
    assert filters.filter_conjunction(df, {"filter_c11": ["0"]}).count() == 20
    assert filters.filter_conjunction(df, {"filter_flag": [True]}).count() == 30
    assert len({r["column"] for r in profile.categorical_profile(df).collect()}) == 13


def test_compare_is_exact_for_long_columns(spark):
    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "a long")
    assert [r["a"] for r in filters.filter_compare(df, "a", "=", 9007199254740993).collect()] == [9007199254740993]
    assert filters.filter_compare(df, "a", ">", "9007199254740992.5").count() == 1


def test_integer_columns_take_fractional_fills(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert sorted(r["a"] for r in clean.impute_median(df).collect()) == [1.0, 1.5, 2.0]
    assert sorted(r["a"] for r in clean.impute_mean(df).collect()) == [1.0, 1.5, 2.0]


def test_metrics_compare_numbers_with_numbers(spark):
    df = spark.createDataFrame([(0, 0.0, 0.1), (1, 1.0, 0.8), (1, 1.0, 0.6)], "y int, p double, s double")
    r = metrics.eval_classification(df, "y", "p").first()
    assert r["accuracy"] == r["f1"] == r["cohen_kappa"] == 1.0
    d = df.withColumn("y", F.col("y").cast("double"))
    assert metrics.eval_roc_auc(d, "y", "s").first()[0] == 1.0
    assert metrics.eval_log_loss(d, "y", "s").first()[0] == pytest.approx(-np.log([0.9, 0.8, 0.6]).mean())
    with pytest.raises(ValueError):
        metrics.eval_roc_auc(df, "y", "s", positive=7)
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert metrics.eval_regression(same, "y", "p").first()["r2"] == 0.0


def test_edges_do_not_raise(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert profile.quality_score(empty).first()["missing_ratio"] == 0.0
    nulls = spark.createDataFrame([(None, "a"), (None, "b")], "x double, s string")
    for df in (empty, nulls):
        assert anomaly.anomaly_iqr(df, ["x"]).where("is_anomaly").count() == 0
    tied = spark.createDataFrame([(1.0, 0), (1.0, 0), (1.0, 1), (1.0, 1)], "x double, c int")
    assert clustering.cluster_silhouette(tied, ["x"], "c").first()[0] == 0.0


def test_violin_keeps_groups_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("c", 7.0)], "g string, v double")
    rows = charts.chart_violin(df, "v", "g").collect()
    assert {(r["g"], r["y"], r["density"]) for r in rows if r["g"] != "a"} == {("b", 5.0, None), ("c", 7.0, None)}
    assert sum(r["g"] == "a" for r in rows) == 50


def test_kmeans_returns_nan_rows(spark):
    df = spark.createDataFrame([(float(i), float("nan") if i % 10 == 0 else float(i)) for i in range(100)], "x double, y double")
    rows, _ = clustering.kmeans_fit(df, ["x", "y"], 2)
    assert rows.count() == 100 and rows.where("cluster = -1").count() == 10


def test_perfect_correlations_are_reported(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "x double, y double")
    assert profile.corr_high_pairs(df).count() == 1
