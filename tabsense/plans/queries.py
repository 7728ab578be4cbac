"""Registered queries: one per operator of SURVEY section 2, over the fixture tables.

Each entry takes (spark, sf_dir) and returns a DataFrame.  Every computed double is rounded
to a fixed number of decimals so the SQL twin in ``oracle.py`` hashes to the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.operators import filters as flt
from tabsense.operators import normalize as nrm
from tabsense.operators import profile as prof
from tabsense.plans.catalog import table
from tabsense.plans.fixtures import lineitem_missing, orders_as_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round every double column (``per_column`` overrides the digits for named columns)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), per_column.get(f.name, digits)).alias(f.name)
        out.append(c)
    return df.select(*out)


# ------------------------------------------------------------------ 2.2 normalization

@register("normalize_table")
def q_normalize_table(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    messy = li.select(
        k.alias("order key"),
        F.when(k % 11 == 0, F.lit(float("inf"))).when(k % 13 == 0, F.lit(float("nan")))
         .otherwise(F.col("l_quantity")).alias("Quantity (units)"),
        F.when(k % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("l_extendedprice")).alias("2024 price$"),
        F.col("l_returnflag").alias("__flag__"),
        F.col("l_linestatus").alias("flag"))
    return nrm.normalize_table(messy)


@register("project_head")
def q_project_head(spark, sf):
    return nrm.project_head(table(spark, sf, "orders"), "o_orderkey", 100, 20)


@register("sample_rows")
def q_sample_rows(spark, sf):
    return nrm.sample_rows(table(spark, sf, "orders"), 100, ["o_orderkey"])


# ------------------------------------------------------------------ 2.3 filters

@register("filter_in")
def q_filter_in(spark, sf):
    df = lineitem_missing(spark, sf)
    return flt.filter_in(df, "l_returnflag", ["A", "None"])


@register("filter_in_many")
def q_filter_in_many(spark, sf):
    return flt.filter_in(table(spark, sf, "customer"), "c_custkey", range(1, 61))


@register("filter_wide_state")
def q_filter_wide_state(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_big", F.col("l_quantity") > 25)
    for k in range(12):
        li = li.withColumn(f"s{k}", ((F.col("l_orderkey") + k) % 5).cast("string"))
    return flt.filter_conjunction(li, {"filter_s11": ["1", "3"], "filter_l_big": [True]})


@register("filter_compare_long")
def q_filter_compare_long(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linenumber", (F.lit(9007199254740990) + F.col("l_orderkey")).alias("k"))
    return flt.filter_compare(li, "k", "=", 9007199254740993)


@register("filter_range")
def q_filter_range(spark, sf):
    return flt.filter_range(table(spark, sf, "lineitem"), "l_quantity", 10, 20)


@register("filter_datetime_range")
def q_filter_datetime_range(spark, sf):
    return flt.filter_datetime_range(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-10 12:00:00")


FILTER_STATE = {
    "filter_l_returnflag": ["A", "N"],
    "filter_l_quantity": [5, 30],
    "filter_l_discount": [0.05, 0.05],          # min == max: skipped
    "filter_l_shipdate": ["1995-01-01", "1998-12-31"],
}


@register("filter_conjunction")
def q_filter_conjunction(spark, sf):
    return flt.filter_conjunction(table(spark, sf, "lineitem"), FILTER_STATE)


@register("filter_compare")
def q_filter_compare(spark, sf):
    o = table(spark, sf, "orders")
    return flt.filter_compare(flt.filter_compare(o, "o_totalprice", ">=", "200000"), "o_orderstatus", "equals", "F")


@register("filter_reduction")
def q_filter_reduction(spark, sf):
    li = table(spark, sf, "lineitem")
    return flt.filter_reduction(li, flt.conjunction_predicate(li, FILTER_STATE))


@register("filter_options")
def q_filter_options(spark, sf):
    return rounded(flt.filter_options(table(spark, sf, "part")))


@register("dropna_rows")
def q_dropna_rows(spark, sf):
    df = lineitem_missing(spark, sf)
    return flt.dropna_rows(df, subset=["l_quantity", "l_tax", "l_returnflag"], target="l_extendedprice")


# ------------------------------------------------------------------ 2.4 profile

@register("agg_basic")
def q_agg_basic(spark, sf):
    return rounded(prof.agg_basic(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 4, sum=2)


@register("describe_all")
def q_describe_all(spark, sf):
    return prof.describe_all(table(spark, sf, "part"))


@register("value_counts_top")
def q_value_counts_top(spark, sf):
    return prof.value_counts_top(table(spark, sf, "lineitem"), "l_partkey", 5)


@register("missing_by_column")
def q_missing_by_column(spark, sf):
    return rounded(prof.missing_by_column(lineitem_missing(spark, sf)))


@register("missing_total")
def q_missing_total(spark, sf):
    return rounded(prof.missing_total(lineitem_missing(spark, sf)))


@register("high_missing_columns")
def q_high_missing_columns(spark, sf):
    return rounded(prof.high_missing_columns(lineitem_missing(spark, sf)))


@register("duplicate_rows")
def q_duplicate_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return prof.duplicate_rows(li)


@register("mixed_type_columns")
def q_mixed_type_columns(spark, sf):
    return prof.mixed_type_columns(orders_as_text(spark, sf))


@register("nunique_ratio")
def q_nunique_ratio(spark, sf):
    return rounded(prof.nunique_ratio(table(spark, sf, "customer")))


@register("column_preview")
def q_column_preview(spark, sf):
    return rounded(prof.column_preview(lineitem_missing(spark, sf)), 4)


@register("quality_score")
def q_quality_score(spark, sf):
    return rounded(prof.quality_score(lineitem_missing(spark, sf)))


@register("quality_issues")
def q_quality_issues(spark, sf):
    return prof.quality_issues(lineitem_missing(spark, sf))


@register("numeric_profile")
def q_numeric_profile(spark, sf):
    return rounded(prof.numeric_profile(table(spark, sf, "lineitem")), 4)


@register("categorical_profile")
def q_categorical_profile(spark, sf):
    return rounded(prof.categorical_profile(table(spark, sf, "orders")))


@register("corr_matrix")
def q_corr_matrix(spark, sf):
    return rounded(prof.corr_matrix(table(spark, sf, "lineitem")))


@register("corr_high_pairs")
def q_corr_high_pairs(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return rounded(prof.corr_high_pairs(li, threshold=0.8, top=3))


@register("eda_insights")
def q_eda_insights(spark, sf):
    df = lineitem_missing(spark, sf).withColumn("l_gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return prof.eda_insights(df)


@register("profile_report")
def q_profile_report(spark, sf):
    return rounded(prof.profile_report(lineitem_missing(spark, sf)), 4)


# ------------------------------------------------------------------ 2.5 cleaning

from tabsense.operators import anomaly as anom  # noqa: E402
from tabsense.operators import charts as ch  # noqa: E402
from tabsense.operators import clean as cln  # noqa: E402
from tabsense.operators import clustering as clu  # noqa: E402
from tabsense.operators import features as fe  # noqa: E402
from tabsense.operators import metrics as met  # noqa: E402
from tabsense.plans.fixtures import (events_gappy, labeled_documents, lineitem_dirty,  # noqa: E402
                                     lineitem_features)

LM_NUMERIC = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount"]
ANOMALY_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("suggest_cleaning")
def q_suggest_cleaning(spark, sf):
    return cln.suggest_cleaning(lineitem_dirty(spark, sf))


@register("drop_column")
def q_drop_column(spark, sf):
    return cln.drop_column(lineitem_missing(spark, sf), "l_discount")


@register("impute_median")
def q_impute_median(spark, sf):
    return rounded(cln.impute_median(lineitem_missing(spark, sf), ["l_tax", "l_discount", "l_quantity"]))


@register("impute_mean")
def q_impute_mean(spark, sf):
    return rounded(cln.impute_mean(lineitem_missing(spark, sf), ["l_tax", "l_discount", "l_quantity"]))


@register("impute_mode")
def q_impute_mode(spark, sf):
    return cln.impute_mode(lineitem_missing(spark, sf))


@register("impute_constant")
def q_impute_constant(spark, sf):
    return cln.impute_constant(lineitem_missing(spark, sf), 0.0, ["l_tax", "l_discount"])


@register("fill_forward")
def q_fill_forward(spark, sf):
    return cln.fill_forward(events_gappy(spark, sf), ["value"], ["ts", "event_id"], partition_by=["user_id"])


@register("fill_backward")
def q_fill_backward(spark, sf):
    return cln.fill_backward(events_gappy(spark, sf), ["value"], ["ts", "event_id"])


@register("convert_numeric")
def q_convert_numeric(spark, sf):
    return cln.convert_numeric(orders_as_text(spark, sf), ["o_totalprice", "o_custkey"])


@register("convert_datetime")
def q_convert_datetime(spark, sf):
    return cln.convert_datetime(orders_as_text(spark, sf), ["o_orderdate"])


@register("clip_iqr")
def q_clip_iqr(spark, sf):
    return rounded(cln.clip_iqr(lineitem_dirty(spark, sf), ["l_spiky", "l_extendedprice"]))


@register("drop_duplicates")
def q_drop_duplicates(spark, sf):
    return cln.drop_duplicates(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


# ------------------------------------------------------------------ 2.6 anomalies

@register("anomaly_zscore")
def q_anomaly_zscore(spark, sf):
    return rounded(anom.anomaly_zscore(table(spark, sf, "lineitem"), ANOMALY_FEATURES))


@register("anomaly_modified_zscore")
def q_anomaly_modified_zscore(spark, sf):
    return rounded(anom.anomaly_modified_zscore(table(spark, sf, "lineitem"), ANOMALY_FEATURES))


@register("anomaly_iqr")
def q_anomaly_iqr(spark, sf):
    df = lineitem_dirty(spark, sf).select("l_orderkey", "l_partkey", "l_quantity", "l_spiky", "l_extendedprice")
    return rounded(anom.anomaly_iqr(df, ["l_spiky", "l_extendedprice"]))


@register("anomaly_summary")
def q_anomaly_summary(spark, sf):
    flagged = anom.anomaly_zscore(table(spark, sf, "lineitem"), ANOMALY_FEATURES)
    return rounded(anom.anomaly_summary(flagged, "Z-Score", ANOMALY_FEATURES))


@register("remove_outliers_iqr")
def q_remove_outliers_iqr(spark, sf):
    df = lineitem_dirty(spark, sf).select("l_orderkey", "l_partkey", "l_spiky", "l_extendedprice", "l_quantity")
    return anom.remove_outliers_iqr(df, ["l_spiky", "l_extendedprice"])


# ------------------------------------------------------------------ 2.7 features

SQUARED_DIGITS = {f"{c}_squared": 2 for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}


@register("feat_polynomial")
def q_feat_polynomial(spark, sf):
    df = lineitem_features(spark, sf).drop("l_orderkey", "l_linenumber")
    return rounded(fe.feat_polynomial(df), **SQUARED_DIGITS)


@register("feat_interactions")
def q_feat_interactions(spark, sf):
    df = lineitem_features(spark, sf).drop("l_orderkey", "l_linenumber")
    return rounded(fe.feat_interactions(df))


@register("feat_bins")
def q_feat_bins(spark, sf):
    df = lineitem_features(spark, sf).drop("l_orderkey", "l_linenumber")
    return rounded(fe.feat_bins(df))


@register("feature_engineering")
def q_feature_engineering(spark, sf):
    df = lineitem_features(spark, sf).drop("l_orderkey", "l_linenumber")
    return rounded(fe.feature_engineering(df, target="l_tax"), **SQUARED_DIGITS)


@register("label_encode")
def q_label_encode(spark, sf):
    df = lineitem_missing(spark, sf).select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    return fe.label_encode(df, ["l_returnflag", "l_linestatus"])


@register("standard_scale")
def q_standard_scale(spark, sf):
    df = lineitem_features(spark, sf)
    return rounded(fe.standard_scale(df, ["l_quantity", "l_extendedprice", "l_discount"]))


@register("select_k_best")
def q_select_k_best(spark, sf):
    df = table(spark, sf, "lineitem")
    return fe.select_k_best(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"],
                            "l_linenumber", k=2, min_features=2)


@register("train_test_split")
def q_train_test_split(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return fe.train_test_split(df, ["l_orderkey", "l_linenumber"], 0.2, 42, stratify="l_returnflag")


# ------------------------------------------------------------------ 2.11 charts

@register("chart_scatter")
def q_chart_scatter(spark, sf):
    return ch.chart_scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag",
                            key_cols=["l_orderkey", "l_linenumber"]).drop("l_orderkey", "l_linenumber")


@register("chart_line")
def q_chart_line(spark, sf):
    return ch.chart_line(table(spark, sf, "events"), "ts", "value", "event_type")


@register("chart_line_bounded")
def q_chart_line_bounded(spark, sf):
    return ch.chart_line(table(spark, sf, "events"), "ts", "value", "event_type", intervals=200)


@register("chart_bar")
def q_chart_bar(spark, sf):
    return rounded(ch.chart_bar(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus"), 2)


@register("chart_histogram")
def q_chart_histogram(spark, sf):
    return rounded(ch.chart_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20), 4)


@register("chart_box")
def q_chart_box(spark, sf):
    return rounded(ch.chart_box(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"), 6)


@register("chart_box_null_groups")
def q_chart_box_null_groups(spark, sf):
    li = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")).alias("g"),
                                             F.col("l_extendedprice").alias("v"))
    return rounded(ch.chart_box(li, "v", "g"), 6)


@register("chart_violin")
def q_chart_violin(spark, sf):
    return rounded(ch.chart_violin(table(spark, sf, "lineitem"), "l_discount", "l_linestatus"))


@register("chart_pie")
def q_chart_pie(spark, sf):
    return rounded(ch.chart_pie(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 2, share=6)


@register("chart_corr_heatmap")
def q_chart_corr_heatmap(spark, sf):
    return rounded(ch.chart_corr_heatmap(table(spark, sf, "lineitem")))


@register("chart_map")
def q_chart_map(spark, sf):
    c = table(spark, sf, "customer")
    geo = c.select("c_custkey", ((F.col("c_custkey") % 180) - 90).cast("double").alias("latitude"),
                   ((F.col("c_nationkey") * 14) - 175).cast("double").alias("longitude"), "c_acctbal")
    return ch.chart_map(geo, key_cols=["c_custkey"])


@register("chart_anomaly")
def q_chart_anomaly(spark, sf):
    flagged = anom.anomaly_zscore(table(spark, sf, "lineitem"), ANOMALY_FEATURES)
    return rounded(ch.chart_anomaly(flagged, "l_quantity", "l_extendedprice"))


# ------------------------------------------------------------------ 2.10 evaluation

def _regression_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 950.0).alias("prediction"))


@register("eval_regression")
def q_eval_regression(spark, sf):
    return rounded(met.eval_regression(_regression_pairs(spark, sf), "label", "prediction"), 6,
                   mse=2, mae=4, rmse=4, median_ae=4, max_error=4)


@register("eval_residuals")
def q_eval_residuals(spark, sf):
    return rounded(met.eval_residuals(_regression_pairs(spark, sf), "label", "prediction"), 4)


@register("eval_classification")
def q_eval_classification(spark, sf):
    return rounded(met.eval_classification(labeled_documents(spark, sf), "label", "prediction"))


@register("eval_roc_auc")
def q_eval_roc_auc(spark, sf):
    return rounded(met.eval_roc_auc(labeled_documents(spark, sf), "label", "score"))


@register("eval_pr_auc")
def q_eval_pr_auc(spark, sf):
    return rounded(met.eval_pr_auc(labeled_documents(spark, sf), "label", "score"))


@register("eval_log_loss")
def q_eval_log_loss(spark, sf):
    return rounded(met.eval_log_loss(labeled_documents(spark, sf), "label", "score"))


@register("predict_vs_actual")
def q_predict_vs_actual(spark, sf):
    return rounded(met.predict_vs_actual(_regression_pairs(spark, sf), "label", "prediction"), 4)


# ------------------------------------------------------------------ 2.8 cluster metrics

@register("cluster_sizes")
def q_cluster_sizes(spark, sf):
    return rounded(clu.cluster_sizes(table(spark, sf, "customer"), "c_mktsegment"))


@register("cluster_wcss_ratio")
def q_cluster_wcss_ratio(spark, sf):
    return rounded(clu.cluster_wcss_ratio(table(spark, sf, "embeddings"), "embedding", "label"), 4)


@register("cluster_davies_bouldin")
def q_cluster_davies_bouldin(spark, sf):
    return rounded(clu.cluster_davies_bouldin(table(spark, sf, "embeddings"), "embedding", "label"))


@register("cluster_calinski_harabasz")
def q_cluster_calinski_harabasz(spark, sf):
    return rounded(clu.cluster_calinski_harabasz(table(spark, sf, "embeddings"), "embedding", "label"))


@register("cluster_silhouette")
def q_cluster_silhouette(spark, sf):
    return rounded(clu.cluster_silhouette(table(spark, sf, "embeddings"), "embedding", "label"))


@register("cluster_silhouette_squared")
def q_cluster_silhouette_squared(spark, sf):
    return rounded(clu.cluster_silhouette_squared(table(spark, sf, "embeddings"), "embedding", "label"))


@register("anomaly_isolation_forest")
def q_anomaly_isolation_forest(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ANOMALY_FEATURES)
    return anom.anomaly_isolation_forest(li, ANOMALY_FEATURES, key_cols=["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------------ 2.1 sources and sinks

from tabsense.session import scratch_path  # noqa: E402
from tabsense.sources import io as sio  # noqa: E402


@register("scan_csv")
def q_scan_csv(spark, sf):
    part = table(spark, sf, "part")
    path = sio.sink_csv(part, scratch_path(spark, "part-csv"))
    return sio.scan_csv(spark, path, schema=part.schema)


@register("scan_json")
def q_scan_json(spark, sf):
    cust = table(spark, sf, "customer")
    path = sio.sink_json(cust, scratch_path(spark, "customer-json"))
    return sio.scan_json(spark, path, schema=cust.schema, multi_line=False)


@register("scan_batch")
def q_scan_batch(spark, sf):
    li = table(spark, sf, "lineitem")
    base = scratch_path(spark, "lineitem-batch")
    li.write.partitionBy("l_returnflag").parquet(base)
    rows, _ = sio.scan_batch(spark, [base])
    folder = F.regexp_extract("source_file", r"l_returnflag=([^/]+)", 1)
    per_folder = sio.quality_by(rows.withColumn("_folder", folder).drop("source_file"), "_folder")
    return rounded(per_folder.withColumnRenamed("_folder", "l_returnflag"))


def _mixed_encodings(spark, sf) -> str:
    """Customers as CSV folders in two encodings: UTF-8 for even nations, ISO-8859-1 for odd ones."""
    base = scratch_path(spark, "customer-encodings")
    named = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" né")).alias("c_name"), "c_nationkey")
    for odd, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        named.where(F.col("c_nationkey") % 2 == odd).write.option("header", True).option("encoding", encoding) \
            .csv(f"{base}/{encoding}")
    return base


@register("scan_csv_encodings")
def q_scan_csv_encodings(spark, sf):
    base = _mixed_encodings(spark, sf)
    return sio.scan_csv(spark, [f"{base}/UTF-8", f"{base}/ISO-8859-1"], schema="c_custkey long, c_name string, c_nationkey int")


@register("batch_summary")
def q_batch_summary(spark, sf):
    base = scratch_path(spark, "lineitem-folders")
    table(spark, sf, "lineitem").write.partitionBy("l_returnflag").parquet(base)
    _, per_folder = sio.scan_batch(spark, [base], unit="folder")
    return rounded(sio.batch_summary(per_folder))


@register("load_metadata")
def q_load_metadata(spark, sf):
    return rounded(sio.load_metadata(lineitem_missing(spark, sf), "lineitem").drop("loaded_at"))


@register("sink_csv")
def q_sink_csv(spark, sf):
    li = table(spark, sf, "lineitem")
    out = flt.filter_conjunction(li, FILTER_STATE)
    path = sio.sink_csv(out, scratch_path(spark, "filtered-csv"))
    return sio.scan_csv(spark, path, schema=li.schema)


@register("sink_json")
def q_sink_json(spark, sf):
    rep = q_profile_report(spark, sf)
    path = sio.sink_json(rep, scratch_path(spark, "report-json"))
    return sio.scan_json(spark, path, schema=rep.schema, multi_line=False)


# ------------------------------------------------------------------ 2.8 / 2.9 models

from tabsense.operators import forest  # noqa: E402
from tabsense.operators import models as mdl  # noqa: E402

PART_FEATURES = ["p_size", "p_brand", "p_type"]


def _docs(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(docs, "doc_id")


@register("rf_regression")
def q_rf_regression(spark, sf):
    metrics, _, _ = mdl.random_forest(table(spark, sf, "part"), PART_FEATURES, "p_retailprice", "regression",
                                      n_trees=50, key_cols=["p_partkey"])
    return metrics


@register("rf_classification")
def q_rf_classification(spark, sf):
    metrics, _, _ = mdl.random_forest(_docs(spark, sf), ["n_chars", "lang", "source"], "quality", "classification",
                                      n_trees=50, key_cols=["doc_id"])
    return metrics


@register("feature_importance")
def q_feature_importance(spark, sf):
    prepared = mdl.prepare(table(spark, sf, "part"), PART_FEATURES, "p_retailprice", "regression", ["p_partkey"])
    return mdl.feature_importance(*mdl.fit_forest(prepared, "regression", n_trees=50))


@register("rf_tuned")
def q_rf_tuned(spark, sf):
    return mdl.rf_tuned(_docs(spark, sf), ["n_chars", "lang", "source"], "quality", "classification",
                        key_cols=["doc_id"])


@register("mlp_classification")
def q_mlp_classification(spark, sf):
    metrics, _ = mdl.mlp_classification(_docs(spark, sf), ["n_chars", "lang", "source"], "quality",
                                        key_cols=["doc_id"])
    return metrics


@register("mlp_regression")
def q_mlp_regression(spark, sf):
    metrics, _, _ = mdl.mlp_regression(table(spark, sf, "part"), PART_FEATURES, "p_retailprice",
                                       key_cols=["p_partkey"])
    return metrics


@register("model_comparison")
def q_model_comparison(spark, sf):
    return mdl.model_comparison(_docs(spark, sf), ["n_chars", "lang", "source"], "quality", "classification",
                                key_cols=["doc_id"], n_trees=50)


@register("kmeans_fit")
def q_kmeans_fit(spark, sf):
    scored, _ = clu.kmeans_fit(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], k=3, scale=True,
                               remove_outliers=True)
    return scored


@register("kmeans_elbow")
def q_kmeans_elbow(spark, sf):
    return clu.kmeans_elbow(table(spark, sf, "embeddings"), "embedding", range(2, 8))


@register("kmeans_auto_k_silhouette")
def q_kmeans_auto_k_silhouette(spark, sf):
    return clu.kmeans_auto_k_silhouette(table(spark, sf, "embeddings"), "embedding", range(2, 9))


@register("cluster_analysis")
def q_cluster_analysis(spark, sf):
    sweep, _ = clu.cluster_analysis(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return sweep


# ------------------------------------------------------------------ models with a known answer

def _separable(spark, sf, **how):
    """Three groups far apart; clusters are named by the order of their centres."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             ((F.col("l_linenumber") % 3) * 1000 + F.col("l_quantity")).alias("x"))
    rows, _ = clu.kmeans_fit(li, ["x"], 3, **how)
    order = rows.groupBy("cluster").agg(F.avg("x").alias("m")).orderBy("m").collect()  # three rows
    rank = F.create_map(*[F.lit(v) for i, r in enumerate(order) for v in (r["cluster"], i)])
    return rows.select("l_orderkey", "l_linenumber", F.element_at(rank, F.col("cluster")).alias("cluster"))


@register("kmeans_separable")
def q_kmeans_separable(spark, sf):
    return _separable(spark, sf)


@register("kmeans_mini_batch_separable")
def q_kmeans_mini_batch_separable(spark, sf):
    return _separable(spark, sf, mini_batch=True)


@register("rf_separable")
def q_rf_separable(spark, sf):
    """A label that one split decides: the forest's test metrics are perfect."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             (F.col("l_linenumber") > 3).cast("int").alias("late"))
    metrics, _, _ = mdl.random_forest(li, ["l_linenumber", "l_quantity"], "late", "classification", n_trees=15,
                                      key_cols=["l_orderkey", "l_linenumber"])
    return rounded(metrics.where(F.col("metric").isin("accuracy", "precision", "recall", "f1", "roc_auc", "cohen_kappa")))


@register("rf_deep_separable")
def q_rf_deep_separable(spark, sf):
    """The same label for a forest without a depth limit."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             (F.col("l_linenumber") > 3).cast("int").alias("late"))
    metrics, _ = mdl.random_forest_deep(li, ["l_linenumber", "l_quantity"], "late", "classification", n_trees=15, min_split=5,
                                        key_cols=["l_orderkey", "l_linenumber"])
    return rounded(metrics.where(F.col("metric").isin("accuracy", "precision", "recall", "f1", "roc_auc", "cohen_kappa")))


@register("rf_deep_recall")
def q_rf_deep_recall(spark, sf):
    """One tree without a depth limit, on all rows: every row gets the mean of the rows with its features."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("qty"))
    grown = forest.grow_forest(li, ["l_orderkey", "l_linenumber"], "qty", trees=1, bootstrap=False,
                               key_cols=["l_orderkey", "l_linenumber"])
    return rounded(grown.predict(li).select("l_orderkey", "l_linenumber", "prediction"))


@register("rf_deep_min_split")
def q_rf_deep_min_split(spark, sf):
    """One tree over the line numbers with a minimum split above every part of the table: the mean of all rows;
    with a smaller one: the mean of each number."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("qty"))
    least = li.groupBy("l_linenumber").count().agg(F.min("count")).first()[0]
    out = None
    for split in (2, li.count() + 1):
        grown = forest.grow_forest(li, ["l_linenumber"], "qty", trees=1, min_split=split, bootstrap=False,
                                   key_cols=["l_orderkey", "l_linenumber"], block_rows=max(least // 2, 1))
        part = grown.predict(li).groupBy("l_linenumber").agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n")) \
            .withColumn("split_of_two", F.lit(split == 2))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def _mlp_separable(spark, sf, late):
    """Three classes far apart: the network's test metrics are perfect."""
    k = F.col("l_linenumber") % 3
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (k * 1000 + F.col("l_quantity")).alias("x"), late(k).alias("kind"))
    metrics, _ = mdl.mlp_classification(li, ["x", "l_quantity"], "kind", key_cols=["l_orderkey", "l_linenumber"])
    return rounded(metrics.where(F.col("metric").isin("accuracy", "precision", "recall", "f1", "roc_auc", "cohen_kappa")))


@register("mlp_separable")
def q_mlp_separable(spark, sf):
    return _mlp_separable(spark, sf, lambda k: k)


@register("mlp_separable_text")
def q_mlp_separable_text(spark, sf):
    return _mlp_separable(spark, sf, lambda k: F.concat(F.lit("kind "), k.cast("string")))


@register("isolation_forest_planted")
def q_isolation_forest_planted(spark, sf):
    """Planted outliers that the Isolation Forest must flag."""
    far = F.col("l_orderkey") % 200 == 0
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *[F.when(far, F.lit(1e7)).otherwise(F.col(c).cast("double")).alias(c)
                                        for c in ("l_quantity", "l_extendedprice", "l_discount")])
    found = anom.anomaly_isolation_forest(li, ["l_quantity", "l_extendedprice", "l_discount"], contamination=0.05,
                                          key_cols=["l_orderkey", "l_linenumber"])
    return found.where(F.col("is_anomaly") & (F.col("l_quantity") == 1e7)).select("l_orderkey", "l_linenumber")
