"""Model evaluation from (label, prediction[, score]) columns.

Regression metrics are one or two aggregate passes.  Classification metrics start from the
confusion counts ``groupBy(label, prediction).count()`` (classes^2 rows, map-side combined);
ranking metrics start from the per-score histogram and use a range-partitioned running sum.
Outputs are one row per metric set, wide, so SQL twins can name every column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.ordered import cumulative_sums
from tabsense.functions.quantiles import quantile_table
from tabsense.functions.schema import is_numeric, qcol
from tabsense.functions.stats import stats_row

# Coverage multipliers of the reference's residual analysis; log-loss clip.
COVER_80 = 1.28
COVER_95 = 1.96
EPS = 2.220446049250313e-16
LOCAL_HISTOGRAM_MAX = 100_000  # score histograms up to this size are summed on the driver


def _pairs(df, label, prediction):
    return df.select(F.col(f"`{label}`").cast("double").alias("y"), F.col(f"`{prediction}`").cast("double").alias("p")) \
             .na.drop()


def _share_of(part):
    """``part`` of the label's variance; for a constant label 0 if nothing is left over, else 1."""
    return F.when(F.col("var_y") > 0, F.try_divide(part, F.col("var_y"))) \
        .when(F.col("var_y") == 0, F.when(part == 0, 0.0).otherwise(1.0))


def eval_regression(df: DataFrame, label: str, prediction: str, accuracy: int | None = None) -> DataFrame:
    """mae, mse, rmse, r2, explained_variance, median_ae, max_error (``accuracy``: approximate median)."""
    d = _pairs(df, label, prediction).withColumn("e", F.col("y") - F.col("p")).withColumn("ae", F.abs("e"))
    base = d.agg(F.avg("ae").alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"),
                 F.var_pop("y").alias("var_y"), F.var_pop("e").alias("var_e"), F.max("ae").alias("max_error"))
    med = quantile_table(d, ["ae"], [0.5], accuracy=accuracy)["ae"][0]
    return base.select(
        "mae", "mse", F.sqrt("mse").alias("rmse"),
        (F.lit(1.0) - _share_of(F.col("mse"))).alias("r2"),
        (F.lit(1.0) - _share_of(F.col("var_e"))).alias("explained_variance"),
        F.lit(med).cast("double").alias("median_ae"), "max_error")


def eval_residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAPE over nonzero labels, residual mean and population std, coverage within 1.28 and
    1.96 residual std."""
    d = _pairs(df, label, prediction).withColumn("e", F.col("y") - F.col("p"))
    row = stats_row(d, {"mean": F.avg("e"), "std": F.stddev_pop("e"),
                        "mape": F.avg(F.when(F.col("y") != 0, F.abs(F.col("e")) / F.abs(F.col("y"))))})
    s = row["std"] or 0.0
    cov = d.agg(F.avg(F.when(F.abs("e") <= F.lit(COVER_80 * s), 1.0).otherwise(0.0)).alias("coverage_80pct"),
                F.avg(F.when(F.abs("e") <= F.lit(COVER_95 * s), 1.0).otherwise(0.0)).alias("coverage_95pct"))
    return cov.select(F.lit(row["mape"]).cast("double").alias("mape"),
                      F.lit(row["mean"]).cast("double").alias("residual_mean"),
                      F.lit(row["std"]).cast("double").alias("residual_std"), "coverage_80pct", "coverage_95pct")


def class_key(df: DataFrame, *columns: str):
    """How classes of these columns compare: as numbers if all are numeric, else as text."""
    if all(is_numeric(df.schema[c].dataType) for c in columns):
        return lambda c: qcol(c).cast("double").cast("string")
    return lambda c: qcol(c).cast("string")


def _class_text(df: DataFrame, label: str, value) -> str:
    """A class given by the caller, in the form of :func:`class_key`."""
    if is_numeric(df.schema[label].dataType):
        return df.sparkSession.range(1).select(F.lit(float(value)).cast("string")).first()[0]
    return str(value)


def _require_class(df: DataFrame, label: str, value) -> str:
    """The class's text; an error if no row has it (a table without labels has none to miss)."""
    text = _class_text(df, label, value)
    key = class_key(df, label)(label)
    seen = df.agg(F.count(key).alias("n"), F.count(F.when(key == text, 1)).alias("hits")).first()
    if seen["n"] and not seen["hits"]:
        raise ValueError(f"class {value!r} isn't among the values of {label!r}")
    return text


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    key = class_key(df, label, prediction)
    return df.select(key(label).alias("y"), key(prediction).alias("p")) \
             .na.drop().groupBy("y", "p").agg(F.count(F.lit(1)).cast("double").alias("n"))


def eval_classification(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """accuracy, weighted precision / recall / f1 (0 when undefined), balanced accuracy,
    MCC (multiclass), Cohen kappa."""
    cm = confusion_counts(df, label, prediction)
    true_n = cm.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("t"))
    pred_n = cm.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("q"))
    diag = cm.where(F.col("y") == F.col("p")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    per = true_n.join(pred_n, "c", "full").join(diag, "c", "left").na.fill(0.0, ["t", "q", "tp"])
    prec = F.when(F.col("q") > 0, F.col("tp") / F.col("q")).otherwise(0.0)
    rec = F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    per = per.select("c", "t", "q", "tp", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    agg = per.agg(F.sum("t").alias("s"), F.sum("tp").alias("c"),
                  F.sum(F.col("t") * F.col("prec")).alias("wp"), F.sum(F.col("t") * F.col("rec")).alias("wr"),
                  F.sum(F.col("t") * F.col("f1")).alias("wf"),
                  F.avg(F.when(F.col("t") > 0, F.col("rec"))).alias("balanced_accuracy"),
                  F.sum(F.col("t") * F.col("q")).alias("pt"), F.sum(F.col("q") * F.col("q")).alias("pp"),
                  F.sum(F.col("t") * F.col("t")).alias("tt"))
    mcc_den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    pe = F.col("pt") / (F.col("s") * F.col("s"))
    po = F.col("c") / F.col("s")
    return agg.select(
        po.alias("accuracy"), (F.col("wp") / F.col("s")).alias("precision"),
        (F.col("wr") / F.col("s")).alias("recall"), (F.col("wf") / F.col("s")).alias("f1"),
        "balanced_accuracy",
        F.when(mcc_den > 0, (F.col("c") * F.col("s") - F.col("pt")) / mcc_den).otherwise(0.0).alias("mcc"),
        F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(0.0).alias("cohen_kappa"))


def _score_histogram(df, label, score, positive):
    y = (class_key(df, label)(label) == F.lit(_require_class(df, label, positive))).cast("double")
    return df.select(y.alias("pos"), F.col(f"`{score}`").cast("double").alias("s")).na.drop() \
             .groupBy("s").agg(F.sum("pos").alias("npos"), F.sum(1 - F.col("pos")).alias("nneg"))


def _local_histogram(h: DataFrame):
    """The score histogram as arrays when it has at most LOCAL_HISTOGRAM_MAX rows (the bounded
    probe proves the size), else None."""
    rows = h.limit(LOCAL_HISTOGRAM_MAX + 1).collect()
    if len(rows) > LOCAL_HISTOGRAM_MAX:
        return None
    rows.sort(key=lambda r: r["s"])
    return (np.array([r["s"] for r in rows], dtype=float), np.array([r["npos"] for r in rows], dtype=float),
            np.array([r["nneg"] for r in rows], dtype=float))


def _binary_auc(df, label, score, positive):
    """(auc, P): tie-exact rank-sum AUC from the per-score histogram."""
    h = _score_histogram(df, label, score, positive)
    local = _local_histogram(h)
    if local is not None:
        _, npos, nneg = local
        P, N = float(npos.sum()), float(nneg.sum())
        below = np.cumsum(nneg) - nneg  # negatives with a strictly lower score
        auc = float((npos * (below + 0.5 * nneg)).sum() / (P * N)) if P > 0 and N > 0 else None
        return auc, P
    c = cumulative_sums(h, "s", ["nneg"])  # ascending: negatives with score <= s
    r = c.agg(F.sum(F.col("npos") * (F.col("cum_nneg") - F.col("nneg") + 0.5 * F.col("nneg"))).alias("u"),
              F.sum("npos").alias("P"), F.sum("nneg").alias("N")).first()
    P, N = r["P"] or 0.0, r["N"] or 0.0
    return (r["u"] / (P * N) if P > 0 and N > 0 else None), P


def eval_roc_auc(df: DataFrame, label: str, score_cols, positive=1) -> DataFrame:
    """ROC AUC, exact with ties (rank-sum).  ``score_cols`` is one score column (binary,
    positive class ``positive``) or a dict {class: score column} for one-vs-rest weighted."""
    spark = df.sparkSession
    if isinstance(score_cols, str):
        auc, _ = _binary_auc(df, label, score_cols, positive)
    else:
        parts = [_binary_auc(df, label, col, cls) for cls, col in score_cols.items()]
        total = sum(p for _, p in parts)
        auc = sum(a * p for a, p in parts if a is not None) / total if total else None
    return spark.createDataFrame([(auc,)], "roc_auc double")


def eval_pr_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Average precision: sum over descending score thresholds of (R_k - R_{k-1}) * P_k."""
    spark = df.sparkSession
    h = _score_histogram(df, label, score, positive)
    local = _local_histogram(h)
    if local is not None:
        _, npos, nneg = local
        npos, nneg = npos[::-1], nneg[::-1]  # descending scores
        total = float(npos.sum())
        tp, fp = np.cumsum(npos), np.cumsum(nneg)
        ap = float(np.where(npos > 0, npos / total * (tp / (tp + fp)), 0.0).sum()) if total > 0 else None
        return spark.createDataFrame([(ap,)], "pr_auc double")
    c = cumulative_sums(h, "s", ["npos", "nneg"], descending=True)
    total = stats_row(h, {"P": F.sum("npos")})["P"] or 0.0
    prec = F.col("cum_npos") / (F.col("cum_npos") + F.col("cum_nneg"))
    return c.agg(F.sum(F.when(F.col("npos") > 0, F.col("npos") / F.lit(total) * prec).otherwise(0.0))
                 .alias("pr_auc")).select(F.when(F.lit(total) > 0, F.col("pr_auc")).alias("pr_auc"))


def eval_log_loss(df: DataFrame, label: str, prob_cols, positive=1) -> DataFrame:
    """Mean -ln p(true class), p clipped to [eps, 1 - eps].  ``prob_cols``: one column holding
    P(positive) (binary) or {class: probability column}."""
    y = class_key(df, label)(label)
    if isinstance(prob_cols, str):
        p1 = F.col(f"`{prob_cols}`").cast("double")
        pt = F.when(y == F.lit(_require_class(df, label, positive)), p1).otherwise(1 - p1)
    else:
        pt = None
        for cls, col in prob_cols.items():
            term = F.when(y == F.lit(_class_text(df, label, cls)), F.col(f"`{col}`").cast("double"))
            pt = term if pt is None else F.coalesce(pt, term)
    clipped = F.least(F.greatest(pt, F.lit(EPS)), F.lit(1 - EPS))
    return df.agg(F.avg(-F.log(clipped)).alias("log_loss"))


def predict_vs_actual(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, trend): OLS line of predicted on actual."""
    d = _pairs(df, label, prediction)
    row = stats_row(d, {"slope": F.regr_slope("p", "y"), "intercept": F.regr_intercept("p", "y")})
    return d.select(F.col("y").alias("actual"), F.col("p").alias("predicted"),
                    (F.lit(row["intercept"]) + F.lit(row["slope"]) * F.col("y")).alias("trend"),
                    F.lit(row["slope"]).cast("double").alias("slope"),
                    F.lit(row["intercept"]).cast("double").alias("intercept"))


def metrics_long(wide: DataFrame, model: str) -> DataFrame:
    """One metrics row -> (model, metric, value)."""
    cols = wide.columns
    return wide.select(F.explode(F.array(*[F.struct(F.lit(model).alias("model"), F.lit(c).alias("metric"),
                                                    qcol(c).cast("double").alias("value")) for c in cols]))
                       .alias("_m")).select("_m.*")
