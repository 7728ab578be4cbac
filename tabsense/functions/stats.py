"""Column expressions and small statistics helpers shared by the operators.

Everything here is a JVM-side expression or one aggregate pass; the only values that reach
the driver are one statistics row (a fixed number of doubles per column).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.functions.schema import is_float, qcol


def col(c) -> Column:
    return qcol(c) if isinstance(c, str) else c


def nan_to_null(c, dtype=None) -> Column:
    """NaN and +/-inf become NULL (Spark NaN is not NULL and sorts greatest)."""
    x = col(c)
    if dtype is not None and not is_float(dtype):
        return x
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode raises on /0 otherwise)."""
    return F.try_divide(col(a), col(b))


def sample_skewness(c) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``skew``, DuckDB ``skewness``)."""
    x = col(c)
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurtosis``, DuckDB ``kurtosis``)."""
    x = col(c)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def count_if(pred: Column) -> Column:
    return F.sum(F.when(pred, 1).otherwise(0)).cast("long")


def any_of(preds) -> Column:
    preds = list(preds)
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def all_of(preds) -> Column:
    preds = list(preds)
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def greatest_of(cols) -> Column:
    cols = list(cols)
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def least_of(cols) -> Column:
    cols = list(cols)
    return cols[0] if len(cols) == 1 else F.least(*cols)


# Whole-stage codegen is disabled for an aggregate whose buffer exceeds
# spark.sql.codegen.maxFields (default 100 fields).  Common aggregates keep 1-3 buffer fields
# (sum/count/min/max 1, avg 2, stddev/variance 3), so up to this many expressions share a pass.
STATS_EXPRS_PER_PASS = 30


def stats_row(df: DataFrame, exprs: dict[str, Column], per_pass: int = STATS_EXPRS_PER_PASS) -> dict:
    """Run aggregate passes and return their single row as a dict (bounded: one value per expr).

    Expressions are split into passes of ``per_pass`` in the given order; callers list them
    column by column, so each pass reads only its own columns (same I/O as one wide pass) while
    every pass stays inside whole-stage codegen.
    """
    if not exprs:
        return {}
    items = list(exprs.items())
    out: dict = {}
    for i in range(0, len(items), per_pass):
        chunk = items[i:i + per_pass]
        row = df.agg(*[e.alias(k) for k, e in chunk]).first()
        out.update(row.asDict() if row is not None else {k: None for k, _ in chunk})
    return out


def unpivot(df: DataFrame, ids: list[str], columns: list[str], var: str = "column",
            value: str = "value", cast: str | None = "double") -> DataFrame:
    """Wide -> long with ``stack`` semantics (one output row per input row and column)."""
    vals = [(qcol(c).cast(cast) if cast else qcol(c)).alias(c) for c in columns]
    wide = df.select(*[qcol(i) for i in ids], *vals)
    return wide.unpivot(ids, columns, var, value)


SUMS_PER_PASS = 90  # plain sums keep one buffer field each


def _sum_passes(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Sum-like aggregates (one buffer field each) in passes narrow enough for codegen."""
    return stats_row(df, exprs, per_pass=SUMS_PER_PASS)


def central_moments(df: DataFrame, cols) -> dict:
    """Per column: n, mean and central sums M2, M3, M4 from two narrow passes.

    Pass 1: count and sum.  Pass 2: sums of d, d^2, d^3, d^4 with d = x - mean (centering keeps
    the power sums accurate); the exact central sums follow by the binomial shift identities.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    first = _sum_passes(df, {k: e for c in cols for k, e in ((f"n|{c}", F.count(x[c])), (f"s|{c}", F.sum(x[c])))})
    means = {c: (first[f"s|{c}"] / first[f"n|{c}"]) if first[f"n|{c}"] else None for c in cols}
    second = {}
    for c in cols:
        if means[c] is None:
            continue
        d = x[c] - F.lit(means[c])
        second.update({f"1|{c}": F.sum(d), f"2|{c}": F.sum(d * d), f"3|{c}": F.sum(d * d * d),
                       f"4|{c}": F.sum(d * d * d * d)})
    sums = _sum_passes(df, second) if second else {}
    out = {}
    for c in cols:
        n = first[f"n|{c}"] or 0
        if not n:
            out[c] = {"n": 0, "mean": None, "m2": None, "m3": None, "m4": None}
            continue
        s1, s2, s3, s4 = (sums[f"{k}|{c}"] for k in (1, 2, 3, 4))
        m2 = s2 - s1 * s1 / n
        m3 = s3 - 3 * s1 * s2 / n + 2 * s1 ** 3 / n ** 2
        m4 = s4 - 4 * s1 * s3 / n + 6 * s1 * s1 * s2 / n ** 2 - 3 * s1 ** 4 / n ** 3
        # the reported mean is sum / n (what ``avg`` returns); s1 only corrects the central sums
        out[c] = {"n": n, "mean": means[c], "m2": max(m2, 0.0), "m3": m3, "m4": m4}
    return out


def describe_moments(m: dict) -> dict:
    """std (sample), population std, bias-corrected skewness G1 and excess kurtosis G2 (pandas /
    DuckDB conventions) from ``central_moments`` output."""
    n, m2, m3, m4 = m["n"], m["m2"], m["m3"], m["m4"]
    out = {"mean": m["mean"], "std": None, "std_pop": None, "skewness": None, "kurtosis": None}
    if not n:
        return out
    out["std_pop"] = (m2 / n) ** 0.5
    if n > 1:
        out["std"] = (m2 / (n - 1)) ** 0.5
    if m2 > 0:
        g1 = (n ** 0.5) * m3 / m2 ** 1.5
        g2 = n * m4 / (m2 * m2) - 3.0
        if n > 2:
            out["skewness"] = g1 * (n * (n - 1)) ** 0.5 / (n - 2)
        if n > 3:
            out["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return out
