"""Filters and predicates.

Predicates are built as Spark ``Column`` expressions, so Catalyst pushes them into the
parquet scan (row-group skipping) and prunes columns; nothing is sampled first.
"""

from __future__ import annotations

import json
import math
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabsense.functions.ordered import cumulative_sums
from tabsense.functions.schema import categorical_columns, is_numeric, numeric_columns, qcol, require_columns
from tabsense.functions.stats import all_of, count_if

NULL_LIKE = ("nan", "none", "null")
TRUE_TEXT = ("true", "1", "yes", "t", "y")
FILTER_PREFIX = "filter_"
COMPARE_OPS = {"equals": "=", "equal": "=", "=": "=", ">": ">", "<": "<", ">=": ">=", "<=": "<="}


def _is_null_like(v) -> bool:
    if v is None:
        return True
    if isinstance(v, float) and math.isnan(v):
        return True
    return str(v).lower() in NULL_LIKE


def in_predicate(column: str, values, dtype: T.DataType | None = None) -> Column:
    """Membership in all of ``values``; a null-like value also matches NULL.

    Values are compared as text, or as booleans for a boolean column.
    """
    vals = list(values)
    keep = [v for v in vals if not _is_null_like(v)]
    if isinstance(dtype, T.BooleanType):
        wanted = [v if isinstance(v, bool) else str(v).lower() in TRUE_TEXT for v in keep]
    else:
        wanted = [str(v) for v in keep]
    pred = qcol(column).isin(wanted) if wanted else F.lit(False)
    if len(keep) < len(vals):
        pred = pred | qcol(column).isNull()
    return pred


def range_predicate(column: str, lo, hi) -> Column | None:
    """BETWEEN lo AND hi; None (no filter) when a bound is missing or lo == hi."""
    if lo is None or hi is None or _is_null_like(lo) or _is_null_like(hi) or lo == hi:
        return None
    return qcol(column).between(F.lit(lo), F.lit(hi))


def _ts(v, dtype=None):
    target = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else \
        "date" if isinstance(dtype, T.DateType) else "timestamp"
    if isinstance(v, (datetime, date)):
        return F.lit(v).cast(target)
    return F.lit(str(v)).cast(target)


def datetime_predicate(column: str, start, end, dtype=None) -> Column:
    c = qcol(column)
    return (c >= _ts(start, dtype)) & (c <= _ts(end, dtype))


def filter_in(df: DataFrame, column: str, values) -> DataFrame:
    require_columns(df, [column])
    return df.where(in_predicate(column, values, df.schema[column].dataType))


def filter_range(df: DataFrame, column: str, lo, hi) -> DataFrame:
    require_columns(df, [column])
    pred = range_predicate(column, lo, hi)
    return df if pred is None else df.where(pred)


def filter_datetime_range(df: DataFrame, column: str, start, end) -> DataFrame:
    require_columns(df, [column])
    return df.where(datetime_predicate(column, start, end, df.schema[column].dataType))


def _entry_predicate(df: DataFrame, column: str, value) -> Column | None:
    """The predicate of one filter entry, chosen by the column's type; None if it doesn't filter."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None if value is None else datetime_predicate(column, value[0], value[1], dtype)
    if is_numeric(dtype):
        return None if value is None else range_predicate(column, value[0], value[1])
    return in_predicate(column, value, dtype) if value else None


def conjunction_predicate(df: DataFrame, state, columns=None) -> Column:
    """AND of every filter in a JSON / dict state ``{"filter_<col>": values | [lo, hi]}``.

    ``columns`` restricts the state to some columns; by default every entry counts.
    """
    if isinstance(state, str):
        state = json.loads(state) if state else {}
    entries = {k[len(FILTER_PREFIX):]: v for k, v in state.items() if k.startswith(FILTER_PREFIX)}
    require_columns(df, list(entries))
    preds = (_entry_predicate(df, c, v) for c, v in entries.items() if columns is None or c in columns)
    return all_of([p for p in preds if p is not None])


def filter_conjunction(df: DataFrame, state, columns=None) -> DataFrame:
    return df.where(conjunction_predicate(df, state, columns))


def _number(value, dtype: T.DataType) -> Column:
    """The value in the column's own type where that is exact (integers, decimals), else as a double."""
    exact = Decimal(str(value))
    if isinstance(dtype, (T.IntegralType, T.DecimalType)) and exact.is_finite():
        whole = exact == exact.to_integral_value()
        if whole and -2 ** 63 <= exact < 2 ** 63:
            return F.lit(int(exact))
        return F.lit(exact)
    return F.lit(float(value))


def compare_predicate(df: DataFrame, column: str, op: str, value) -> Column:
    require_columns(df, [column])
    sym = COMPARE_OPS.get(str(op).lower())
    if sym is None:
        raise ValueError(f"unsupported operator {op!r}; use one of {sorted(COMPARE_OPS)}")
    dtype = df.schema[column].dataType
    c = qcol(column)
    v = _number(value, dtype) if is_numeric(dtype) else F.lit(str(value))
    return {"=": c == v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[sym]


def filter_compare(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Single ``column op value``; for numeric columns the value is a number, compared exactly."""
    return df.where(compare_predicate(df, column, op, value))


def filter_reduction(df: DataFrame, predicate: Column) -> DataFrame:
    """Input rows, kept rows and % reduction in one aggregate pass."""
    total = F.count(F.lit(1))
    kept = count_if(predicate)
    return df.agg(total.alias("total_rows"), kept.alias("kept_rows")).select(
        "total_rows", "kept_rows",
        F.when(F.col("total_rows") > 0,
               F.round((1 - F.col("kept_rows") / F.col("total_rows")) * 100, 4)).alias("reduction_pct"))


def filter_options(df: DataFrame, categorical_cols=None, numeric_cols=None,
                   many_threshold: int | None = None, cap: int = 20) -> DataFrame:
    """Filter widget options: sorted distinct values per categorical column, [min, max] per
    numeric column.

    All values are returned unless the caller sets ``many_threshold``: then a column with more
    distinct values shows its first ``cap`` (a partial window group limit).  All categorical
    columns go through one unpivot + distinct; positions come from a range-partitioned running
    count, so no task holds a whole column.
    Output: (column, kind, pos, str_value, num_value).
    """
    cats = list(categorical_cols if categorical_cols is not None else categorical_columns(df))
    nums = list(numeric_cols if numeric_cols is not None else numeric_columns(df))
    out = None
    if cats:
        parts = [F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("v")) for c in cats]
        pairs = (df.select(F.explode(F.array(*parts)).alias("_kv"))
                   .select("_kv.column", "_kv.v").where(F.col("v").isNotNull()).distinct())
        if many_threshold is None:
            counted = cumulative_sums(pairs.withColumn("_one", F.lit(1)), ["column", "v"], ["_one"])
            firsts = counted.groupBy("column").agg(F.min("cum__one").alias("_first"))
            limited = counted.join(F.broadcast(firsts), "column") \
                .withColumn("pos", F.col("cum__one") - F.col("_first") + 1)  # firsts: a row per column
        else:
            ndv = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("ndv"))
            w = Window.partitionBy("column").orderBy("v")
            ranked = pairs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= many_threshold + 1)
            # ndv has one row per categorical column: bounded by the schema, safe to broadcast
            limited = ranked.join(F.broadcast(ndv), "column").where(
                (F.col("ndv") <= many_threshold) | (F.col("pos") <= cap))
        out = limited.select("column", F.lit("value").alias("kind"), F.col("pos").cast("long").alias("pos"),
                             F.col("v").alias("str_value"), F.lit(None).cast("double").alias("num_value"))
    if nums:
        aggs = []
        for c in nums:
            aggs += [F.min(qcol(c).cast("double")).alias(f"min__{c}"), F.max(qcol(c).cast("double")).alias(f"max__{c}")]
        mm = df.agg(*aggs)
        parts = []
        for c in nums:
            parts += [F.struct(F.lit(c).alias("column"), F.lit("min").alias("kind"), F.lit(1).cast("long").alias("pos"),
                               F.lit(None).cast("string").alias("str_value"), F.col(f"min__{c}").alias("num_value")),
                      F.struct(F.lit(c).alias("column"), F.lit("max").alias("kind"), F.lit(2).cast("long").alias("pos"),
                               F.lit(None).cast("string").alias("str_value"), F.col(f"max__{c}").alias("num_value"))]
        numeric = mm.select(F.explode(F.array(*parts)).alias("_o")).select("_o.*")
        out = numeric if out is None else out.unionByName(numeric)
    if out is None:
        raise ValueError("no columns to build options for")
    return out


def dropna_rows(df: DataFrame, subset=None, target: str | None = None) -> DataFrame:
    """Drop rows null in any of ``subset`` (features) and rows with a null ``target``."""
    cols = list(subset) if subset else list(df.columns)
    if target:
        cols = cols + [target]
    require_columns(df, cols)
    return df.na.drop(how="any", subset=cols)
