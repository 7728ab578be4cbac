"""Aggregation, profiling and statistics.

Scale rules: one aggregate pass covers all columns (never a job per column); multi-column
distinct/mode/top-k work goes through one unpivot to (column, value) followed by group-bys,
so a hot value is collapsed by map-side combine; per-column "first k" cuts use
``row_number() <= k`` (planned as a partial window group limit).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabsense.functions.fingerprints import duplicate_count
from tabsense.functions.hitters import frequent_values
from tabsense.functions.quantiles import quantile_table, quantiles
from tabsense.functions.schema import (categorical_columns, dtype_name, is_numeric, numeric_columns, qcol,
                                       require_columns)
from tabsense.functions.stats import central_moments, count_if, describe_moments, stats_row

# Fixed values of the reference's profile rules.
HIGH_MISSING_SHARE = 0.5
HIGH_CORR = 0.8
REPORTED_CORR = 0.7
MIXED_SAMPLE_NOTE = "all rows"
QUALITY_BANDS = ((80.0, "Green"), (60.0, "Yellow"))

# The reference's insight and quality-issue message formats.
MSG_HIGH_CORR = "High correlation: {a} ↔ {b} ({r:.3f})"
MSG_NO_CORR = "No strong correlations found"
MSG_HIGH_MISSING = "High missing data: {cols} (>50%)"
MSG_NUMERIC = "Dataset contains {n} numeric features suitable for ML"
MSG_MISSING_FLAG = "Missing data detected - auto-cleaning suggestions available"
MSG_BASIC = "Basic analysis completed"
ISSUE_HIGH_MISSING = "High missing data (>50%): {cols}"
ISSUE_DUPLICATES = "Duplicate rows: {n:,} ({pct:.1f}%)"
ISSUE_MIXED = "Mixed data types: {cols}"

# Type-detection patterns shared with the SQL oracle (Java regex and RE2 agree on them).
INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE_PATTERN = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\s*$"


def _q(c: str) -> str:
    return "`" + str(c).replace("`", "``") + "`"


def _long_values(df: DataFrame, cols, cast: str = "string") -> DataFrame:
    """One pass unpivot to (column, v); nulls kept."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(_q(c)).cast(cast).alias("v")) for c in cols]
    return df.select(F.explode(F.array(*parts)).alias("_kv")).select("_kv.column", "_kv.v")


def _join_null_safe(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    def col(df, k):
        return df[f"`{k}`"]

    cond = reduce(lambda x, y: x & y, [col(a, k).eqNullSafe(col(b, k)) for k in keys])
    return a.join(b, cond).select(*[col(a, k) for k in keys],
                                  *[col(a, c) for c in a.columns if c not in keys],
                                  *[col(b, c) for c in b.columns if c not in keys])


# ----------------------------------------------------------------------------- aggregates

def agg_basic(df: DataFrame, by, value: str, accuracy: int | None = None) -> DataFrame:
    """mean, sum, median, count, min, max of ``value`` per group of ``by``."""
    by = [by] if isinstance(by, str) else list(by)
    require_columns(df, by + [value])
    v = qcol(value).cast("double")
    base = df.groupBy(*[qcol(b).alias(b) for b in by]).agg(F.avg(v).alias("mean"), F.sum(v).alias("sum"),
                               F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))
    med = quantiles(df, [value], [0.5], by=by, accuracy=accuracy).select(*[qcol(b) for b in by], F.col("quantile").alias("median"))
    return _join_null_safe(base, med, by).select(*[qcol(b) for b in by], "mean", "sum", "median", "count", "min", "max")


def describe_all(df: DataFrame, columns=None, digits: int = 3, accuracy: int | None = None) -> DataFrame:
    """pandas ``describe(include='all')`` as a long table (column, stat, num_value, str_value).

    Numeric: count, mean, std, min, 25%, 50%, 75%, max.  String: count, unique, top, freq.
    """
    cols = list(columns) if columns else list(df.columns)
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    cats = [c for c in categorical_columns(df) if c in cols]
    out = []
    if nums:
        moments = central_moments(df, nums)
        mm = stats_row(df, {k: e for c in nums for k, e in ((f"min|{c}", F.min(F.col(_q(c)).cast("double"))),
                                                             (f"max|{c}", F.max(F.col(_q(c)).cast("double"))))})
        row = {}
        for c in nums:
            d = describe_moments(moments[c])
            row.update({f"count|{c}": float(moments[c]["n"]), f"mean|{c}": d["mean"], f"std|{c}": d["std"],
                        f"min|{c}": mm[f"min|{c}"], f"max|{c}": mm[f"max|{c}"]})
        qt = quantile_table(df, nums, [0.25, 0.5, 0.75], accuracy=accuracy)
        recs = []
        for c in nums:
            q = qt[c]
            for stat, val in (("count", row[f"count|{c}"]), ("mean", row[f"mean|{c}"]), ("std", row[f"std|{c}"]),
                              ("min", row[f"min|{c}"]), ("25%", q[0]), ("50%", q[1]), ("75%", q[2]),
                              ("max", row[f"max|{c}"])):
                recs.append((c, stat, None if val is None else float(val), None))
        out.append(df.sparkSession.createDataFrame(
            recs, "column string, stat string, num_value double, str_value string"))
    if cats:
        counts = _long_values(df, cats).where(F.col("v").isNotNull()).groupBy("column", "v") \
            .agg(F.count(F.lit(1)).alias("freq"))
        per_col = counts.groupBy("column").agg(F.sum("freq").cast("double").alias("count"),
                                               F.count(F.lit(1)).cast("double").alias("unique"))
        w = Window.partitionBy("column").orderBy(F.desc("freq"), F.asc("v"))
        top = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1") \
            .select("column", F.col("v").alias("top"), F.col("freq").cast("double").alias("freq"))
        merged = per_col.join(top, "column", "left")
        stacked = merged.select("column", F.explode(F.array(
            F.struct(F.lit("count").alias("stat"), F.col("count").alias("num_value"), F.lit(None).cast("string").alias("str_value")),
            F.struct(F.lit("unique").alias("stat"), F.col("unique").alias("num_value"), F.lit(None).cast("string").alias("str_value")),
            F.struct(F.lit("top").alias("stat"), F.lit(None).cast("double").alias("num_value"), F.col("top").alias("str_value")),
            F.struct(F.lit("freq").alias("stat"), F.col("freq").alias("num_value"), F.lit(None).cast("string").alias("str_value")),
        )).alias("_s")).select("column", "_s.*")
        out.append(stacked)
    if not out:
        raise ValueError("nothing to describe")
    res = reduce(lambda a, b: a.unionByName(b), out)
    return res.withColumn("num_value", F.round("num_value", digits))


def value_counts_top(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Top-n values by frequency (ties by value ascending), by summaries and a recount (see ``hitters``)."""
    require_columns(df, [column])
    found, unproven = frequent_values(df, [column], n)
    dtype = df.schema[column].dataType
    schema = T.StructType([T.StructField(column, dtype), T.StructField("count", T.LongType(), False)])
    if unproven:
        counts = df.where(qcol(column).isNotNull()).groupBy(qcol(column).alias(column)).agg(F.count(F.lit(1)).alias("count"))
    else:
        counts = df.sparkSession.createDataFrame(found[column], schema)  # the winners and their ties
    return counts.orderBy(F.desc("count"), qcol(column).asc()).limit(n)


def _missing_row(df: DataFrame) -> tuple[dict, int]:
    exprs = {f"m|{c}": count_if(F.col(_q(c)).isNull()) for c in df.columns}
    exprs["__rows"] = F.count(F.lit(1))
    row = stats_row(df, exprs)
    return row, int(row["__rows"] or 0)


def missing_by_column(df: DataFrame) -> DataFrame:
    """Null count and % per column (aggregate passes of one counter per column, then one row
    per column built from that bounded result)."""
    cols = list(df.columns)
    row = stats_row(df, {"__rows": F.count(F.lit(1)), **{f"m|{c}": count_if(qcol(c).isNull()) for c in cols}},
                    per_pass=90)
    n = row["__rows"] or 0
    recs = [(c, i, int(row[f"m|{c}"] or 0), (row[f"m|{c}"] or 0) * 100.0 / n if n else None)
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(recs, "column string, position int, missing_count long, missing_pct double")


def missing_total(df: DataFrame) -> DataFrame:
    """Total missing cells and their share of all cells."""
    n_cols = len(df.columns)
    cells = reduce(lambda a, b: a + b, [F.col(_q(c)).isNull().cast("long") for c in df.columns])
    return df.agg(F.sum(cells).alias("missing_cells"), F.count(F.lit(1)).alias("rows")).select(
        F.coalesce("missing_cells", F.lit(0)).cast("long").alias("missing_cells"),
        (F.col("rows") * n_cols).cast("long").alias("total_cells"),
        F.when(F.col("rows") > 0, F.coalesce("missing_cells", F.lit(0)) * 100.0 / (F.col("rows") * n_cols))
         .alias("missing_pct"))


def high_missing_columns(df: DataFrame, share: float = HIGH_MISSING_SHARE, limit: int | None = None) -> DataFrame:
    """Columns with more than ``share`` nulls, in column order (the first ``limit`` if given)."""
    high = missing_by_column(df).where(F.col("missing_pct") > share * 100).orderBy("position")
    return (high if limit is None else high.limit(limit)).select("column", "missing_count", "missing_pct")


def duplicate_rows(df: DataFrame, subset=None) -> DataFrame:
    """Rows minus distinct rows (nulls compare equal), with total rows.

    Fingerprints of the rows are counted first; whole rows are compared only where one occurs again.
    """
    cols = list(subset) if subset else list(df.columns)
    n, rows = duplicate_count(df, cols)
    return df.sparkSession.createDataFrame([(n, rows)], "duplicate_rows long, total_rows long")


def value_kind(c) -> "F.Column":
    """int / float / date / text kind of a string value by the shared patterns."""
    s = F.col(_q(c)) if isinstance(c, str) else c
    return (F.when(s.rlike(INT_PATTERN), "int").when(s.rlike(FLOAT_PATTERN), "float")
             .when(s.rlike(DATE_PATTERN), "date").otherwise("text"))


def mixed_type_columns(df: DataFrame, columns=None) -> DataFrame:
    """String columns whose non-null values fall in more than one kind (int/float/date/text).

    One projection classifies every value once (at most three pattern tests); one aggregate
    counts the kinds for all columns.
    """
    cats = list(columns) if columns else categorical_columns(df)
    kinds_all = ("int", "float", "date", "text")
    if not cats:
        return df.sparkSession.createDataFrame([], "column string, n_int long, n_float long, n_date long, "
                                                   "n_text long, n_kinds int")
    classified = df.select(*[F.when(qcol(c).isNotNull(), value_kind(qcol(c))).alias(f"k{i}")
                             for i, c in enumerate(cats)])
    aggs = [count_if(F.col(f"k{i}") == kind).alias(f"{kind}|{i}") for i in range(len(cats)) for kind in kinds_all]
    wide = classified.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                        *[F.col(f"`{kind}|{i}`").alias(f"n_{kind}") for kind in kinds_all])
                               for i, c in enumerate(cats)]))
    long = wide.select(rows.alias("_r")).select("_r.*")
    n_kinds = sum((F.col(f"n_{k}") > 0).cast("int") for k in kinds_all)
    return long.withColumn("n_kinds", n_kinds).where(F.col("n_kinds") > 1)


def distinct_counts(df: DataFrame, columns, approx: bool = False) -> DataFrame:
    """(column, unique_count, non_null) for each column, from one unpivot to ``(column, value)``.

    Values are counted by their text, so all columns share one aggregation and partial sums
    collapse a hot value before the shuffle.  ``approx`` uses one HyperLogLog sketch a column.
    """
    cols = list(columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(cols)],
                      *[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(cols)])
        return wide.select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(f"d{i}").alias("unique_count"), F.col(f"n{i}").alias("non_null"))
            for i, c in enumerate(cols)])).alias("_r")).select("_r.*")
    counts = _long_values(df, cols).where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("non_null"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return every.join(F.broadcast(found), "column", "left").na.fill(0, ["unique_count", "non_null"])  # a row per column


def nunique_ratio(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """Distinct count, non-null count and distinct / non-null per column."""
    cols = list(columns) if columns else list(df.columns)
    return distinct_counts(df, cols, approx).withColumn(
        "unique_ratio", F.when(F.col("non_null") > 0, F.col("unique_count") / F.col("non_null")))


def column_preview(df: DataFrame, max_cols: int | None = None, with_samples: bool = False, n_samples: int = 3, approx: bool = False,
                   sample_rows_n: int = 50, key_cols=None) -> DataFrame:
    """Per column (all, or the first ``max_cols``): dtype, missing count/%, unique count, mean/std if numeric.

    ``with_samples`` adds up to ``n_samples`` non-null values taken from a seeded hash sample.
    """
    cols = list(df.columns)[:max_cols]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        x = F.col(_q(c))
        aggs.append(count_if(x.isNull()).alias(f"m|{c}"))
        if is_numeric(df.schema[c].dataType):
            aggs += [F.avg(x.cast("double")).alias(f"a|{c}"), F.stddev_samp(x.cast("double")).alias(f"s|{c}")]
    wide = df.agg(*aggs)
    structs = []
    for c in cols:
        num = is_numeric(df.schema[c].dataType)
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(dtype_name(df.schema[c].dataType)).alias("dtype"),
            F.col(f"`m|{c}`").cast("long").alias("missing_count"),
            F.when(F.col("__rows") > 0, F.col(f"`m|{c}`") * 100.0 / F.col("__rows")).alias("missing_pct"),
            (F.col(f"`a|{c}`") if num else F.lit(None).cast("double")).alias("mean"),
            (F.col(f"`s|{c}`") if num else F.lit(None).cast("double")).alias("std")))
    distinct = distinct_counts(df, cols, approx).select("column", "unique_count")
    res = wide.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*").join(F.broadcast(distinct), "column") \
        .select("column", "dtype", "missing_count", "missing_pct", "unique_count", "mean", "std")  # a row per column
    if with_samples:
        from tabsense.operators.normalize import sample_rows
        sample = sample_rows(df.select(*[_q(c) for c in cols]), sample_rows_n, key_cols)
        vals = sample.agg(*[F.slice(F.collect_list(F.col(_q(c)).cast("string")), 1, n_samples).alias(c)
                            for c in cols])
        sv = vals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(_q(c)).alias("sample_values"))
                                               for c in cols])).alias("_s")).select("_s.*")
        res = res.join(F.broadcast(sv), "column", "left")  # one row per column
    return res


def quality_score(df: DataFrame, approx: bool = False) -> DataFrame:
    """100 - 30*missing_ratio - 20*duplicate_ratio + 10*consistent_share, clamped to [0, 100].

    A column is consistent when it is not a string column or its distinct count is below
    0.8 x rows.  Band: > 80 Green, > 60 Yellow, else Red.
    """
    cols = list(df.columns)
    strings = set(categorical_columns(df))
    aggs = [F.count(F.lit(1)).alias("rows")]
    cells = reduce(lambda a, b: a + b, [F.col(_q(c)).isNull().cast("long") for c in cols])
    aggs.append(F.sum(cells).alias("missing_cells"))
    base = df.agg(*aggs)
    named = [c for c in cols if c in strings]
    unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, named, approx).collect()} if named else {}
    n_dup = duplicate_rows(df).first()["duplicate_rows"]  # one aggregate row
    consistent = [F.lit(1) if c not in strings else F.when(F.lit(unique[c]) < F.col("rows") * 0.8, 1).otherwise(0)
                  for c in cols]
    n_cols = len(cols)
    cells_all = F.nullif(F.col("rows") * n_cols, F.lit(0))  # an empty table has no missing or repeated share
    missing_ratio = F.coalesce(F.coalesce(F.col("missing_cells"), F.lit(0)) / cells_all, F.lit(0.0))
    dup_ratio = F.coalesce(F.lit(n_dup) / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0))
    share = reduce(lambda a, b: a + b, consistent) / F.lit(float(n_cols))
    raw = F.lit(100.0) - missing_ratio * 30 - dup_ratio * 20 + share * 10
    scored = base.select(missing_ratio.alias("missing_ratio"), dup_ratio.alias("duplicate_ratio"),
                         share.alias("consistent_share"), raw.alias("_raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_raw")))
    return scored.select(score.alias("quality_score"), "missing_ratio", "duplicate_ratio", "consistent_share") \
        .withColumn("band", F.when(F.col("quality_score") > QUALITY_BANDS[0][0], QUALITY_BANDS[0][1])
                    .when(F.col("quality_score") > QUALITY_BANDS[1][0], QUALITY_BANDS[1][1]).otherwise("Red"))


def quality_issues(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Issue rows: high missing columns, duplicate rows, mixed-type columns (issue, detail)."""
    spark = df.sparkSession
    hm = [r["column"] for r in high_missing_columns(df, limit=limit).collect()]
    d = duplicate_rows(df).first()
    mixed = [r["column"] for r in mixed_type_columns(df).collect()][:limit]
    rows = []
    if hm:
        rows.append(("high_missing", ISSUE_HIGH_MISSING.format(cols=", ".join(hm))))
    if d["duplicate_rows"] > 0:
        rows.append(("duplicates", ISSUE_DUPLICATES.format(n=d["duplicate_rows"],
                                                           pct=d["duplicate_rows"] / d["total_rows"] * 100)))
    if mixed:
        rows.append(("mixed_types", ISSUE_MIXED.format(cols=", ".join(mixed))))
    return spark.createDataFrame(rows, "issue string, detail string")


def numeric_profile(df: DataFrame, columns=None, limit: int | None = None, accuracy: int | None = None) -> DataFrame:
    """mean, sample std, bias-corrected skewness and excess kurtosis, IQR-outlier count.

    Pass 1: moments and quartiles for every column; pass 2: one aggregate counts values
    outside [Q1-1.5*IQR, Q3+1.5*IQR] for every column.
    """
    cols = (list(columns) if columns else numeric_columns(df))[:limit]
    if not cols:
        raise ValueError("no numeric columns")
    x = {c: F.col(_q(c)).cast("double") for c in cols}
    moments = central_moments(df, cols)
    desc = {c: describe_moments(moments[c]) for c in cols}
    qt = quantile_table(df, cols, [0.25, 0.75], accuracy=accuracy)
    counts = {}
    for c in cols:
        q1, q3 = qt[c]
        if q1 is None:
            counts[f"o|{c}"] = F.lit(0).cast("long")
            continue
        iqr = q3 - q1
        counts[f"o|{c}"] = count_if((x[c] < F.lit(q1 - 1.5 * iqr)) | (x[c] > F.lit(q3 + 1.5 * iqr)))
    orow = stats_row(df, counts)
    recs = [(c, i, desc[c]["mean"], desc[c]["std"], desc[c]["skewness"], desc[c]["kurtosis"], int(orow[f"o|{c}"] or 0))
            for i, c in enumerate(cols) if moments[c]["n"] > 0]
    return df.sparkSession.createDataFrame(
        recs, "column string, position int, mean double, std double, skewness double, kurtosis double, outliers_count long")


def categorical_profile(df: DataFrame, columns=None, limit: int | None = None) -> DataFrame:
    """unique values, most frequent (count desc, value asc), cardinality ratio per string column."""
    cols = (list(columns) if columns else categorical_columns(df))[:limit]
    if not cols:
        raise ValueError("no string columns")
    counts = _long_values(df, cols).where(F.col("v").isNotNull()).groupBy("column", "v") \
        .agg(F.count(F.lit(1)).alias("freq"))
    per_col = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"),
                                           F.sum("freq").alias("non_null"))
    w = Window.partitionBy("column").orderBy(F.desc("freq"), F.asc("v"))
    top = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1") \
        .select("column", F.col("v").alias("most_frequent"))
    return per_col.join(top, "column").select(
        "column", F.col("unique_values").cast("long").alias("unique_values"), "most_frequent",
        (F.col("unique_values") / F.col("non_null")).alias("cardinality_ratio"))


def corr_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Pearson correlation over pairwise-complete rows, every ordered pair (column1, column2).

    Two scans for any number of columns: the means, then one Gramian pass.  Each task multiplies
    its centered values and its mask of present values with themselves and passes on one row per
    pair of columns (count, sums, sums of squares, sum of products), which one aggregation adds up.
    NULL and NaN are missing.
    """
    cols = list(columns) if columns else numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("need two numeric columns")
    numbers = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = stats_row(numbers, {f"c{i}": F.avg(F.nanvl(f"c{i}", F.lit(None))) for i in range(len(cols))})
    centre = np.array([first[f"c{i}"] or 0.0 for i in range(len(cols))])
    left, right = np.triu_indices(len(cols))

    def gramian(batches):
        sums = np.zeros((6, len(left)))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            here = ~np.isnan(x)
            x = np.where(here, x - centre, 0.0)
            m = here.astype(float)
            own, square = x.T @ m, (x * x).T @ m  # of the first column, over rows that have both
            for k, part in enumerate((m.T @ m, own, own.T, square, square.T, x.T @ x)):
                sums[k] += part[left, right]
        yield pd.DataFrame({"pos1": left, "pos2": right, **{f"s{k}": sums[k] for k in range(6)}})

    parts = numbers.mapInPandas(gramian, "pos1 int, pos2 int, " + ", ".join(f"s{k} double" for k in range(6)))
    total = parts.groupBy("pos1", "pos2").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    n = F.nullif(F.col("s0"), F.lit(0.0))
    xx = F.col("s3") - F.col("s1") * F.col("s1") / n
    yy = F.col("s4") - F.col("s2") * F.col("s2") / n
    xy = F.col("s5") - F.col("s1") * F.col("s2") / n
    half = total.select("pos1", "pos2", F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy)).alias("correlation"))
    both = half.union(half.where("pos1 < pos2").select("pos2", "pos1", "correlation"))
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.element_at(names, F.col("pos1") + 1).alias("column1"),
                       F.element_at(names, F.col("pos2") + 1).alias("column2"), "pos1", "pos2", "correlation")


def corr_high_pairs(df: DataFrame, columns=None, threshold: float = HIGH_CORR, top: int | None = None,
                    max_columns: int | None = None) -> DataFrame:
    """Pairs (column1 < column2 by name) with |r| > threshold, strongest first (``top`` of them if given)."""
    cols = list(columns) if columns else numeric_columns(df)
    if max_columns:
        cols = cols[:max_columns]
    cm = corr_matrix(df, cols)
    pairs = cm.where((F.col("column1") < F.col("column2")) & (F.abs("correlation") > threshold))
    pairs = pairs.select("column1", "column2", "correlation").orderBy(F.desc(F.abs("correlation")), "column1", "column2")
    return pairs.limit(top) if top else pairs


def eda_insights(df: DataFrame, threshold: float = HIGH_CORR, top: int | None = None) -> DataFrame:
    """Insight text rows (kind, insight): high correlations (``top`` or all) or none, high-missing
    columns, the number of numeric features, and a missing-data flag."""
    spark = df.sparkSession
    rows = []
    nums = numeric_columns(df)
    if len(nums) >= 2:
        pairs = corr_high_pairs(df, nums, threshold, top).collect()
        if pairs:
            for r in pairs:
                rows.append(("correlation", MSG_HIGH_CORR.format(a=r["column1"], b=r["column2"], r=r["correlation"])))
        else:
            rows.append(("correlation", MSG_NO_CORR))
    missing = missing_by_column(df).orderBy("position").collect()  # one row per column
    hm = [r["column"] for r in missing if r["missing_pct"] is not None and r["missing_pct"] > HIGH_MISSING_SHARE * 100]
    if hm:
        rows.append(("missing", MSG_HIGH_MISSING.format(cols=", ".join(hm))))
    if nums:
        rows.append(("numeric", MSG_NUMERIC.format(n=len(nums))))
    if sum(r["missing_count"] for r in missing) > 0:
        rows.append(("missing_flag", MSG_MISSING_FLAG))
    if not rows:
        rows.append(("basic", MSG_BASIC))
    return spark.createDataFrame(rows, "kind string, insight string")


def profile_report(df: DataFrame, num_limit: int | None = None, cat_limit: int | None = None,
                   corr_columns: int | None = None) -> DataFrame:
    """Basic info, numeric and categorical analysis and high correlations as one long table
    (section, column, metric, num_value, str_value)."""
    spark = df.sparkSession
    schema = "section string, column string, metric string, num_value double, str_value string"
    parts = []
    mt = missing_total(df).first()
    dup = duplicate_rows(df).first()
    basic = [("basic_info", None, "rows", float(dup["total_rows"]), None),
             ("basic_info", None, "columns", float(len(df.columns)), None),
             ("basic_info", None, "missing_values", float(mt["missing_cells"]), None),
             ("basic_info", None, "duplicates", float(dup["duplicate_rows"]), None)]
    parts.append(spark.createDataFrame(basic, schema))
    if numeric_columns(df):
        npf = numeric_profile(df, limit=num_limit)
        parts.append(npf.select(F.lit("numeric_analysis").alias("section"), "column", F.explode(F.array(
            *[F.struct(F.lit(m).alias("metric"), qcol(m).cast("double").alias("num_value"),
                       F.lit(None).cast("string").alias("str_value"))
              for m in ("mean", "std", "skewness", "kurtosis", "outliers_count")])).alias("_m")).select(
            "section", "column", "_m.*"))
    if categorical_columns(df):
        cpf = categorical_profile(df, limit=cat_limit)
        parts.append(cpf.select(F.lit("categorical_analysis").alias("section"), "column", F.explode(F.array(
            F.struct(F.lit("unique_values").alias("metric"), F.col("unique_values").cast("double").alias("num_value"),
                     F.lit(None).cast("string").alias("str_value")),
            F.struct(F.lit("most_frequent").alias("metric"), F.lit(None).cast("double").alias("num_value"),
                     F.col("most_frequent").alias("str_value")),
            F.struct(F.lit("cardinality_ratio").alias("metric"), F.col("cardinality_ratio").alias("num_value"),
                     F.lit(None).cast("string").alias("str_value")))).alias("_m")).select("section", "column", "_m.*"))
    if len(numeric_columns(df)) >= 2:
        hp = corr_high_pairs(df, threshold=REPORTED_CORR, max_columns=corr_columns)
        parts.append(hp.select(F.lit("correlations").alias("section"),
                               F.concat_ws(" | ", "column1", "column2").alias("column"),
                               F.lit("correlation").alias("metric"), F.col("correlation").alias("num_value"),
                               F.lit(None).cast("string").alias("str_value")))
    return reduce(lambda a, b: a.unionByName(b), parts)
