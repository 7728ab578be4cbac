"""Cleaning and imputation.

Fill values come from one statistics row (bounded: one value per column) and are applied
as literals in a single projection, so the data is scanned once per statistics pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabsense.functions.fingerprints import without_duplicates
from tabsense.functions.hitters import frequent_values
from tabsense.functions.ordered import ordered_fill
from tabsense.functions.quantiles import quantile_table
from tabsense.functions.schema import categorical_columns, numeric_columns, require_columns
from tabsense.functions.stats import count_if, stats_row
from tabsense.operators.profile import DATE_PATTERN, FLOAT_PATTERN, INT_PATTERN

# The reference's cleaning rules and suggestion texts.
DROP_SHARE = 0.5
IMPUTE_SHARE = 0.1
Z_LIMIT = 3.0
Z_SHARE = 0.05
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}
UNKNOWN = "Unknown"
SUGGEST_DROP = "Drop {col} (missing: {pct:.1f}%)"
SUGGEST_IMPUTE = "Impute {col} (missing: {pct:.1f}%)"
SUGGEST_NUMERIC = "Convert {col} to numeric"
SUGGEST_DATETIME = "Convert {col} to datetime"
SUGGEST_OUTLIERS = "Handle outliers in {col} ({pct:.1f}% extreme values)"


def _q(c):
    return "`" + str(c).replace("`", "``") + "`"


def suggest_cleaning(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Suggestions (rank, type, column, description, severity), severity-sorted (the first ``limit`` if given).

    Pass 1 (one aggregate): null share per column, whether every non-null string parses as a
    number / datetime, mean and population std of numeric columns.  Pass 2 (one aggregate):
    share of |z| > 3 per numeric column.
    """
    spark = df.sparkSession
    cols = list(df.columns)
    strings = set(categorical_columns(df))
    nums = [c for c in numeric_columns(df)]
    exprs = {"__rows": F.count(F.lit(1))}
    for c in cols:
        x = F.col(_q(c))
        exprs[f"null|{c}"] = count_if(x.isNull())
        if c in strings:
            exprs[f"nn|{c}"] = F.count(x)
            exprs[f"num|{c}"] = count_if(x.rlike(INT_PATTERN) | x.rlike(FLOAT_PATTERN))
            exprs[f"dt|{c}"] = count_if(x.rlike(DATE_PATTERN))
        if c in nums:
            exprs[f"mean|{c}"] = F.avg(x.cast("double"))
            exprs[f"std|{c}"] = F.stddev_pop(x.cast("double"))
            exprs[f"n|{c}"] = F.count(x)
    row = stats_row(df, exprs)
    z = {}
    for c in nums:
        m, s = row[f"mean|{c}"], row[f"std|{c}"]
        if m is not None and s:
            z[f"z|{c}"] = count_if(F.abs((F.col(_q(c)).cast("double") - F.lit(m)) / F.lit(s)) > Z_LIMIT)
    zrow = stats_row(df, z)
    n = row["__rows"] or 0
    recs = []
    for c in cols:
        share = (row[f"null|{c}"] / n) if n else 0.0
        if share > DROP_SHARE:
            recs.append(("drop_column", c, SUGGEST_DROP.format(col=c, pct=share * 100), "high"))
        elif share > IMPUTE_SHARE:
            recs.append(("impute", c, SUGGEST_IMPUTE.format(col=c, pct=share * 100), "medium"))
        if c in strings and row[f"nn|{c}"]:
            if row[f"num|{c}"] == row[f"nn|{c}"]:
                recs.append(("convert_numeric", c, SUGGEST_NUMERIC.format(col=c), "low"))
            if row[f"dt|{c}"] == row[f"nn|{c}"]:
                recs.append(("convert_datetime", c, SUGGEST_DATETIME.format(col=c), "low"))
        if f"z|{c}" in zrow and row[f"n|{c}"]:
            zs = zrow[f"z|{c}"] / row[f"n|{c}"]
            if zs > Z_SHARE:
                recs.append(("handle_outliers", c, SUGGEST_OUTLIERS.format(col=c, pct=zs * 100), "medium"))
    recs.sort(key=lambda r: SEVERITY_ORDER[r[3]])
    recs = [(i + 1,) + r for i, r in enumerate(recs[:limit])]
    return spark.createDataFrame(recs, "rank int, type string, column string, description string, severity string")


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return df.drop(column)


def drop_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """One row of each group of equal rows; rows whose fingerprint is their own are not shuffled."""
    return without_duplicates(df, list(subset) if subset else list(df.columns))


def _fill(df: DataFrame, values: dict) -> DataFrame:
    """Fill nulls; an integer column that gets a value with a fraction becomes a double column."""
    def filled(c):
        dtype = df.schema[c].dataType
        widen = isinstance(dtype, T.IntegralType) and isinstance(values[c], float) and not values[c].is_integer()
        target = T.DoubleType() if widen else dtype
        return F.coalesce(F.col(_q(c)).cast(target), F.lit(values[c]).cast(target)).alias(c)

    return df.select(*[filled(c) if values.get(c) is not None else F.col(_q(c)) for c in df.columns])


def impute_median(df: DataFrame, columns=None, accuracy: int | None = None) -> DataFrame:
    """Numeric nulls -> column median (exact by default)."""
    cols = list(columns) if columns else numeric_columns(df)
    qt = quantile_table(df, cols, [0.5], accuracy=accuracy)
    return _fill(df, {c: qt[c][0] for c in cols})


def impute_mean(df: DataFrame, columns=None) -> DataFrame:
    """Nulls -> column mean; all-null columns -> 0."""
    cols = list(columns) if columns else numeric_columns(df)
    row = stats_row(df, {c: F.avg(F.col(_q(c)).cast("double")) for c in cols})
    return _fill(df, {c: (row[c] if row[c] is not None else 0.0) for c in cols})


def column_modes(df: DataFrame, columns) -> dict:
    """Most frequent non-null value per column, as text (count desc, value asc).

    Found by summaries and a recount (see ``hitters``); columns that have no provable winner are counted
    in full, in one unpivot pass.
    """
    cols = list(columns)
    if not cols:
        return {}
    found, unproven = frequent_values(df.select(*[F.col(_q(c)).cast("string").alias(c) for c in cols]), cols)
    modes = {c: min(v)[1] for c, values in found.items() for v in [[(-n, v) for v, n in values]] if v}
    if unproven:
        parts = [F.struct(F.lit(c).alias("column"), F.col(_q(c)).cast("string").alias("v")) for c in unproven]
        counts = df.select(F.explode(F.array(*parts)).alias("_kv")).select("_kv.*").where(F.col("v").isNotNull()) \
            .groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("v"))
        top = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").collect()  # one row per column
        modes.update({r["column"]: r["v"] for r in top})
    return modes


def impute_mode(df: DataFrame, columns=None) -> DataFrame:
    """String nulls -> most frequent value, or 'Unknown' when the column has no value."""
    cols = list(columns) if columns else categorical_columns(df)
    modes = column_modes(df, cols)
    return _fill(df, {c: modes.get(c, UNKNOWN) for c in cols})


def impute_constant(df: DataFrame, value, columns=None) -> DataFrame:
    cols = list(columns) if columns else list(df.columns)
    return _fill(df, {c: value for c in cols})


def fill_forward(df: DataFrame, columns, order, partition_by=()) -> DataFrame:
    """Last non-null value in ``order`` (within ``partition_by`` groups)."""
    require_columns(df, list(columns) + ([order] if isinstance(order, str) else list(order)) + list(partition_by))
    return ordered_fill(df, columns, order, partition_by, backward=False)


def fill_backward(df: DataFrame, columns, order, partition_by=()) -> DataFrame:
    """Next non-null value in ``order`` (within ``partition_by`` groups)."""
    require_columns(df, list(columns) + ([order] if isinstance(order, str) else list(order)) + list(partition_by))
    return ordered_fill(df, columns, order, partition_by, backward=True)


def convert_numeric(df: DataFrame, columns) -> DataFrame:
    """String -> double; values that do not parse become NULL."""
    cols = set(columns)
    return df.select(*[F.expr(f"try_cast({_q(c)} AS DOUBLE)").alias(c) if c in cols else F.col(_q(c))
                       for c in df.columns])


def convert_datetime(df: DataFrame, columns, fmt: str | None = None) -> DataFrame:
    """String -> timestamp; values outside the ISO date pattern (or ``fmt``) become NULL."""
    cols = set(columns)
    out = []
    for c in df.columns:
        x = F.col(_q(c))
        if c in cols:
            if fmt:
                conv = F.try_to_timestamp(x, F.lit(fmt))
            else:
                conv = F.when(x.rlike(DATE_PATTERN), F.expr(f"try_cast(trim({_q(c)}) AS TIMESTAMP_NTZ)"))
            out.append(conv.alias(c))
        else:
            out.append(x)
    return df.select(*out)


def iqr_bounds(df: DataFrame, columns, multiplier: float = 1.5, accuracy=None) -> dict:
    qt = quantile_table(df, columns, [0.25, 0.75], accuracy=accuracy)
    out = {}
    for c in columns:
        q1, q3 = qt[c]
        out[c] = (None, None) if q1 is None else (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    return out


def clip_iqr(df: DataFrame, columns=None, multiplier: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """Winsorize to [Q1 - 1.5 IQR, Q3 + 1.5 IQR]; NULL stays NULL."""
    cols = list(columns) if columns else numeric_columns(df)
    b = iqr_bounds(df, cols, multiplier, accuracy)
    out = []
    for c in df.columns:
        x = F.col(_q(c))
        if c in b and b[c][0] is not None:
            lo, hi = b[c]
            out.append(F.when(x.isNull(), x).otherwise(
                F.least(F.greatest(x.cast("double"), F.lit(lo)), F.lit(hi))).alias(c))
        else:
            out.append(x)
    return df.select(*out)
