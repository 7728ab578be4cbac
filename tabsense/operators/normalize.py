"""Load-time normalization and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.schema import qcol

from tabsense.functions.schema import clean_names, is_float


def normalize_table(df: DataFrame) -> DataFrame:
    """Clean column names (de-duplicated) and turn NaN / +-inf into NULL, in one projection."""
    names = clean_names(df.columns)
    exprs = []
    for field, new in zip(df.schema.fields, names):
        c = F.col(f"`{field.name}`")
        if is_float(field.dataType):
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast(field.dataType)) \
                 .otherwise(c)
        exprs.append(c.alias(new))
    return df.select(*exprs)


def seeded_digest(keys, seed: int):
    """MD5 (hex) of the keys' text and the seed; any SQL engine can repeat it."""
    return F.md5(F.concat_ws("|", *[F.coalesce(qcol(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, key_cols=None, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows chosen by a seeded hash (MD5) of the key columns' text.

    ``orderBy(hash).limit(n)`` plans as TakeOrderedAndProject: each task keeps its n smallest
    hashes, so no task holds more than n rows and the choice does not depend on partitioning.
    """
    keys = key_cols or df.columns
    h = seeded_digest(keys, seed)
    return df.withColumn("_sample_h", h).orderBy("_sample_h", *[F.col(f"`{k}`") for k in keys]) \
             .limit(n).drop("_sample_h")


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample (approximate size), no shuffle."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def project_head(df: DataFrame, order_by, n_rows: int = 100, n_cols: int = 20) -> DataFrame:
    """First ``n_cols`` columns and the first ``n_rows`` rows by an explicit order key."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    cols = df.columns[:n_cols]
    return df.select(*[F.col(f"`{c}`") for c in cols]).orderBy(*order).limit(n_rows)
