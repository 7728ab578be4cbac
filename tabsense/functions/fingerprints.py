"""Row fingerprints: which rows can be repeated, without shuffling whole rows.

A fingerprint is 128 bits of all columns (values, and which of them are null).  Rows of a fingerprint that
occurs once are unique; only rows whose fingerprint occurs again are compared column by column, so a
collision costs a comparison and changes no result.  NULLs are equal to each other, as are NaNs, and 0.0
and -0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.functions.schema import is_float, qcol
from tabsense.session import scratch_path

SEEDS = (1_013, 2_027)
#: Fingerprints that are broadcast (16 bytes each).
MOST_SENT = 1_000_000


def fingerprint(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row."""
    def plain(c: str) -> Column:
        x = qcol(c)
        if is_float(df.schema[c].dataType):
            return F.when(F.isnan(x), F.lit(float("nan"))).when(x == 0, F.lit(0.0)).otherwise(x)
        return x

    nulls = F.concat(*[F.when(qcol(c).isNull(), "1").otherwise("0") for c in columns])  # hashes pass over nulls
    return [F.xxhash64(F.lit(seed), nulls, *[plain(c) for c in columns]) for seed in SEEDS]


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    a, b = fingerprint(df, columns)
    return df.withColumn("_fp1", a).withColumn("_fp2", b)


def repeated_fingerprints(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int, int]:
    """The fingerprints that occur more than once (written), their number, and the number of all rows."""
    a, b = fingerprint(df, columns)
    counted = df.select(a.alias("_fp1"), b.alias("_fp2")).groupBy("_fp1", "_fp2").agg(F.count(F.lit(1)).alias("_n"))
    path = scratch_path(df.sparkSession, "fingerprints")
    counted.groupBy((F.col("_n") > 1).alias("_again"), F.when(F.col("_n") > 1, F.col("_fp1")).alias("_fp1"),
                    F.when(F.col("_n") > 1, F.col("_fp2")).alias("_fp2")).agg(F.sum("_n").alias("_n")).write.parquet(path)
    kept = df.sparkSession.read.schema("_again boolean, _fp1 long, _fp2 long, _n long").parquet(path)
    totals = kept.agg(F.sum("_n").alias("rows"), F.sum(F.col("_again").cast("long")).alias("again")).first()
    return kept.where("_again").select("_fp1", "_fp2"), int(totals["again"] or 0), int(totals["rows"] or 0)


def _sent(again: DataFrame, n: int) -> DataFrame:
    return F.broadcast(again) if n <= MOST_SENT else again


def suspects(df: DataFrame, columns: list[str], again: DataFrame, n: int) -> DataFrame:
    """The rows whose fingerprint occurs more than once."""
    return _named(df, columns).join(_sent(again, n), ["_fp1", "_fp2"], "left_semi").drop("_fp1", "_fp2")


def duplicate_count(df: DataFrame, columns: list[str]) -> tuple[int, int]:
    """Rows that equal an earlier one, and all rows."""
    again, n, rows = repeated_fingerprints(df, columns)
    if not n:
        return 0, rows
    groups = suspects(df.select(*[qcol(c) for c in columns]), columns, again, n).groupBy(*[qcol(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    return int(groups.agg(F.sum(F.col("_n") - 1)).first()[0] or 0), rows


def without_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each group of equal rows (by ``columns``)."""
    again, n, _ = repeated_fingerprints(df, columns)
    if not n:
        return df
    if n > MOST_SENT:
        return df.dropDuplicates(columns)
    alone = _named(df, columns).join(_sent(again, n), ["_fp1", "_fp2"], "left_anti").drop("_fp1", "_fp2")
    return alone.unionByName(suspects(df, columns, again, n).dropDuplicates(columns))
