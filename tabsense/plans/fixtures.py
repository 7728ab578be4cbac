"""Derived fixture frames shared by the registered queries.

The fixture tables hold no NULLs, so missing-data queries derive NULLs by a fixed rule; the
SQL twins in ``oracle.py`` apply the identical rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.plans.catalog import table


def lineitem_missing(spark: SparkSession, sf: str, extra: bool = False) -> DataFrame:
    li = table(spark, sf, "lineitem")
    more = [F.col("l_partkey").cast("string").alias("l_partkey_txt"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate_txt"),
            F.when(F.col("l_orderkey") % 15 == 0, F.lit(1000000.0)).otherwise(F.col("l_quantity")).alias("l_spiky")]
    return li.select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
        F.when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_orderkey") % 3 != 0, None).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_linenumber") > 2, None).otherwise(F.col("l_shipdate")).alias("l_shipdate"),
        F.when(F.col("l_orderkey") % 5 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", *(more if extra else []))


def orders_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """orders with columns cast to string and some values replaced by rule."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 10
    return o.select(
        "o_orderkey",
        F.when(k == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(k == 1, F.lit("unknown")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"),
        F.when(k == 2, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus")


def events_gappy(spark: SparkSession, sf: str) -> DataFrame:
    """events with NULL values to fill (every event whose id is divisible by 4 or 9)."""
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when((F.col("event_id") % 4 == 0) | (F.col("event_id") % 9 == 0), None)
                     .otherwise(F.col("value")).alias("value"))


def labeled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """labels joined to documents: true label ``quality``, a rule-based prediction and score."""
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(docs, "doc_id")
    score = (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0)))
    return j.select("doc_id", F.col("quality").alias("label"),
                    F.when(F.col("n_chars") >= 2000, 1).otherwise(0).alias("prediction"),
                    score.alias("score"), "lang", "n_chars")


def lineitem_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem_missing plus text columns that parse as numbers / dates and a spiky column."""
    return lineitem_missing(spark, sf, extra=True)


def lineitem_features(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     "l_returnflag")
