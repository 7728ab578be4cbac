"""The corpus pipeline: quality rules, line dedup, near duplicates, secret scans, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as
the next stage's ``docs``.  All stages but the last return the columns of ``documents``; a stage that
changes a text sets ``n_chars`` anew.

Defined cases: a null text is kept as it is by the stages that find nothing in it, has no words for the
quality rules (so it is rejected there) and packs as an empty text; an empty table passes through every
stage; other columns pass through until the packing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsense.llm import jaccard_join, line_dedup, packing, quality, secret_scan
from tabsense.llm.common import spill
from tabsense.plans.catalog import table

#: Not expressible in SQL: quality rules iterate to robust estimates, packing needs a tokenizer.
ORACLE_SQL = None


def _with_text(docs: DataFrame, changed: DataFrame, touched: Column, text: Column) -> DataFrame:
    """The columns of ``docs``, with the new text (and its length) where ``touched`` is true."""
    new = {"text": F.when(touched, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return changed.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    judged = quality.judge(docs, name="_quality")
    return judged.where("_quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    changed = line_dedup.dedup_lines(docs, name="_lines")
    return _with_text(docs, changed, F.col("_lines.n_dropped") > 0, F.col("_lines.text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more connect: the one of least id."""
    found = jaccard_join.similar_documents(docs)
    first = found.where("is_first").select(F.col("doc_id").alias("_first_id"), F.col("text_hash").alias("_first_hash"))
    named = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = named.join(first, F.col("doc_id").eqNullSafe(F.col("_first_id")) & (F.col("_hash") == F.col("_first_hash")),
                      "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    found = secret_scan.find_secrets(docs, name="_spans")
    return _with_text(docs, found, F.size("_spans") > 0, secret_scan.redacted("text", "_spans"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids, with their ids."""
    pieces = packing.pack_on_curve(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
