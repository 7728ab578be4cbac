"""Token counts: one exact histogram of encoded lengths answers every context limit.

Tasks encode whole documents and reduce each Arrow batch to ``(length, documents)`` before the
shuffle, so only histogram rows travel.  Suffix sums over the histogram then give, for any context
limit, how many documents reach it, how many tokens they hold and how many remain after truncation,
and the quantiles of the length.

Defined cases: a null or empty text has 0 tokens and counts as a document; ties and repeated rows
count as often as they occur; an empty table gives an empty histogram; columns other than the text
are never read, so their names don't matter; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabsense.llm.common import spill

#: Lengths in one bin of the two-level suffix sum: a bin is one task's work at most.
BIN_SPAN = 256


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``(n_tokens, n_docs)``: how many documents have each encoded length.

    ``ranks_path`` is a vocabulary file in tiktoken's format that every node can open, ``pattern``
    its word pattern.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_path, pattern).encode_ordinary
        for batch in batches:
            lengths = np.fromiter((len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()), np.int64)
            size, n = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(n, pa.int64())],
                                             ["n_tokens", "n_docs"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, span: int = BIN_SPAN) -> DataFrame:
    """The histogram with its suffix sums, one row per length that occurs.

    Adds ``docs_at_least`` and ``tokens_at_least`` (documents of this length or more, and their
    tokens), ``n_docs_total``, ``n_tokens_total``, ``truncated_total`` (tokens left if every document
    is cut to this length), and ``share_below`` and ``share_upto`` (the quantiles that this length
    spans).  Sums run within bins of ``span`` lengths; only bin totals meet in one task.
    """
    h = spill(histogram, "length-histogram").withColumn("bin", F.floor(F.col("n_tokens") / F.lit(span)).cast("long"))
    bins = h.groupBy("bin").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = bins.select("bin", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
                       F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
                       F.sum("d").over(everything).alias("n_docs_total"),
                       F.sum("t").over(everything).alias("n_tokens_total"))
    upward = Window.partitionBy("bin").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = (h.withColumn("d_bin", F.sum("n_docs").over(upward))
          .withColumn("t_bin", F.sum(F.col("n_docs") * F.col("n_tokens")).over(upward))
          .join(bins, "bin")
          .withColumn("docs_at_least", F.col("d_bin") + F.col("d_later"))
          .withColumn("tokens_at_least", F.col("t_bin") + F.col("t_later")))
    below = F.col("n_docs_total") - F.col("docs_at_least")
    return s.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "n_docs_total", "n_tokens_total",
        (F.col("n_tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .alias("truncated_total"),
        (below / F.col("n_docs_total")).alias("share_below"),
        ((below + F.col("n_docs")) / F.col("n_docs_total")).alias("share_upto"))


def limit_answers(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: documents and tokens beyond it, and the total after truncation.

    The first length above a limit holds the suffix sums of everything that the limit cuts.
    An empty histogram gives no rows.
    """
    spark = sums.sparkSession
    wanted = [F.struct(
        F.lit(int(limit)).cast("long").alias("context_limit"),
        F.min(F.when(F.col("n_tokens") > int(limit),
                     F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias("cut")) for limit in limits]
    if not wanted:
        return spark.createDataFrame([], "context_limit long, docs_cut long, tokens_total long, truncated_total long")
    one = sums.agg(F.array(*wanted).alias("a"), F.max("n_tokens_total").alias("total")).where("total is not null")
    cut_docs = F.coalesce(F.col("x.cut.docs_at_least"), F.lit(0))
    cut_tokens = F.coalesce(F.col("x.cut.tokens_at_least"), F.lit(0))
    return one.select(F.explode("a").alias("x"), "total").select(
        F.col("x.context_limit").alias("context_limit"), cut_docs.alias("docs_cut"),
        F.col("total").alias("tokens_total"),
        (F.col("total") - cut_tokens + F.col("x.context_limit") * cut_docs).alias("truncated_total"))


def quantiles(sums: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The smallest length whose cumulative share reaches each probability (``prob``, ``n_tokens``)."""
    one = sums.agg(F.array(*[F.struct(F.lit(float(p)).alias("prob"),
                                      F.min(F.when(F.col("share_upto") >= float(p), F.col("n_tokens"))).alias("n_tokens"))
                             for p in probs]).alias("a"))
    return one.select(F.explode("a").alias("x")).select("x.prob", "x.n_tokens").where("n_tokens is not null")
