"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsense.llm import (filter_audit, html_text, jaccard_join, language_id, line_dedup, lm_scoring, packing, quality,
                          secret_scan, subwords, term_divergence, token_counts, vector_search)
from tabsense.plans.catalog import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under merge dropout, and whether they decode to the text."""
    return subwords.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of all documents under a byte-level BPE, with the suffix sums of every length."""
    hist = token_counts.length_histogram(table(spark, sf_dir, "documents"),
                                         public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.suffix_sums(hist)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: counts of the base kinds, a digest of their spans, all spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("_spans")
    base = F.filter(spans, lambda s: s["ord"] < sum(r.base for r in secret_scan.RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
                        secret_scan.span_list(spans).alias("spans"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the unigram base and under context-tree weighting; a seventh is held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out)


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest integer inner products of each vector whose id is divisible by 100."""
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key ten documents share, dropped everywhere: counts and a digest of what stays."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_lines.n_lines").alias("n_lines"), F.col("_lines.n_dropped").alias("n_dropped"),
                       F.sha2("_lines.text", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the robust-outlier verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    s = quality.judge(docs)
    return s.select("doc_id", *[F.col(f"_quality.{c}") for c in (*quality.STATS, "base_failed", "kept", "d2")])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids along the Hilbert curve."""
    pieces = packing.pack_on_curve(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document: five-word shingles, similarity 0.8."""
    found = jaccard_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing; a fifth is held out, the rest are learned from."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return language_id.predict_languages(table(spark, sf_dir, "documents"), held_out)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each of the 120 orders of five filters keeps and removes, for every source."""
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of a language differ in its terms of ten documents or more."""
    return term_divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_vector_search": op6_vector_search,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_language_id": op11_language_id,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}

LINE_DEDUP_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT rid, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.rid, k.i, k.line, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key),
per AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM per JOIN d USING (rid)"""

VECTOR_SEARCH_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, rid) = 1),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM a JOIN v b ON a.rid <> b.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

ORACLE: dict[str, str] = {
    "op4_secret_scan": secret_scan.oracle_sql(),
    "op6_vector_search": VECTOR_SEARCH_SQL,
    "op7_line_dedup": LINE_DEDUP_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_source_divergence": term_divergence.ORACLE_SQL,
}
