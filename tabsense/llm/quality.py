"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics.  Every (language, source) group gets a
minimum-covariance-determinant estimate by concentration steps: from a coordinatewise median and MAD,
repeatedly take the ``SUPPORT`` share of the group's rows with the smallest Mahalanobis distance and
re-estimate centre and scatter from them; a last, reweighting step takes all rows within the ``WITHIN``
quantile of that estimate.  With a support of one half, nearly half of a group may be bad alike and is still
rejected.  Documents far from their group's centre are rejected.

Scale: all rows of all groups take part in every step.  A step is two aggregations (a quantile sketch
of the distances, then moments), both combined before the shuffle, so a group of any size is a few
rows to the reducers; the estimates stay a table and are joined to the rows (broadcast up to ``MOST_SENT``
groups).  Small groups borrow
strength smoothly: a group's moments are weighted with ``BORROWED`` rows' worth of its language's.

Defined cases: a null or empty text has no words and fails the base rule; null languages or sources
form a group; repeated rows count as often as they occur; an empty table gives no rows; statistics of
any length of text are taken over the whole text; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from operator import add, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabsense.llm.common import BLANKS, as_bytes, list_array, spill

SYMBOLS = b"#*$%&|<>"
#: Documents whose statistics are handed on at a time.
SLICE_ROWS = 1000
WINDOW = 5
#: Base rule: fewer words fail; a larger share of repeated words fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
FEATURES = ("log_word_length", "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share", "doubled_word_share")
P = len(FEATURES)
#: Words of average length that are added to every text, so that a few words can't make an outlier.
ADDED_WORDS, ADDED_CHARS = 10, 50
#: Least standard deviation of each feature, so that a feature that hardly varies can't divide by zero.
FLOOR = (0.1, 0.04, 0.06, 0.06, 0.05, 0.03)
SUPPORT, STEPS, WITHIN, BORROWED = 0.5, 4, 0.975, 200.0
#: Groups whose estimates (about 400 bytes each) are broadcast.
MOST_SENT = 20_000
#: Upper tail of the chi-square distribution beyond which a document is rejected.
TAIL = 4e-6
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_REST_BYTES = bytes(range(0x80, 0xC0))


def chi_square_tail(x: float, dof: int) -> float:
    """P(X > x) for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi_square_quantile(tail: float, dof: int) -> float:
    """The x with P(X > x) = ``tail``, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, dof) > tail else (low, mid)
    return high


def text_statistics(text: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """The five base statistics of a whole text, and its feature vector."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, BLANKS + _REST_BYTES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        until = 0
        for k, w in enumerate(windows):
            if often[w] > 1:
                repeated += k + WINDOW - max(k, until)
                until = k + WINDOW
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    doubled = sum(map(eq, words, islice(words, 1, None)))
    vector = [math.log((chars + ADDED_CHARS) / (n + ADDED_WORDS)), math.log1p(symbols / (n + ADDED_WORDS)),
              dup_lines / (len(lines) + 1), repeated / (n + ADDED_WORDS), upper / (chars + ADDED_CHARS),
              doubled / (n + ADDED_WORDS)]
    return n, chars, symbols, dup_lines, repeated, vector


def with_statistics(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` and one more column: a struct of the base statistics and the vector ``x``."""
    kind = pa.struct([*((s, pa.int64()) for s in STATS), ("x", pa.list_(pa.float64()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            found = [text_statistics(t) for t in as_bytes(batch.column(place))]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(STATS))]
            flat = np.array([v for f in found for v in f[-1]], np.float64)
            columns.append(list_array(flat, np.full(len(found), P), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, fields=list(kind))],
                                             [*batch.schema.names, name])

    from pyspark.sql import types as T
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType(
        [*(T.StructField(s, T.LongType()) for s in STATS), T.StructField("x", T.ArrayType(T.DoubleType()))]))])
    return docs.mapInArrow(describe, schema)


def squared_distance(x: Column, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of a vector to a centre, under an inverse scatter in rows."""
    gap = [x[i] - centre[i] for i in range(P)]
    return reduce(add, [(2.0 if i < j else 1.0) * inverse[i * P + j] * gap[i] * gap[j] for i in range(P) for j in range(i, P)])


def _sent(estimates: DataFrame) -> DataFrame:
    return F.broadcast(estimates) if estimates.count() <= MOST_SENT else estimates


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` (``lang, source, x``) with the squared Mahalanobis distance ``d2`` to its group's centre."""
    return rows.join(_sent(estimates), ["lang", "source"]).withColumn(
        "d2", squared_distance(F.col("x"), F.col("centre"), F.col("inverse")))


def _invert(moments: DataFrame, consistency: float) -> DataFrame:
    """``(lang, source, centre, inverse)`` from weights, sums and product sums, with the language's share."""
    pairs = [(i, j) for i in range(P) for j in range(i, P)]

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column(2).to_pylist(), np.float64)
            language = np.array(batch.column(3).to_pylist(), np.float64)
            m = own + language * (BORROWED / np.maximum(language[:, :1], 1.0))
            centre = m[:, 1:1 + P] / m[:, :1]
            scatter = np.empty((len(m), P, P))
            for k, (i, j) in enumerate(pairs):
                scatter[:, i, j] = scatter[:, j, i] = m[:, 1 + P + k] / m[:, 0] - centre[:, i] * centre[:, j]
            scatter = scatter * consistency + np.diag(np.square(FLOOR))
            inverse = np.linalg.inv(scatter).reshape(len(m), P * P)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_array(centre.ravel(), np.full(len(m), P), pa.float64()),
                 list_array(inverse.ravel(), np.full(len(m), P * P), pa.float64())],
                ["lang", "source", "centre", "inverse"])

    return moments.mapInArrow(invert, "lang string, source string, centre array<double>, inverse array<double>")


def consistency(share: float) -> float:
    """Scale that makes the scatter of the central ``share`` consistent for normal vectors."""
    return share / (1 - chi_square_tail(chi_square_quantile(1 - share, P), P + 2))


def estimates_per_group(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant centre and inverse scatter of every (language, source)."""
    group = ["lang", "source"]
    x = [F.col("x")[k] for k in range(P)]
    middle = rows.groupBy(*group).agg(F.array(*[F.percentile_approx(c, 0.5) for c in x]).alias("centre"))
    middle = spill(middle, "quality-median")
    apart = rows.join(middle, group).groupBy(*group, "centre").agg(
        F.array(*[F.percentile_approx(F.abs(c - F.col("centre")[k]), 0.5) for k, c in enumerate(x)]).alias("mad"))
    flat = F.flatten(F.array(*[F.array(*[
        (1.0 / (F.pow(F.col("mad")[i] * 1.4826, 2) + F.lit(FLOOR[i] ** 2))) if i == j else F.lit(0.0)
        for j in range(P)]) for i in range(P)]))
    found = spill(apart.select(*group, "centre", flat.alias("inverse")), "quality-start")
    products = [x[i] * x[j] for i in range(P) for j in range(i, P)]
    width = 1 + P + len(products)
    none = F.array(*[F.lit(0.0)] * width)

    def estimate(core: DataFrame, share: float) -> DataFrame:
        sums = core.groupBy(*group).agg(F.array(F.count("*").cast("double"), *map(F.sum, x), *map(F.sum, products)).alias("own"))
        sums = found.select(*group).join(sums, group, "left").withColumn("own", F.coalesce("own", none))  # a group without core borrows all
        sums = spill(sums, "quality-moments")
        language = sums.groupBy("lang").agg(F.array(*[F.sum(F.col("own")[k]) for k in range(width)]).alias("all"))
        usable = language.where(F.col("all")[0] > 0)
        return spill(_invert(sums.join(usable, "lang").select("lang", "source", "own", "all"), consistency(share)), "quality-step")

    for _ in range(steps):
        near = spill(_distance(rows, found).select(*group, "x", "d2"), "quality-distances")
        limit = _sent(spill(near.groupBy(*group).agg(F.percentile_approx("d2", SUPPORT, 1000).alias("limit")), "quality-limits"))
        found = estimate(near.join(limit, group).where(F.col("d2") <= F.col("limit")), SUPPORT)
    return estimate(_distance(rows, found).where(F.col("d2") <= chi_square_quantile(1 - WITHIN, P)), WITHIN)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", name: str = "_quality",
          tail: float = TAIL) -> DataFrame:
    """``docs`` and a struct column ``name``: the base statistics, ``x``, ``base_failed``, ``d2`` and ``kept``."""
    def key(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    vectors = with_statistics(docs.select(key(lang).alias("lang"), key(source).alias("source"),
                                          F.col(text).cast("string").alias("text")), "text", "s")
    rows = spill(vectors.where("s.n_words > 0").select("lang", "source", F.col("s.x").alias("x")), "quality-vectors")
    found = _sent(estimates_per_group(rows)).select(*[F.col(c).alias(f"{name}_{c}") for c in ("lang", "source", "centre", "inverse")])
    counted = with_statistics(docs, text, name)
    joined = counted.join(found, (key(lang) == F.col(f"{name}_lang")) & (key(source) == F.col(f"{name}_source")), "left")
    n, repeated = F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    d2 = squared_distance(F.col(f"{name}.x"), F.col(f"{name}_centre"), F.col(f"{name}_inverse"))
    verdict = joined.withColumn(f"{name}_d2", d2)
    kept = ~failed & F.coalesce(F.col(f"{name}_d2") <= chi_square_quantile(tail, P), F.lit(True))
    whole = F.struct(*[F.col(f"{name}.{c}").alias(c) for c in (*STATS, "x")], failed.alias("base_failed"),
                     F.col(f"{name}_d2").alias("d2"), kept.alias("kept"))
    return verdict.select(*docs.columns, whole.alias(name))
