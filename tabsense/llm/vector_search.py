"""Exact top-k search by columnar branch and bound.

Vectors become integers and are dealt into blocks of bounded size; queries are dealt likewise, and
every pair of a query block and a vector block is one group of a cogroup, so neither side ever meets
whole in one task.  A group holds its vectors dimension by dimension.  A query's inner products are
summed one block of dimensions at a time; what the remaining dimensions can still add or take is at
most the product of the remaining lengths, and candidates whose best case falls below the k-th worst
case leave the arrays before the next block.  Each group passes on k rows a query, and a rank over
those gives the answer.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id,
take no part; vectors of different lengths are never compared; each of several equal rows (id and
vector) is a candidate, and they travel as one row with their number; if several rows share a query's
id, the smallest vector asks, once, and all rows but that one answer it; equal scores rank by smaller
id; fewer than k candidates give fewer rows; an empty table gives none; other columns are left alone,
also those whose names differ from ``vec_id`` or ``embedding`` in case alone.  Components are taken as
small enough for a 64-bit sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsense.llm.common import pick

BLOCK_ROWS, BLOCK_QUERIES, BLOCK_DIMENSIONS = 4096, 1024, 8


def integer_vectors(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, v, copies, d)`` with ``floor(scale * x)`` for each component; rows that take no part are gone."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return (pick(vectors, vec_id, embedding).toDF("vec_id", "embedding")
            .where(x.isNotNull() & F.col("vec_id").isNotNull())
            .where(~F.coalesce(bad, F.lit(True)))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"))
            .groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
            .withColumn("d", F.size("v")))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy() for c in column.chunks]) if n else np.zeros(0, np.int64)
    return flat.astype(np.int64).reshape(n, -1)


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, copies: np.ndarray,
                  k: int, step: int = BLOCK_DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query, its k best rows of the block: places of the query and of the row, score and copies.

    The query's own row counts one copy less, and not at all if it was the only one.
    """
    d = rows.shape[1]
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(rows[:, order].T)
    cuts = list(range(0, d, step)) + [d] if d else [0, 0]
    squares = columns.astype(np.float64) ** 2
    rest = [np.sqrt(squares[c:].sum(axis=0)) * (1 + 1e-9) for c in cuts[1:]]
    out: list[tuple[np.ndarray, ...]] = []
    for place, (query, own) in enumerate(zip(queries[:, order], query_ids)):
        itself = np.flatnonzero(row_ids == own)
        itself = itself[(columns[:, itself].T == query).all(axis=1)]
        alive = np.delete(np.arange(len(row_ids)), itself[copies[itself] == 1])
        score = np.zeros(len(alive), np.int64)
        query_rest = np.sqrt((query.astype(np.float64) ** 2)[::-1].cumsum()[::-1])
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            score += query[a:b] @ columns[a:b, alive] if b > a else 0
            if b < d and len(alive) > k:
                slack = query_rest[b] * rest[n][alive] * (1 + 1e-9) + 1
                least = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                stay = score + slack >= least
                if stay.sum() < 0.9 * len(alive):
                    alive, score = alive[stay], score[stay]
        if len(alive) > k:
            stay = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[stay], score[stay]
        first = np.lexsort((row_ids[alive], -score))[:k]
        found = alive[first]
        out.append((np.full(len(first), place), found, score[first], copies[found] - np.isin(found, itself)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id",
          embedding: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of every query row.

    ``is_query`` is a condition on ``vec_id``; every row is a candidate of every query but its own.
    """
    rows = integer_vectors(vectors, scale, vec_id, embedding)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("s")) \
        .select(F.col("vec_id").alias("query_id"), "s.d", "s.v")
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).head()
    n_blocks, n_asked = -(-n["n"] // block_rows) or 1, -(-n["q"] // block_queries) or 1
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int")
    group = F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int")
    left = asked.withColumn("qb", group).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = rows.withColumn("vb", block).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))

    def search(asks: pa.Table, block: pa.Table) -> pa.Table:
        ids, own = block.column("vec_id").to_numpy(), asks.column("query_id").to_numpy()
        if len(ids) and len(own):
            q, r, s, c = best_in_block(_matrix(asks.column("v"), len(own)), own, _matrix(block.column("v"), len(ids)), ids,
                                       block.column("copies").to_numpy(), k)
        else:
            q = r = s = c = np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(own[q], pa.int64()), "vec_id": pa.array(ids[r], pa.int64()),
                         "score": pa.array(s, pa.int64()), "copies": pa.array(c, pa.int64())})

    near = (left.select("d", "qb", "vb", "query_id", "v").groupBy("d", "qb", "vb")
            .cogroup(right.select("d", "qb", "vb", "vec_id", "v", "copies").groupBy("d", "qb", "vb"))
            .applyInArrow(search, "query_id long, vec_id long, score long, copies long"))
    each = near.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
