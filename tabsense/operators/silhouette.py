"""Euclidean silhouettes by blocked pair sums.

The mean distance of a row to every cluster needs all distances; unlike squared ones they have no shortcut
through cluster sums.  Rows are packed into blocks by a hash (so a cluster of a third of all rows lies in all
blocks alike) and blocks into groups of ``RUN`` at most.  A task gets two groups, makes the distances of their
blocks pair by pair and adds them up by cluster for the rows of both: what leaves is one row for each row and
cluster, never a pair, and no pair is worked out twice.  A block is sent once a group, not once a block, so
what is shuffled is the rows times the number of groups.  Several labellings of the same rows (a sweep over k)
share the distances.

The work grows with query rows x rows.  All rows are queries unless a number of them is asked for (their groups
then meet all groups of rows); each query's silhouette is exact either way, as it is measured against every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.operators.kmeans import matrix

#: Bytes of a block's vectors, its rows at most, and blocks of a group.
BLOCK_BYTES, BLOCK_ROWS, RUN = 1 << 20, 2048, 32
#: Tasks for each core where there are blocks enough.
TASKS = 4
#: Rows whose distances to a block are held at a time, sums by row and cluster held of two groups, rows of a batch handed on.
SLICE, MOST_SUMS, BATCH = 256, 1 << 22, 1 << 17
#: Squared distances below this part of the vectors' own size are worked out anew from the differences.
CLOSE = 1e-4

_BLOCK = "block long, rows array<long>, names array<array<string>>, codes binary, single boolean, x binary"


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One block: its rows' numbers, their labels (names of each labelling and codes), and vectors, in order of the first label.

    Vectors whose numbers are all of single precision are kept in it.
    """
    rows = rows.combine_chunks()
    x = matrix(rows.column("_x").combine_chunks())
    labels = np.array(rows.column("_labels").to_pylist(), object).reshape(len(x), -1)
    found = [np.unique(labels[:, k].astype(str), return_inverse=True) for k in range(labels.shape[1])]
    order = np.argsort(found[0][1], kind="stable") if found else np.arange(len(x))
    codes = np.array([place[order] for _, place in found], np.int32)
    x = x[order]
    with np.errstate(over="ignore", invalid="ignore"):
        short = x.astype(np.float32)
    single = bool((short == x).all())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()),
                     "rows": pa.array([rows.column("_row").to_numpy()[order]], pa.list_(pa.int64())),
                     "names": pa.array([[names.tolist() for names, _ in found]], pa.list_(pa.list_(pa.string()))),
                     "codes": pa.array([codes.tobytes()], pa.binary()), "single": pa.array([single], pa.bool_()),
                     "x": pa.array([(short if single else x).tobytes()], pa.binary())})


def _blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    return rows.groupBy(F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).alias("block")).applyInArrow(_pack, _BLOCK)


def _widened(x: np.ndarray) -> np.ndarray:
    """Vectors with a 1 and their squared length behind them: a product with (-2 a, |a|^2, 1) is a squared distance."""
    return np.column_stack([x, np.ones(len(x)), (x * x).sum(axis=1)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows: by one product, and anew where that would lose digits."""
    return _distances(_widened(a), _widened(b))


def _distances(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Distances of widened vectors, in ``out`` where it is given."""
    aa, bb = a[:, -1], b[:, -1]
    squared = np.matmul(np.column_stack([-2.0 * a[:, :-2], aa, np.ones(len(a))]), b.T, out=out)
    # only rows with a least distance below the greatest bound can have one that is too small
    some = np.flatnonzero(~(squared.min(axis=1, initial=np.inf) >= CLOSE * (aa + bb.max(initial=0.0))))
    for s in range(0, len(some), SLICE):
        rows = some[s:s + SLICE]
        i, j = np.nonzero(squared[rows] < CLOSE * (aa[rows, None] + bb[None, :]))
        i = rows[i]
        step = max(1, (1 << 20) // a.shape[1])
        for k in range(0, len(i), step):
            p, q = i[k:k + step], j[k:k + step]
            squared[p, q] = ((a[p, :-2] - b[q, :-2]) ** 2).sum(axis=1)
    return np.sqrt(squared, out=squared)


@dataclass
class _Chunk:
    """Blocks that are worked on together: rows, widened vectors and ends of blocks; each labelling's names and codes."""
    rows: np.ndarray
    x: list[np.ndarray]
    ends: np.ndarray
    names: list[np.ndarray]
    codes: list[np.ndarray]

    def sums(self, other: _Chunk) -> list[np.ndarray]:
        """Room for the sums of distances of these rows to the clusters of ``other``, by labelling."""
        return [np.zeros((len(names), len(self.rows))) for names in other.names]


def _chunks(blocks: list[dict]) -> list[_Chunk]:
    """The blocks of a group in as few chunks as keep the sums by row and cluster bounded."""
    parts: list[list[dict]] = []
    seen: set = set()
    rows = 0
    for b in blocks:
        own = {(k, name) for k, names in enumerate(b["names"]) for name in names}
        if not parts or (rows + len(b["rows"])) * len(seen | own) > MOST_SUMS:
            parts.append([])
            seen, rows = set(), 0
        parts[-1].append(b)
        seen, rows = seen | own, rows + len(b["rows"])
    out = []
    for part in parts:
        x = [_widened(np.frombuffer(b["x"], np.float32 if b["single"] else np.float64).astype(np.float64).reshape(len(b["rows"]), -1)) for b in part]
        names = [np.unique(np.concatenate([np.array(b["names"][k], object).astype(str) for b in part])) for k in range(len(part[0]["names"]))]
        codes = [np.concatenate([np.searchsorted(own, np.array(b["names"][k], object).astype(str))
                                 [np.frombuffer(b["codes"], np.int32).reshape(len(names), -1)[k]] for b in part]) for k, own in enumerate(names)]
        out.append(_Chunk(np.concatenate([np.array(b["rows"], np.int64) for b in part]), x, np.cumsum([0] + [len(v) for v in x]),
                          names, codes))
    return out


def _runs(codes: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """An order that brings equal codes together (None: they are), where each begins, and the codes in that order."""
    order = None if (codes[:-1] <= codes[1:]).all() else np.argsort(codes, kind="stable")
    codes = codes if order is None else codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return order, first, codes[first]


def _add_pairs(a: _Chunk, b: _Chunk, to_a: list[np.ndarray], to_b: list[np.ndarray] | None) -> None:
    """Adds the distances of all rows of ``a`` to ``b`` up by cluster of ``b``, and those of ``b`` to ``a``, if wanted.

    Where both are one chunk, each pair of its blocks is met once and ``to_b`` is ``to_a``.
    """
    of_b = [[_runs(codes[s:e]) for s, e in zip(b.ends[:-1], b.ends[1:])] for codes in b.codes]
    room = np.empty(SLICE * max(map(len, b.x)))
    for p, x in enumerate(a.x):
        for s in range(0, len(x), SLICE):
            part = x[s:s + SLICE]
            here = slice(a.ends[p] + s, a.ends[p] + s + len(part))
            of_a = [_runs(codes[here]) for codes in a.codes] if to_b is not None else []
            for q in range(p if a is b else 0, len(b.x)):
                d = _distances(part, b.x[q], room[:len(part) * len(b.x[q])].reshape(len(part), -1))
                for k, sums in enumerate(to_a):
                    order, first, codes = of_b[k][q]
                    sums[codes, here] += np.add.reduceat(d if order is None else d[:, order], first, axis=1).T
                if to_b is None or (a is b and p == q):
                    continue
                there = slice(b.ends[q], b.ends[q + 1])
                for k, sums in enumerate(to_b):
                    order, first, codes = of_a[k]
                    mine = d if order is None else d[order]
                    for c, i, j in zip(codes, first, np.append(first[1:], len(part))):
                        sums[c, there] += mine[i:j].sum(axis=0)


def _handed_on(a: _Chunk, b: _Chunk, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (row, labelling, label, own, total) of the sums of ``a``'s rows to the clusters of ``b``."""
    n = len(a.rows)
    for k, (sums, names) in enumerate(zip(found, b.names)):
        place = np.searchsorted(names, a.names[k]).clip(max=len(names) - 1)
        own = np.where(names[place] == a.names[k], place, -1)[a.codes[k]]
        step = max(1, BATCH // n)
        for s in range(0, len(names), step):
            part = sums[s:s + step]
            label = np.repeat(np.arange(s, s + len(part)), n)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.tile(a.rows, len(part)), pa.int64()), "labelling": pa.array(np.full(part.size, k), pa.int32()),
                "label": pa.array(names.tolist(), pa.string()).take(pa.array(label)),
                "own": pa.array(label == np.tile(own, len(part)), pa.bool_()), "total": pa.array(part.ravel(), pa.float64())})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the distances of each row of a task's groups to the clusters of the other group.

    ``side`` 0 and 1 are two groups (or a group of queries and one of rows); 2 a group that meets itself.
    """
    tiles: dict[int, dict[int, list[dict]]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            (r,) = batch.slice(k, 1).to_pylist()
            tiles.setdefault(r["tile"], {0: [], 1: [], 2: []})[r["side"]].append(r)
    while tiles:
        _, sides = tiles.popitem()
        both = any(r["both"] for blocks in sides.values() for r in blocks)
        first, second, alone = (_chunks(sorted(sides.pop(k), key=lambda r: r["block"])) for k in (0, 1, 2))
        for a in first:
            for b in second:
                yield from _pair(a, b, both)
        for i, a in enumerate(alone):
            for b in alone[i:]:
                yield from _pair(a, b, True)


def _pair(a: _Chunk, b: _Chunk, both: bool) -> Iterator[pa.RecordBatch]:
    to_a = a.sums(b)
    to_b = None if not both else to_a if a is b else b.sums(a)
    _add_pairs(a, b, to_a, to_b)
    yield from _handed_on(a, b, to_a)
    if both and a is not b:
        yield from _handed_on(b, a, to_b)


def _dealt(rows: DataFrame, n: int, per_block: int, asked: DataFrame | None, n_asked: int) -> tuple[DataFrame, int]:
    """The blocks of every task (``tile``), and how many tasks there are: each pair of groups is one, or each group of queries and group of rows."""
    wanted = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n // per_block))
    blocks = _blocks(rows, n_blocks)
    if asked is None:
        groups = max(-(-n_blocks // RUN), min(n_blocks, math.ceil(math.sqrt(2 * wanted))))
        own, other = F.pmod("block", F.lit(groups)), F.col("other")
        met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        high = F.greatest(own, other)
        met = met.withColumn("tile", (F.floor(high * (high + 1) / 2) + F.least(own, other)).cast("int")) \
            .withColumn("side", F.when(own < other, 0).when(own > other, 1).otherwise(2)).withColumn("both", F.lit(True))
        return met.drop("other"), groups * (groups + 1) // 2
    q_blocks = max(1, -(-n_asked // per_block))
    q_groups = -(-q_blocks // RUN)
    groups = max(-(-n_blocks // RUN), min(n_blocks, -(-wanted // q_groups)))
    to_rows = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    to_queries = F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1)))
    left = _blocks(asked, q_blocks).withColumn("other", to_rows) \
        .withColumn("tile", (F.pmod("block", F.lit(q_groups)) * groups + F.col("other")).cast("int")).withColumn("side", F.lit(0))
    right = blocks.withColumn("other", to_queries) \
        .withColumn("tile", (F.col("other") * groups + F.pmod("block", F.lit(groups))).cast("int")).withColumn("side", F.lit(1))
    return left.unionByName(right).withColumn("both", F.lit(False)).drop("other"), q_groups * groups


def silhouettes(rows: DataFrame, queries: int | None = None, seed: int = 42) -> DataFrame:
    """(_row, labelling, silhouette) for every query row and labelling.

    ``rows`` is a written table of ``_row`` (a number of its own for each row), ``_x`` (its vector) and
    ``_labels`` (a string for each labelling).  ``queries`` asks for that many rows, picked by a hash.
    A row alone in its cluster has silhouette 0, and so has every row where there is one cluster only.
    """
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("width")).first()
    n = totals["n"]
    per_block = int(np.clip(BLOCK_BYTES // (8 * max(totals["width"] or 1, 1)), 16, BLOCK_ROWS))
    asked = None if queries is None or queries >= n else rows.orderBy(F.xxhash64("_row", F.lit(seed)), "_row").limit(queries)
    dealt, tiles = _dealt(rows, n, per_block, asked, n if asked is None else queries)
    sums = dealt.repartitionById(tiles, "tile").mapInArrow(_sums, "row long, labelling int, label string, own boolean, total double")
    # dealt by row alone, so that the two sums by row that follow need no further shuffle
    per_cluster = sums.repartition("row").groupBy("row", "labelling", "label", "own").agg(F.sum("total").alias("total"))
    sizes = rows.select(F.posexplode("_labels").alias("labelling", "label")).groupBy("labelling", "label").agg(F.count(F.lit(1)).alias("n"))
    per_cluster = per_cluster.join(sizes, ["labelling", "label"])
    near = per_cluster.groupBy("row", "labelling").agg(
        F.max(F.when(F.col("own"), F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.max(F.when(F.col("own"), F.col("n"))).alias("n_own"),
        F.min(F.when(~F.col("own"), F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("n_own") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))  # a = b = 0: a tie
    return near.select(F.col("row").alias("_row"), "labelling", value.alias("silhouette"))
