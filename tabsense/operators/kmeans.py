"""k-means for many numbers of clusters and many starts in shared scans.

Rows are packed once into blocks (binary matrices), written, and read by every iteration.  One Spark job an
iteration assigns every row under all models that still move (every k, every start) and returns the sums of
their clusters, so the number of jobs grows with the iterations and not with k x starts.  What is broadcast
is the centres, what returns is one row a centre; neither grows with the data.

``mini_batch`` works on hashed batches instead: rows are dealt to ``BATCHES`` folders once, a step reads one
folder, a centre moves towards its batch mean by its share of all rows that it has taken so far, and a model
ends when its smoothed inertia has not fallen for ``PATIENCE`` steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.session import scratch_path

#: Bytes of a packed block.
BLOCK_BYTES = 1 << 20
#: Rows of the sample that starts are drawn from (k-means++), at least so many for each cluster.
START_ROWS, START_ROWS_A_CLUSTER = 4096, 50
#: Folders of mini-batches, steps without a smoothed inertia lower by ``GAIN`` of itself, and passes over the batches at most.
BATCHES, PATIENCE, GAIN, BATCH_PASSES = 32, 10, 1e-3, 3
TOLERANCE = 1e-4


@dataclass
class Fit:
    """One model: its centres, the sum of squared distances of all rows to them, and the scans that it took."""
    k: int
    start: int
    centres: np.ndarray
    inertia: float = float("nan")
    steps: int = 0
    moving: bool = True
    taken: np.ndarray = field(default_factory=lambda: np.zeros(0))
    smooth: float = float("nan")
    least: float = float("inf")
    idle: int = 0

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pack(rows: DataFrame, column: str = "_x", batches: int = 1, seed: int = 0) -> DataFrame:
    """(batch, n, x): the vectors in blocks, dealt to ``batches`` at random; written once, rows with NaN left out."""
    place = rows.columns.index(column)

    def block(batch: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        return pa.RecordBatch.from_pydict({"batch": pa.array([batch], pa.int32()), "n": pa.array([len(x)], pa.int32()),
                                           "x": pa.array([x.tobytes()], pa.binary())})

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: list[list[np.ndarray]] = [[] for _ in range(batches)]
        size = [0] * batches
        for part in arrow:
            x = matrix(part.column(place))
            x = x[~np.isnan(x).any(axis=1)]
            to = rng.integers(batches, size=len(x))
            for b in range(batches):
                own = x[to == b] if batches > 1 else x
                if len(own):
                    held[b].append(own)
                    size[b] += own.nbytes
                if size[b] >= BLOCK_BYTES:
                    yield block(b, held[b])
                    held[b], size[b] = [], 0
        for b in range(batches):
            if held[b]:
                yield block(b, held[b])

    packed = rows.mapInArrow(run, "batch int, n int, x binary")
    path = scratch_path(rows.sparkSession, "vector-blocks")
    packed.write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema("n int, x binary, batch int").parquet(path)


def _vectors(blocks: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for part in blocks:
        for n, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            yield np.frombuffer(x).reshape(n, -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre (the first of equals)."""
    return ((centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)).argmin(axis=1)


def start_sample(blocks: DataFrame, n_rows: int, most: int, seed: int) -> np.ndarray:
    """About ``most`` rows at random (all, where there are fewer): the bounded sample that starts are drawn from."""
    share = min(1.0, 2.0 * most / max(n_rows, 1))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _vectors(arrow):
            rng = np.random.default_rng([seed, zlib.crc32(x.tobytes())])
            key = rng.random(len(x))
            own = np.flatnonzero(key < share)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[own]), "x": pa.array([x[i].tobytes() for i in own], pa.binary())})

    drawn = blocks.select("n", "x").mapInArrow(run, "key double, x binary").orderBy("key", "x").limit(most).select("x").collect()
    return np.stack([np.frombuffer(r["x"]) for r in drawn]) if drawn else np.zeros((0, 0))


def spread_start(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre is drawn by its squared distance to those before."""
    chosen = [sample[rng.integers(len(sample))]]
    far = ((sample - chosen[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = far.sum()
        at = rng.choice(len(sample), p=far / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[at])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.stack(chosen)


def cluster_totals(blocks: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each model, from one job: rows and vector sum of each cluster, and the inertia."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    sent = blocks.sparkSession.sparkContext.broadcast(models)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))) for c in sent.value]
        for x in _vectors(arrow):
            for centres, (n, s, cost) in zip(sent.value, held):
                own = nearest(x, centres)
                n += np.bincount(own, minlength=len(centres))
                cost += np.bincount(own, ((x - centres[own]) ** 2).sum(axis=1), len(centres))
                one = np.zeros((len(centres), len(x)))
                one[own, np.arange(len(x))] = 1.0
                s += one @ x
        for number, (n, s, cost) in enumerate(held):
            yield pa.RecordBatch.from_pydict({
                "model": pa.array([number] * len(n), pa.int32()), "centre": pa.array(np.arange(len(n)), pa.int32()),
                "n": pa.array(n), "cost": pa.array(cost), "s": pa.array(list(s), pa.list_(pa.float64()))})

    parts = blocks.select("n", "x").mapInArrow(run, "model int, centre int, n double, cost double, s array<double>")
    total = parts.groupBy("model", "centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                                 Summarizer.metrics("sum").summary(array_to_vector("s")).alias("m"))
    out = [(np.zeros(len(c)), np.zeros_like(c), 0.0) for c in models]
    for r in total.select("model", "centre", "n", "cost", vector_to_array("m.sum").alias("s")).collect():  # a row a centre
        n, s, cost = out[r["model"]]
        n[r["centre"]], s[r["centre"]] = r["n"], r["s"]
        out[r["model"]] = (n, s, cost + r["cost"])
    sent.unpersist()
    return out


def _lloyd(blocks: DataFrame, fits: list[Fit], max_iter: int) -> None:
    for _ in range(max_iter):
        moving = [f for f in fits if f.moving]
        if not moving:
            break
        for f, (n, s, _) in zip(moving, cluster_totals(blocks, [f.centres for f in moving])):
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], f.centres)  # an empty cluster stays
            f.moving = bool(np.sqrt(((new - f.centres) ** 2).sum(axis=1)).max() > TOLERANCE)
            f.centres, f.steps = new, f.steps + 1


def _mini_batch(blocks: DataFrame, fits: list[Fit], n_rows: int) -> None:
    for f in fits:
        f.taken = np.zeros(f.k)
    for step in range(BATCHES * BATCH_PASSES):
        moving = [f for f in fits if f.moving]
        if not moving:
            break
        batch = blocks.where(F.col("batch") == step % BATCHES)
        for f, (n, s, cost) in zip(moving, cluster_totals(batch, [f.centres for f in moving])):
            rows = n.sum()
            if not rows:
                continue
            f.taken += n
            rate = np.where(n > 0, n / np.maximum(f.taken, 1), 0.0)[:, None]
            f.centres = f.centres + rate * (s / np.maximum(n, 1)[:, None] - f.centres)
            weight = min(1.0, 2.0 * rows / (n_rows + 1))
            f.smooth = cost / rows if np.isnan(f.smooth) else f.smooth * (1 - weight) + weight * cost / rows
            f.idle = 0 if f.smooth < f.least * (1 - GAIN) else f.idle + 1
            f.least, f.steps = f.smooth if f.idle == 0 else f.least, f.steps + 1
            f.moving = f.idle < PATIENCE


def fit_all(rows: DataFrame, k_values: Iterable[int], starts: int, column: str = "_x", seed: int = 42, max_iter: int = 20,
            mini_batch: bool = False) -> list[Fit]:
    """Every start of every k, fitted together; with the inertia over all rows."""
    blocks = pack(rows, column, BATCHES if mini_batch else 1, seed)
    n_rows = int(blocks.agg(F.sum("n")).first()[0] or 0)
    k_values = list(k_values)
    if not n_rows or not k_values:
        return []
    sample = start_sample(blocks, n_rows, max(START_ROWS, START_ROWS_A_CLUSTER * max(k_values)), seed)
    fits = [Fit(k, s, spread_start(sample, k, np.random.default_rng([seed, k, s]))) for k in k_values for s in range(starts)]
    if mini_batch:
        _mini_batch(blocks, fits, n_rows)
    else:
        _lloyd(blocks, fits, max_iter)
    for f, (_, _, cost) in zip(fits, cluster_totals(blocks, [f.centres for f in fits])):
        f.inertia = float(cost)
    return fits


def best_of(fits: list[Fit]) -> dict[int, Fit]:
    """The start of least inertia for each k (the first of equals)."""
    out: dict[int, Fit] = {}
    for f in fits:
        if f.k not in out or f.inertia < out[f.k].inertia:
            out[f.k] = f
    return out


def assign(rows: DataFrame, fits: list[Fit], name: str, column: str = "_x") -> DataFrame:
    """``rows`` with an array column ``name``: the number of the nearest centre in each of the models."""
    from pyspark.sql import types as T
    place = rows.columns.index(column)
    sent = rows.sparkSession.sparkContext.broadcast([f.centres for f in fits])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow:
            x = matrix(part.column(place))
            own = [nearest(x, c) if len(x) else np.zeros(0) for c in sent.value]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(own), pa.int32()),
                                             pa.array(np.stack(own, axis=1).ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))
