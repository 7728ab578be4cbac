"""A small feed-forward network: ReLU layers, Adam, L2, early stop.

Rows are packed once into binary matrix blocks, dealt at random to mini-batches, and written.  A step is one
Spark job: the weights go to the tasks, which add the gradients of their blocks up; the sums come back in two
levels where there are many partitions.  The first step of an epoch also brings the loss of the validation
rows.  Regression has one linear output and half the squared error, classification a softmax with its
cross-entropy; nothing else differs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.operators.kmeans import matrix
from tabsense.session import scratch_path

#: Bytes of a block, rows that make another mini-batch, and mini-batches at most.
BLOCK_BYTES, BATCH_ROWS, MOST_BATCHES = 1 << 20, 50_000, 16
#: Rows of a block whose layers are worked out at once: their outputs stay in the processor's cache.
SLICE_ROWS = 4096
#: Partial sums that reach the driver; more are summed in tasks first.
PARTIALS_AT_ONCE = 64
ADAM = (0.9, 0.999, 1e-8)


@dataclass
class Network:
    """Weights and biases by layer, and how they were found."""
    params: list[np.ndarray]
    classes: int = 0  # 0: regression
    epochs: int = 0
    converged: bool = False
    losses: list[float] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Every layer's output, from the input to the last linear one."""
        out = [x]
        last = len(self.params) // 2 - 1
        for i in range(last + 1):
            z = out[-1] @ self.params[2 * i] + self.params[2 * i + 1]
            out.append(z if i == last else np.maximum(z, 0.0))
        return out

    def output(self, x: np.ndarray) -> np.ndarray:
        """Predicted values, or a probability for each class."""
        z = self.forward(x)[-1]
        return softmax(z) if self.classes else z[:, 0]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Sums over rows of the loss and of its derivative by every parameter."""
        out = self.forward(x)
        if self.classes:
            p = softmax(out[-1])
            at = (np.arange(len(y)), y.astype(int))
            loss = float(-np.log(np.maximum(p[at], 1e-300)).sum())
            delta = p
            delta[at] -= 1.0
        else:
            delta = out[-1] - y[:, None]
            loss = float(0.5 * (delta * delta).sum())
        grads: list[np.ndarray] = []
        for i in reversed(range(len(self.params) // 2)):
            grads = [out[i].T @ delta, delta.sum(axis=0), *grads]
            delta = (delta @ self.params[2 * i].T) * (out[i] > 0)
        return loss, grads


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def random_network(sizes: list[int], classes: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    params = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        params += [rng.uniform(-bound, bound, size=(a, b)), np.zeros(b)]
    return Network(params, classes)


def _pack(rows: DataFrame, batches: int, seed: int) -> DataFrame:
    """(n, x, y, batch) of (x, y, fit): the vectors in blocks; batch -1 holds the validation rows."""
    def block(batch: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, y = (np.concatenate(v) for v in zip(*parts))
        return pa.RecordBatch.from_pydict({"n": pa.array([len(y)], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()),
                                           "y": pa.array([y.tobytes()], pa.binary()), "batch": pa.array([batch], pa.int32())})

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for part in arrow:
            x, y = matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False).astype(float)
            to = np.where(part.column(2).to_numpy(zero_copy_only=False).astype(bool), rng.integers(batches, size=len(y)), -1)
            for b in np.unique(to).tolist():
                own = to == b
                held.setdefault(b, []).append((x[own], y[own]))
                size[b] = size.get(b, 0) + x[own].nbytes
                if size[b] >= BLOCK_BYTES:
                    yield block(b, held.pop(b))
                    size[b] = 0
        for b, parts in held.items():
            yield block(b, parts)

    path = scratch_path(rows.sparkSession, "network-blocks")
    rows.select("x", "y", "fit").mapInArrow(run, "n int, x binary, y binary, batch int").write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema("n int, x binary, y binary, batch int").parquet(path)


def _block_sums(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over a block's rows of the loss and of its gradient, in a row."""
    loss, total = 0.0, np.zeros(sum(p.size for p in net.params))
    for at in range(0, len(y), SLICE_ROWS):
        found, grads = net.loss_and_gradient(x[at:at + SLICE_ROWS], y[at:at + SLICE_ROWS])
        loss += found
        total += np.concatenate([g.ravel() for g in grads])
    return loss, total


def _totals(blocks: DataFrame, net: Network, many: bool = False) -> tuple[np.ndarray, float, float]:
    """Summed gradient and loss of the batch's rows, and the summed loss of the validation rows, in one job.

    ``many`` partitions are summed in tasks first.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    size = sum(p.size for p in net.params)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, unseen = np.zeros(size), 0.0, 0.0
        for part in arrow:
            for r in part.to_pylist():
                found, gradient = _block_sums(net, np.frombuffer(r["x"]).reshape(r["n"], -1), np.frombuffer(r["y"]))
                if r["batch"] < 0:
                    unseen += found
                else:
                    loss += found
                    total += gradient
        yield pa.RecordBatch.from_pydict({"g": pa.array([total], pa.list_(pa.float64())), "loss": pa.array([loss]), "unseen": pa.array([unseen])})

    parts = blocks.mapInArrow(run, "g array<double>, loss double, unseen double")
    if many:
        parts = parts.groupBy((F.spark_partition_id() % PARTIALS_AT_ONCE).alias("b")).agg(
            Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("loss").alias("loss"), F.sum("unseen").alias("unseen")) \
            .select(vector_to_array("g").alias("g"), "loss", "unseen")
    found = parts.collect()  # some dozens of rows of as many numbers as there are weights
    return (np.sum([r["g"] for r in found], axis=0) if found else np.zeros(size)), sum(r["loss"] for r in found), sum(r["unseen"] for r in found)


def train(rows: DataFrame, hidden: tuple[int, ...], classes: int, max_iter: int, alpha: float, learning_rate: float,
          patience: int, tol: float, seed: int) -> Network:
    """Fit on the rows (x, y, fit) with ``fit``; stop when the mean loss of the others has not fallen by
    ``tol`` for ``patience`` epochs.  Without other rows the loss of the fitted rows decides."""
    counts = {r["fit"]: r["count"] for r in rows.groupBy("fit").count().collect()}  # two rows
    n_fit, n_unseen = counts.get(True, 0), counts.get(False, 0)
    width = rows.select(F.size("x")).first()[0] if counts else 1
    net = random_network([width, *hidden, classes or 1], classes, seed)
    if not n_fit:
        return net
    batches = int(np.clip(n_fit // BATCH_ROWS, 1, MOST_BATCHES))
    blocks = _pack(rows, batches, seed)
    steps = [blocks.where(F.col("batch").isin(b, -1) if b == 0 else F.col("batch") == b) for b in range(batches)]
    many = [part.rdd.getNumPartitions() > PARTIALS_AT_ONCE for part in steps]
    m, v = ([np.zeros_like(p) for p in net.params] for _ in range(2))
    best, kept, stale, step = np.inf, [p.copy() for p in net.params], 0, 0
    b1, b2, eps = ADAM
    for net.epochs in range(1, max_iter + 1):
        seen, before = 0.0, [p.copy() for p in net.params]
        for b, part in enumerate(steps):
            flat, loss, unseen = _totals(part, net, many[b])
            seen += loss
            if b == 0 and n_unseen:  # of the weights before this epoch
                net.losses.append(unseen / n_unseen)
            step += 1
            at = 0
            for i, p in enumerate(net.params):
                g = flat[at:at + p.size].reshape(p.shape) * batches / n_fit
                at += p.size
                if i % 2 == 0:
                    g = g + alpha * p / n_fit
                m[i] = b1 * m[i] + (1 - b1) * g
                v[i] = b2 * v[i] + (1 - b2) * g * g
                net.params[i] = p - learning_rate * (m[i] / (1 - b1 ** step)) / (np.sqrt(v[i] / (1 - b2 ** step)) + eps)
        if not n_unseen:
            net.losses.append(seen / n_fit)
        stale = 0 if net.losses[-1] < best - tol else stale + 1
        if net.losses[-1] < best:
            best, kept = net.losses[-1], before
        if stale >= patience:
            net.converged = True
            break
    net.params = kept
    return net


def predict(rows: DataFrame, net: Network, keep: list[str], scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """``keep``, ``prediction`` and (classification) the array ``_probability`` for rows with the vector ``x``."""
    from pyspark.sql import types as T
    more = [T.StructField("prediction", T.DoubleType())]
    more += [T.StructField("_probability", T.ArrayType(T.DoubleType()))] if net.classes else []

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow:
            if part.num_rows:
                out = net.output(matrix(part.column(0)))
                own = [pa.array(out.argmax(axis=1).astype(float)), pa.array(list(out), pa.list_(pa.float64()))] if net.classes \
                    else [pa.array(out * scale + shift)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *own], names=[*keep, *(f.name for f in more)])

    data = rows.select("x", *keep)
    return data.mapInArrow(run, T.StructType([*data.schema.fields[1:], *more]))


def standardized(data: DataFrame, features: list[str], stats: dict) -> Column:
    """The vector of standardized features; ``stats`` holds ``m|name`` and ``s|name``."""
    return F.array(*[(F.col(f"`{c}`") - F.lit(stats[f"m|{c}"] or 0.0)) / F.lit(stats[f"s|{c}"] or 1.0) for c in features])
