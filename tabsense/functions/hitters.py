"""Most frequent values, exactly, without shuffling every distinct value.

Tasks keep a Misra-Gries summary of each column: at most ``capacity`` counters; when there are more, the
largest count left over is taken off all of them and noted as the task's error.  Summaries add up: a value
occurs at least as often as its counters say and at most that plus the sum of the errors.  The values with
the highest counters are recounted over all rows, and the result is proven if the last one wanted occurs more
often than anything outside the candidates can.  Columns without a proof get a second round with a larger
summary, and then (columns of mostly distinct values, where there is nothing frequent to find) a full count.

What is shuffled is summaries and candidates.  Values are told apart by their text; long ones are summarised
by a digest and recounted by themselves.  NULLs don't count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.schema import is_float, qcol

#: Counters of a summary in the first and second round.
CAPACITIES = (1024, 32_768)
#: Candidates a column that are recounted, at least.
CANDIDATES = 256
#: Bytes of a value that stands for itself in a summary.
SHORT = 40


def value_key(df: DataFrame, column: str) -> Column:
    """A text by which equal values of a column are known: short values themselves, digests of long ones."""
    x = qcol(column)
    if is_float(df.schema[column].dataType):
        x = x + F.lit(0.0)  # -0.0 is 0.0
    text = x.cast("string")
    return F.when(F.octet_length(text) > SHORT, F.concat(F.lit("#"), F.md5(text.cast("binary")))).otherwise(F.concat(F.lit("="), text))


class Summary:
    """Misra-Gries counters of one column of one task."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts: Counter = Counter()
        self.error = 0

    def add(self, values: list, counts: list[int]) -> None:
        held = self.counts
        for value, n in zip(values, counts):
            held[value] += n
        if len(held) > 4 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.capacity:
            off = int(np.partition(np.fromiter(self.counts.values(), np.int64), -self.capacity - 1)[-self.capacity - 1])
            self.counts = Counter({v: n - off for v, n in self.counts.items() if n > off})
            self.error += off


def _summaries(keys: DataFrame, capacity: int) -> DataFrame:
    """(place, key, n) of all tasks' summaries; a null key carries the error."""
    width = len(keys.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Summary(capacity) for _ in range(width)]
        for batch in batches:
            for summary, column in zip(held, batch.columns):
                found = pc.value_counts(column.drop_null())
                summary.add(found.field(0).to_pylist(), found.field(1).to_pylist())
        for place, summary in enumerate(held):
            summary.shrink()
            names = [*summary.counts, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([place] * len(names), pa.int32()), pa.array(names, pa.string()),
                 pa.array([*summary.counts.values(), summary.error], pa.int64())], names=["place", "key", "n"])

    return keys.mapInArrow(run, "place int, key string, n long")


def _round(df: DataFrame, columns: list[str], n: int, capacity: int) -> dict[str, list[tuple[Any, int]] | None]:
    """For each column the counted candidates that can be among the first ``n``, or None without a proof."""
    keyed = df.select(*[value_key(df, c).alias(f"k{i}") for i, c in enumerate(columns)])
    most = max(CANDIDATES, 8 * n)
    total = _summaries(keyed, capacity).groupBy("place", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("place").orderBy(F.col("key").isNotNull(), F.desc("n"), "key")  # the error comes first
    first = total.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most + 2)
    error = [0] * len(columns)
    beyond = [0] * len(columns)
    wanted: list[tuple[int, str]] = []
    for r in first.collect():  # a bounded number of short keys a column
        if r["key"] is None:
            error[r["place"]] = r["n"]
        elif r["r"] <= most + 1:
            wanted.append((r["place"], r["key"]))
        else:
            beyond[r["place"]] = r["n"]
    if not wanted:  # no value at all, or none that a summary could hold
        return {c: None if error[i] else [] for i, c in enumerate(columns)}
    candidates = df.sparkSession.createDataFrame(wanted, "place int, key string")
    single = len(columns) == 1
    parts = [F.struct(F.lit(i).alias("place"), value_key(df, c).alias("key"), (qcol(c) if single else qcol(c).cast("string")).alias("v"))
             for i, c in enumerate(columns)]
    long = df.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*")
    counted = long.join(F.broadcast(candidates), ["place", "key"]).groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    found: list[list[tuple[Any, int]]] = [[] for _ in columns]
    for r in counted.collect():  # a row a candidate
        found[r["place"]].append((r["v"], r["n"]))
    out: dict[str, list[tuple[Any, int]] | None] = {}
    for i, c in enumerate(columns):
        rest = error[i] + beyond[i]  # nothing outside the candidates occurs more often
        counts = sorted((m for _, m in found[i]), reverse=True)
        proven = rest == 0 or (len(counts) >= n and counts[n - 1] > rest)
        out[c] = [(v, m) for v, m in found[i] if len(counts) < n or m >= counts[n - 1]] if proven else None
    return out


def frequent_values(df: DataFrame, columns: list[str], n: int = 1) -> tuple[dict[str, list[tuple[Any, int]]], list[str]]:
    """(value, count) of the ``n`` most frequent values of each column and all that tie with the last; and the
    columns for which nothing could be proven.

    Values are texts, but for a single column, whose values keep their type.
    """
    found: dict[str, list[tuple[Any, int]]] = {}
    left = list(columns)
    for capacity in CAPACITIES:
        if left:
            for c, values in _round(df, left, n, capacity).items():
                if values is not None:
                    found[c] = values
            left = [c for c in left if c not in found]
    return found, left
