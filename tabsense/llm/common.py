"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsense.session import scratch_path

#: The white space of every word and line rule: space, tab, LF, VT, FF, CR.
BLANKS = b" \t\n\r\x0b\x0c"


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    A written table cuts lineage, is computed once however often it is read, and outlives any
    executor.  Its types are kept; an empty frame gives an empty table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives ``b""``."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its joined values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finalizer of SplitMix64) of unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordIndex(dict):
    """Numbers words as they first come; ``fresh`` lists those that nothing is known about yet."""

    def __init__(self, known: list[bytes]) -> None:
        super().__init__(zip(known, range(len(known))))
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, also where another name differs in case alone; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} in {df.columns}")
    apart = df.toDF(*[f"_{k}" for k in range(len(df.columns))])
    return apart.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


_RESIDENT: dict[Hashable, Any] = {}


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers from task to task, for one operator at a time.

    A worker outlives the stage that filled its memory; asking for another key lets the last one go.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]
