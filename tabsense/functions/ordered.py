"""Order-dependent computations without a single-partition window.

A global running sum (or a fill in row order) is done the way a distributed sort is: range
partition on the order key, sort within partitions, collect one small summary row per
partition, and let every partition start from the offset/carry of the partitions before it.
A key that holds a third of all rows is split over several range partitions, so no task is
larger than one range partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.session import checkpoint_dir
from tabsense.functions.schema import qcol


def _order_cols(order, descending: bool) -> list[Column]:
    cols = [qcol(c) if isinstance(c, str) else c for c in order]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols]


def range_sorted(df: DataFrame, order, descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Range-partition + sort on ``order``, tag rows with ``_pid`` and checkpoint (so every
    later pass sees the same partitions, and lineage is cut in the shared checkpoint dir)."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    oc = _order_cols(order, descending)
    ranged = df.repartitionByRange(parts, *oc).sortWithinPartitions(*oc) \
               .withColumn("_pid", F.spark_partition_id())
    checkpoint_dir(spark)
    return ranged.checkpoint(eager=True)


def cumulative_sums(df: DataFrame, order, sum_cols, descending: bool = False) -> DataFrame:
    """Add inclusive running sums ``cum_<c>`` of ``sum_cols`` in the order of ``order``
    (ties keep the sort's arbitrary order; aggregate ties first when they must count together)."""
    order = [order] if isinstance(order, str) else list(order)
    sum_cols = list(sum_cols)
    ranged = range_sorted(df, order, descending)
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()
    by_pid = {int(r["_pid"]): [r[c] or 0 for c in sum_cols] for r in totals}
    offsets, acc = {}, np.zeros(len(sum_cols))
    for pid in sorted(by_pid):
        offsets[pid] = acc.copy()
        acc = acc + np.asarray(by_pid[pid], dtype=float)
    fields = [f for f in ranged.schema.fields if f.name != "_pid"]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] +
                           [f"`cum_{c}` double" for c in sum_cols])
    names = [f.name for f in fields]

    def run(batches):
        running = None
        for pdf in batches:
            if pdf.empty:
                continue
            if running is None:
                running = offsets.get(int(pdf["_pid"].iloc[0]), np.zeros(len(sum_cols))).copy()
            out = pdf[names].copy()
            for i, c in enumerate(sum_cols):
                cs = np.cumsum(pdf[c].fillna(0).to_numpy(dtype=float)) + running[i]
                out[f"cum_{c}"] = cs
                running[i] = cs[-1]
            yield out

    return ranged.mapInPandas(run, out_schema)


def _runs(pdf: pd.DataFrame, keys) -> np.ndarray:
    """Number of each row's run of equal keys; rows are sorted, and missing keys equal each other."""
    change = np.zeros(len(pdf), bool)
    for k in keys:
        col, before = pdf[k], pdf[k].shift()
        change |= ~((col == before) | (col.isna() & before.isna())).to_numpy(dtype=bool)
    change[:1] = False
    return np.cumsum(change)


def _key_text(pdf: pd.DataFrame, keys, row: int) -> str:
    """One row's keys as text; whole numbers read alike in batches with and without missing values."""
    values = [pdf[k].iloc[row] for k in keys]
    return "|".join("null" if pd.isna(v) else str(int(v)) if isinstance(v, (float, np.floating)) and float(v).is_integer()
                    else str(v).replace("|", "||") for v in values)


def _last_valid(values: pd.Series):
    nn = values.dropna()
    return nn.iloc[-1] if len(nn) else None


def ordered_fill(df: DataFrame, columns, order, partition_by=(), backward: bool = False) -> DataFrame:
    """Forward (or backward) fill of ``columns`` in ``order`` within groups of ``partition_by``.

    Range partitioning on (partition keys, order) splits even a key that holds a third of all
    rows over several partitions.  One pass emits a summary row per partition (first key, last
    key, last non-null values of the last key); the driver chains them into the carry each
    partition starts from (bounded: one row per partition); a second pass fills locally.
    """
    columns, keys = list(columns), list(partition_by)
    order = [order] if isinstance(order, str) else list(order)
    ranged = range_sorted(df, keys + order, descending=backward)
    fields = [f for f in ranged.schema.fields if f.name != "_pid"]
    names = [f.name for f in fields]
    types = {f.name: f.dataType.simpleString() for f in fields}

    def summarize(batches):
        pid, first_key, last_key, last_vals = None, None, None, {}
        for pdf in batches:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            runs, key = _runs(pdf, keys), _key_text(pdf, keys, -1)
            if first_key is None:
                first_key = _key_text(pdf, keys, 0)
            tail = pdf[runs == runs[-1]]
            if key != last_key:
                last_key, last_vals = key, {c: None for c in columns}
            for c in columns:
                v = _last_valid(tail[c])
                if v is not None:
                    last_vals[c] = v
        if pid is not None:
            yield pd.DataFrame({"_pid": [pid], "first_key": [first_key], "last_key": [last_key],
                                **{c: [last_vals[c]] for c in columns}})

    summary_schema = ", ".join(["_pid int", "first_key string", "last_key string"] +
                               [f"`{c}` {types[c]}" for c in columns])
    info = {int(r["_pid"]): r for r in ranged.mapInPandas(summarize, summary_schema).collect()}  # one row per partition

    carries = {}
    prev = []  # (last_key, values) of earlier partitions, most recent last
    for pid in sorted(info):
        r = info[pid]
        vals = {}
        for c in columns:
            v = None
            for lk, lv in reversed(prev):
                if lk != r["first_key"]:
                    break
                if lv[c] is not None:
                    v = lv[c]
                    break
            vals[c] = v
        carries[pid] = (r["first_key"], vals)
        prev.append((r["last_key"], {c: r[c] for c in columns}))

    out_schema = ", ".join(f"`{f.name}` {types[f.name]}" for f in fields)

    def run(batches):
        state_key, state_vals, started = None, {}, False
        for pdf in batches:
            if pdf.empty:
                continue
            runs, key = _runs(pdf, keys), _key_text(pdf, keys, -1)
            if not started:
                state_key, state_vals = carries.get(int(pdf["_pid"].iloc[0]), (None, {}))
                started = True
            out = pdf[names].copy()
            filled = out.groupby(runs, sort=False)[columns].ffill() if keys else out[columns].ffill()
            head = (runs == 0) & (_key_text(pdf, keys, 0) == state_key)
            for c in columns:
                if state_vals.get(c) is not None:
                    filled.loc[head, c] = filled.loc[head, c].fillna(state_vals[c])
                out[c] = filled[c]
            tail = out[runs == runs[-1]]
            new_vals = {}
            for c in columns:
                v = _last_valid(tail[c])
                new_vals[c] = v if v is not None else (state_vals.get(c) if key == state_key else None)
            state_key, state_vals = key, new_vals
            yield out

    return ranged.mapInPandas(run, out_schema)
