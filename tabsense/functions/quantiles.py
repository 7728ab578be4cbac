"""Exact quantiles (linear interpolation, pandas / DuckDB ``quantile_cont`` rule) at any scale.

One path for every input.  A bounded sketch per group and column (``percentile_approx``, combined
before the shuffle) gives two bounds around each wanted rank; a second pass counts the values below
the bounds; a third collapses the few values between them to ``(value, weight)`` and runs along them.
The sketch's error is bounded, so the bounds enclose the rank; a group too small for that (fewer rows
than half the sketch's accuracy) is run along whole.  Up to ``MOST_SENT`` groups are broadcast: rows
stay where they are, unsorted, and only sums leave a task.  More groups are joined, each in ``SALTS``
copies, to their distinct values and counts.  A hot value is one row.

NULL and NaN group keys are ordinary groups; NULL values don't count.  ``accuracy=`` returns the
sketch's own answer (relative rank error 1/accuracy) for callers that accept an approximation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsense.functions.schema import qcol
from tabsense.session import checkpoint_dir

#: Accuracy of the sketch that bounds the ranks.
SKETCH_ACCURACY = 10_000
#: Groups that are broadcast; copies of each where there are more.
MOST_SENT, SALTS = 20_000, 16


def _long_form(df: DataFrame, cols, by) -> DataFrame:
    """(_g0.., column, v) with one row per non-null value; group keys renamed so that none can clash."""
    groups = [qcol(b).alias(f"_g{i}") for i, b in enumerate(by)]
    parts = [F.struct(F.lit(c).alias("column"), qcol(c).cast("double").alias("v")) for c in cols]
    names = [f"_g{i}" for i in range(len(by))]
    return (df.select(*groups, F.explode(F.array(*parts)).alias("_kv"))
              .select(*names, F.col("_kv.column").alias("column"), F.col("_kv.v").alias("v"))
              .where(F.col("v").isNotNull()))


def _matched(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", sent: bool = False) -> DataFrame:
    """``rows`` joined to one row per group (broadcast if ``sent``); NULL and NaN keys match themselves."""
    renamed = groups.select(*[qcol(k).alias(f"_m{i}") for i, k in enumerate(keys)],
                            *[qcol(c) for c in groups.columns if c not in keys])
    same = reduce(lambda x, y: x & y, [qcol(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)])
    return rows.join(F.broadcast(renamed) if sent else renamed, same, how).drop(*[f"_m{i}" for i in range(len(keys))])


def kept_groups(groups: DataFrame) -> tuple[DataFrame, bool]:
    """One row per group, worked out once, and whether they are few enough to broadcast."""
    checkpoint_dir(groups.sparkSession)
    kept = groups.checkpoint(eager=True)
    return kept, kept.count() <= MOST_SENT


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to one row per group without shuffling a whole group into one task.

    Few groups are broadcast; of more, rows meet one of ``SALTS`` copies by the hash of column ``spread``.
    """
    if few:
        return _matched(rows, groups, keys, how, sent=True)
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(qcol(spread)), F.lit(SALTS)).cast("int"))
    return _matched(salted, copies, [*keys, "_salt"], how).drop("_salt")


def _rank(p: float) -> Column:
    return F.lit(p) * (F.col("_n") - 1)


def exact_quantiles(df: DataFrame, cols, probs, by=()) -> DataFrame:
    """Exact quantiles as rows (*by, column, prob, quantile); NULL where a group has no value."""
    by, probs = list(by), [float(p) for p in probs]
    names = [f"_g{i}" for i in range(len(by))]
    keys = names + ["column"]
    long = _long_form(df, cols, by)
    slack = 2.0 / SKETCH_ACCURACY
    marks = [min(max(m, 0.0), 1.0) for p in probs for m in (p - slack, p + slack)]
    sketch, few = kept_groups(long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("v", marks, SKETCH_ACCURACY).alias("_b")))
    values = long.withColumn("n", F.lit(1).cast("long")) if few else \
        long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))

    def weight(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(F.lit(0).cast("long")))

    # Plain sums only: an aggregate that carries an array or struct along would sort all rows.
    counted = beside(values, sketch, keys, few, "v").groupBy(*keys).agg(
        *[weight(F.col("v") < F.col("_b")[2 * i]).alias(f"_below{i}") for i in range(len(probs))],
        *[weight(F.col("v") <= F.col("_b")[2 * i + 1]).alias(f"_upto{i}") for i in range(len(probs))])
    wanted = []
    for i, p in enumerate(probs):
        low, high = F.floor(_rank(p)), F.ceil(_rank(p))
        holds = (F.col(f"_below{i}") <= low) & (high < F.col(f"_upto{i}"))
        wanted.append(F.struct(
            F.lit(p).alias("prob"), _rank(p).alias("h"), low.alias("low"), high.alias("high"),
            F.when(holds, F.col("_b")[2 * i]).alias("from_v"), F.when(holds, F.col("_b")[2 * i + 1]).alias("to_v"),
            F.when(holds, F.col(f"_below{i}")).otherwise(F.lit(0)).alias("before")))
    bounds, _ = kept_groups(_matched(counted, sketch, keys, sent=few).select(*keys, F.array(*wanted).alias("_w")))
    inside = F.filter("_w", lambda w: w["from_v"].isNull() | ((F.col("v") >= w["from_v"]) & (F.col("v") <= w["to_v"])))
    near = (beside(values, bounds, keys, few, "v")
            .select(*keys, "v", "n", F.explode(F.transform(inside, lambda w: w["prob"])).alias("prob"))
            .groupBy(*keys, "prob", "v").agg(F.sum("n").alias("n")))
    ranks = bounds.select(*keys, F.explode("_w").alias("w")).select(
        *keys, *[F.col(f"w.{c}").alias(c) for c in ("prob", "h", "low", "high", "before")])
    along = Window.partitionBy(*keys, "prob").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = _matched(near, ranks, [*keys, "prob"], sent=few).withColumn("end", F.sum("n").over(along) + F.col("before")) \
        .withColumn("start", F.col("end") - F.col("n"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("end")), F.col("v")))

    picked = run.groupBy(*keys, "prob").agg(
        at("low").alias("lo"), at("high").alias("hi"), F.first("h").alias("h"), F.first("low").alias("low"),
        F.first("high").alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("lo")).otherwise(
        (F.col("high") - F.col("h")) * F.col("lo") + (F.col("h") - F.col("low")) * F.col("hi"))
    found = picked.select(*keys, "prob", value.alias("quantile"))
    return _with_all_groups(df, found, cols, probs, by, sent=few)


def _with_all_groups(df: DataFrame, found: DataFrame, cols, probs, by, sent: bool = False) -> DataFrame:
    """One row for every group, column and prob, in the order (*by, column, prob, quantile)."""
    names = [f"_g{i}" for i in range(len(by))]
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob")) for c in cols for p in probs]))
    if by:
        groups = df.select(*[qcol(b).alias(n) for b, n in zip(by, names)]).distinct()
    else:
        groups = df.sparkSession.range(1).select()
    skeleton = groups.select(*names, every.alias("_e")).select(*names, "_e.column", "_e.prob")
    full = _matched(skeleton, found, [*names, "column", "prob"], "left", sent)
    return full.select(*[F.col(n).alias(b) for n, b in zip(names, by)], "column", "prob", "quantile")


def approximate_quantiles(df: DataFrame, cols, probs, by=(), accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """The sketch's own quantiles, as rows (*by, column, prob, quantile)."""
    by, probs = list(by), [float(p) for p in probs]
    names = [f"_g{i}" for i in range(len(by))]
    sketch = _long_form(df, cols, by).groupBy(*names, "column").agg(F.percentile_approx("v", probs, accuracy).alias("_q"))
    both = F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), F.col("_q").alias("quantile")))
    found = sketch.select(*names, "column", both.alias("_e")).select(
        *names, "column", F.col("_e")["prob"].alias("prob"), F.col("_e")["quantile"].alias("quantile"))
    return _with_all_groups(df, found, cols, probs, by)


def quantiles(df: DataFrame, cols, probs, by=(), accuracy: int | None = None) -> DataFrame:
    """Quantiles of ``cols`` (per group of ``by``) as rows (*by, column, prob, quantile).

    Exact unless ``accuracy`` is given.
    """
    cols = list(cols)
    if not cols:
        raise ValueError("no columns")
    if accuracy:
        return approximate_quantiles(df, cols, probs, by, accuracy)
    return exact_quantiles(df, cols, probs, by)


def quantile_table(df: DataFrame, cols, probs, accuracy=None) -> dict:
    """Global quantiles collected as {column: [q(p) for p in probs]} (bounded: cols x probs)."""
    rows = quantiles(df, cols, probs, (), accuracy).collect()
    out = {c: [None] * len(probs) for c in cols}
    idx = {float(p): i for i, p in enumerate(probs)}
    for r in rows:
        out[r["column"]][idx[float(r["prob"])]] = r["quantile"]
    return out
