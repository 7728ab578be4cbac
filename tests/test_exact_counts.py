"""Heavy hitters and row fingerprints against brute force."""

from collections import Counter

import numpy as np
import pytest

from tabsense.functions import fingerprints, hitters
from tabsense.operators import clean, profile


def _top(values, n):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(2)
    n = 4000
    hot = [int(v) for v in rng.zipf(1.4, n).clip(max=10**6)]
    ties = [None if i % 10 == 0 else i % 8 for i in range(n)]
    own = list(range(n))
    long = [("x" * 200 + str(v % 7)) if v % 3 else f"{v}" for v in hot]
    floats = [-0.0 if i % 2 else 0.0 for i in range(n // 2)] + [float(v) for v in hot[n // 2:]]
    return {"hot": hot, "ties": ties, "own": own, "long": long, "floats": floats, "none": [None] * n}


@pytest.fixture(scope="module")
def frame(spark, columns):
    kinds = {"hot": "long", "ties": "int", "own": "long", "long": "string", "floats": "double", "none": "string"}
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in columns)).repartition(5)


@pytest.mark.parametrize("capacities,candidates", [((1024, 32_768), 256), ((4,), 2), ((8, 64), 4)])
def test_top_values(frame, columns, monkeypatch, capacities, candidates):
    monkeypatch.setattr(hitters, "CAPACITIES", capacities)
    monkeypatch.setattr(hitters, "CANDIDATES", candidates)
    for c, values in columns.items():
        for n in (1, 5):
            got = [(r[0], r[1]) for r in profile.value_counts_top(frame, c, n).collect()]
            assert got == [(v, m) for v, m in _top(values, n)], (c, n)
    texts = {c: [None if v is None else ("0.0" if v == 0 else str(v)) if c == "floats" else str(v) for v in columns[c]]
             for c in columns}
    modes = clean.column_modes(frame, [c for c in columns if c != "floats"])
    assert modes == {c: _top(texts[c], 1)[0][0] for c in columns if c not in ("floats", "none")}


def test_what_is_proven(frame):
    found, unproven = hitters.frequent_values(frame, ["hot", "ties", "long", "none", "own"], 1)
    assert unproven == [] or unproven == ["own"]
    assert found["none"] == [] and len(found["ties"]) >= 1


def test_a_summary_never_claims_too_much():
    rng = np.random.default_rng(6)
    values = [str(v) for v in rng.zipf(1.2, 20_000).clip(max=5000)]
    true = Counter(values)
    summary = hitters.Summary(32)
    for k in range(0, len(values), 500):
        part = Counter(values[k:k + 500])
        summary.add(list(part), list(part.values()))
    summary.shrink()
    assert len(summary.counts) <= 32
    assert all(n <= true[v] <= n + summary.error for v, n in summary.counts.items())
    assert all(true[v] <= summary.error for v in true if v not in summary.counts)
    assert summary.error <= len(values) / 33


def test_only_summaries_and_candidates_are_shuffled(spark, frame, monkeypatch):
    plans = []
    keep = hitters._round

    def watched(df, *args):
        total = hitters._summaries(df.select(hitters.value_key(df, "hot").alias("k0")), 16).groupBy("place", "key").count()
        plans.append(total._jdf.queryExecution().executedPlan().toString())
        assert hitters._summaries(df.select(hitters.value_key(df, "own").alias("k0")), 16).count() <= 17 * df.rdd.getNumPartitions()
        return keep(df, *args)

    monkeypatch.setattr(hitters, "_round", watched)
    profile.value_counts_top(frame, "hot", 3)
    assert plans and plans[0].index("MapInArrow") > plans[0].index("Exchange")  # summed below the exchange


AWKWARD = [(1, "a", 1.0), (1, "a", 1.0), (None, "a", 0.0), (None, "a", -0.0), (2, None, float("nan")), (2, None, float("nan")),
           (2, "a", None), (None, None, None), (None, None, None), (None, None, None), (3, "a", 2.0), (3, "b", 2.0), (None, "1", 1.0), (1, None, 1.0)]


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_duplicates(spark, monkeypatch, collide, sent):
    from pyspark.sql import functions as F
    monkeypatch.setattr(fingerprints, "MOST_SENT", sent)
    if collide:  # every row has the same fingerprint
        monkeypatch.setattr(fingerprints, "fingerprint", lambda df, columns: [F.lit(7).cast("long"), F.lit(9).cast("long")])
    df = spark.createDataFrame(AWKWARD, "a int, b string, c double").repartition(3)
    assert tuple(profile.duplicate_rows(df).first()) == (5, 14)
    left = clean.drop_duplicates(df)
    assert left.columns == ["a", "b", "c"] and left.count() == 9
    assert left.exceptAll(df.distinct()).count() == 0
    assert tuple(profile.duplicate_rows(df, ["a"]).first()) == (10, 14)
    assert sorted(r.a for r in clean.drop_duplicates(df, ["a"]).where("a is not null").collect()) == [1, 2, 3]
    assert clean.drop_duplicates(df, ["a"]).count() == 4
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0)
    assert clean.drop_duplicates(df.limit(0)).collect() == []
    alone = spark.createDataFrame([(k, str(k), float(k)) for k in range(50)], "a int, b string, c double")
    assert tuple(profile.duplicate_rows(alone).first()) == (0, 50) and clean.drop_duplicates(alone).count() == 50


def test_fingerprints_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("", "x"), ("x", "")], "a string, b string")
    a, b = fingerprints.fingerprint(df, ["a", "b"])
    assert df.select(a, b).distinct().count() == 4
