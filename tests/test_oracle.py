"""Every SQL-checked query equals its DuckDB twin on the smallest fixture."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def test_every_query_has_callable():
    q = E.queries()
    assert set(SQL) <= set(q)
    assert len(q) >= 90


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    scols = df.columns
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    assert _rows(scols, srows) == _rows(dcols, res.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"column", "mean", "std", "skewness", "kurtosis", "outliers_count"} <= set(df.columns)
