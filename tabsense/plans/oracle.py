"""DuckDB SQL twins of the registered queries (tables are pre-registered views).

Repetitive per-column SQL is generated by small helpers; every helper emits plain SQL text.
Doubles are rounded exactly as the Spark side rounds them (``R(expr, d)``).
"""

from __future__ import annotations

from itertools import combinations

ORACLE: dict[str, str] = {}

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]

LM = """lm AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_orderkey % 3 <> 0 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_linenumber > 2 THEN NULL ELSE l_shipdate END AS l_shipdate,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus
  FROM lineitem)"""
LM_COLS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount",
           "l_shipdate", "l_returnflag", "l_linestatus"]
LM_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_quantity": "double",
            "l_extendedprice": "double", "l_tax": "double", "l_discount": "double",
            "l_shipdate": "timestamp_ntz", "l_returnflag": "string", "l_linestatus": "string"}

OT = """ot AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
         CASE WHEN o_orderkey % 10 = 1 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
         CASE WHEN o_orderkey % 10 = 2 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS o_orderpriority,
         CAST(o_custkey AS VARCHAR) AS o_custkey,
         o_orderstatus
  FROM orders)"""

INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE_PATTERN = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\s*$"


def R(expr: str, d: int = 6) -> str:
    """Round like Spark ``round`` and normalise -0.0 to 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), {d}) + 0.0)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ 2.2

ORACLE["normalize_table"] = """
SELECT l_orderkey AS order_key,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS Quantity__units,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS col_2024_price,
       l_returnflag AS flag, l_linestatus AS flag_2
FROM lineitem"""

ORACLE["project_head"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100"

# ------------------------------------------------------------------ 2.3

ORACLE["filter_in"] = f"WITH {LM} SELECT * FROM lm WHERE l_returnflag IN ('A') OR l_returnflag IS NULL"
ORACLE["filter_range"] = "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20"
ORACLE["filter_datetime_range"] = """SELECT * FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00'"""

FILTER_PRED = """l_returnflag IN ('A', 'N') AND l_quantity BETWEEN 5 AND 30
  AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate <= TIMESTAMP '1998-12-31 00:00:00'"""
ORACLE["filter_conjunction"] = f"SELECT * FROM lineitem WHERE {FILTER_PRED}"
ORACLE["filter_compare"] = "SELECT * FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus = 'F'"
ORACLE["filter_reduction"] = f"""
SELECT total_rows, kept_rows, round((1 - kept_rows / total_rows) * 100, 4) AS reduction_pct FROM (
  SELECT count(*) AS total_rows, CAST(sum(CASE WHEN {FILTER_PRED} THEN 1 ELSE 0 END) AS BIGINT) AS kept_rows
  FROM lineitem)"""


def _filter_options(tab, cats, nums):
    pairs = union([f"SELECT DISTINCT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {tab} WHERE {c} IS NOT NULL"
                   for c in cats])
    mm = union([f"SELECT '{c}' AS \"column\", 'min' AS kind, CAST(1 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS str_value, "
                f"{R(f'min({c})')} AS num_value FROM {tab}\nUNION ALL\n"
                f"SELECT '{c}', 'max', CAST(2 AS BIGINT), CAST(NULL AS VARCHAR), {R(f'max({c})')} FROM {tab}"
                for c in nums])
    return f"""
WITH pairs AS ({pairs}),
ranked AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) AS pos FROM pairs)
SELECT r.col AS "column", 'value' AS kind, CAST(r.pos AS BIGINT) AS pos, r.v AS str_value, CAST(NULL AS DOUBLE) AS num_value
FROM ranked r
UNION ALL
{mm}"""


ORACLE["sample_rows"] = """SELECT * FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 100"""
ORACLE["filter_in_many"] = "SELECT * FROM customer WHERE c_custkey BETWEEN 1 AND 60"
ORACLE["filter_wide_state"] = """SELECT *, l_quantity > 25 AS l_big, """ + ", ".join(
    f"CAST((l_orderkey + {k}) % 5 AS VARCHAR) AS s{k}" for k in range(12)) + """
FROM lineitem WHERE (l_orderkey + 11) % 5 IN (1, 3) AND l_quantity > 25"""
ORACLE["filter_compare_long"] = "SELECT * FROM (SELECT l_linenumber, 9007199254740990 + l_orderkey AS k FROM lineitem) WHERE k = 9007199254740993"
ORACLE["filter_options"] = _filter_options("part", ["p_name", "p_brand", "p_type"],
                                           ["p_partkey", "p_size", "p_retailprice"])
ORACLE["dropna_rows"] = f"""WITH {LM} SELECT * FROM lm
WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL"""

# ------------------------------------------------------------------ 2.4

ORACLE["agg_basic"] = f"""
SELECT l_returnflag, {R('avg(l_extendedprice)', 4)} AS mean, {R('sum(l_extendedprice)', 2)} AS sum,
       {R('median(l_extendedprice)', 4)} AS median, count(l_extendedprice) AS count,
       {R('min(l_extendedprice)', 4)} AS min, {R('max(l_extendedprice)', 4)} AS max
FROM lineitem GROUP BY l_returnflag"""


def _describe(tab, nums, cats, d=3):
    parts = []
    for c in nums:
        x = f"CAST({c} AS DOUBLE)"
        for stat, e in (("count", f"count({c})"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"),
                        ("min", f"min({x})"), ("25%", f"quantile_cont({x}, 0.25)"), ("50%", f"quantile_cont({x}, 0.5)"),
                        ("75%", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})")):
            parts.append(f"SELECT '{c}' AS \"column\", '{stat}' AS stat, {R(e, d)} AS num_value, "
                         f"CAST(NULL AS VARCHAR) AS str_value FROM {tab}")
    for c in cats:
        vc = f"(SELECT {c} AS v, count(*) AS f FROM {tab} WHERE {c} IS NOT NULL GROUP BY {c})"
        parts.append(f"SELECT '{c}', 'count', {R('sum(f)', d)}, CAST(NULL AS VARCHAR) FROM {vc}")
        parts.append(f"SELECT '{c}', 'unique', {R('count(*)', d)}, CAST(NULL AS VARCHAR) FROM {vc}")
        parts.append(f"SELECT '{c}', 'top', CAST(NULL AS DOUBLE), (SELECT v FROM {vc} ORDER BY f DESC, v LIMIT 1)")
        parts.append(f"SELECT '{c}', 'freq', (SELECT {R('f', d)} FROM {vc} ORDER BY f DESC, v LIMIT 1), CAST(NULL AS VARCHAR)")
    return union(parts)


ORACLE["describe_all"] = _describe("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"])
ORACLE["value_counts_top"] = """SELECT l_partkey, count(*) AS count FROM lineitem WHERE l_partkey IS NOT NULL
GROUP BY l_partkey ORDER BY count DESC, l_partkey LIMIT 5"""


def _missing_by_column(cte, tab, cols):
    rows = union([f"SELECT '{c}' AS \"column\", {i} AS position, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, "
                  f"count(*) AS n FROM {tab}" for i, c in enumerate(cols)])
    return f"WITH {cte}, m AS ({rows})"


MISSING_LM = _missing_by_column(LM, "lm", LM_COLS)
ORACLE["missing_by_column"] = MISSING_LM + f"""
SELECT "column", position, missing_count, {R('missing_count * 100.0 / n')} AS missing_pct FROM m"""
ORACLE["missing_total"] = MISSING_LM + f"""
SELECT CAST(sum(missing_count) AS BIGINT) AS missing_cells, CAST(max(n) * {len(LM_COLS)} AS BIGINT) AS total_cells,
       {R(f'sum(missing_count) * 100.0 / (max(n) * {len(LM_COLS)})')} AS missing_pct FROM m"""
ORACLE["high_missing_columns"] = MISSING_LM + f"""
SELECT "column", missing_count, {R('missing_count * 100.0 / n')} AS missing_pct FROM m
WHERE missing_count * 100.0 / n > 50 ORDER BY position"""
ORACLE["duplicate_rows"] = """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)"""


def _kind(c):
    return (f"CASE WHEN regexp_matches({c}, '{INT_PATTERN}') THEN 'int' "
            f"WHEN regexp_matches({c}, '{FLOAT_PATTERN}') THEN 'float' "
            f"WHEN regexp_matches({c}, '{DATE_PATTERN}') THEN 'date' ELSE 'text' END")


def _mixed(cte, tab, cols):
    parts = []
    for c in cols:
        k = _kind(c)
        cnt = ", ".join(f"CAST(sum(CASE WHEN {c} IS NOT NULL AND {k} = '{kind}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{kind}"
                        for kind in ("int", "float", "date", "text"))
        parts.append(f"SELECT '{c}' AS \"column\", {cnt} FROM {tab}")
    return f"""WITH {cte}, w AS ({union(parts)})
SELECT *, CAST((n_int > 0)::INT + (n_float > 0)::INT + (n_date > 0)::INT + (n_text > 0)::INT AS INTEGER) AS n_kinds
FROM w WHERE (n_int > 0)::INT + (n_float > 0)::INT + (n_date > 0)::INT + (n_text > 0)::INT > 1"""


ORACLE["mixed_type_columns"] = _mixed(OT, "ot", ["o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey",
                                                 "o_orderstatus"])


def _nunique(tab, cols):
    return union([f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, "
                  f"CAST(count({c}) AS BIGINT) AS non_null, {R(f'count(DISTINCT {c}) / count({c})')} AS unique_ratio FROM {tab}"
                  for c in cols])


ORACLE["nunique_ratio"] = _nunique("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


def _preview(cte, tab, cols, types, d=4):
    parts = []
    for c in cols:
        num = types[c] in ("bigint", "double", "int")
        mean = R(f"avg(CAST({c} AS DOUBLE))", d) if num else "CAST(NULL AS DOUBLE)"
        std = R(f"stddev_samp(CAST({c} AS DOUBLE))", d) if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", '{types[c]}' AS dtype, "
                     f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, "
                     f"{R(f'sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*)', d)} AS missing_pct, "
                     f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, {mean} AS mean, {std} AS std FROM {tab}")
    return f"WITH {cte} " + union(parts)


ORACLE["column_preview"] = _preview(LM, "lm", LM_COLS, LM_TYPES)

_CONSISTENT = " + ".join(
    f"(CASE WHEN (SELECT count(DISTINCT {c}) FROM lm) < count(*) * 0.8 THEN 1 ELSE 0 END)"
    if LM_TYPES[c] == "string" else "1" for c in LM_COLS)
_CELLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in LM_COLS)
_DUP_LM = f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM lm GROUP BY ALL_COLS))".replace(
    "ALL_COLS", ", ".join(LM_COLS))
ORACLE["quality_score"] = f"""WITH {LM}, b AS (
  SELECT sum({_CELLS}) / (count(*) * {len(LM_COLS)}) AS missing_ratio,
         {_DUP_LM} / count(*) AS duplicate_ratio,
         ({_CONSISTENT}) / {float(len(LM_COLS))} AS consistent_share
  FROM lm)
SELECT {R('greatest(0.0, least(100.0, 100.0 - missing_ratio * 30 - duplicate_ratio * 20 + consistent_share * 10))')} AS quality_score,
       {R('missing_ratio')} AS missing_ratio, {R('duplicate_ratio')} AS duplicate_ratio, {R('consistent_share')} AS consistent_share,
       CASE WHEN greatest(0.0, least(100.0, 100.0 - missing_ratio * 30 - duplicate_ratio * 20 + consistent_share * 10)) > 80 THEN 'Green'
            WHEN greatest(0.0, least(100.0, 100.0 - missing_ratio * 30 - duplicate_ratio * 20 + consistent_share * 10)) > 60 THEN 'Yellow'
            ELSE 'Red' END AS band
FROM b"""

ORACLE["quality_issues"] = MISSING_LM + f""",
hm AS (SELECT "column", position FROM m WHERE missing_count * 100.0 / n > 50),
d AS (SELECT coalesce(sum(n - 1), 0) AS dups, coalesce(sum(n), 0) AS total
      FROM (SELECT count(*) AS n FROM lm GROUP BY {', '.join(LM_COLS)}))
SELECT 'high_missing' AS issue, 'High missing data (>50%): ' || string_agg("column", ', ' ORDER BY position) AS detail
FROM hm HAVING count(*) > 0
UNION ALL
SELECT 'duplicates', 'Duplicate rows: ' || format('{{:,}}', dups) || ' (' || printf('%.1f', dups / total * 100) || '%)'
FROM d WHERE dups > 0"""


def _numeric_profile(cte, tab, cols, d=4):
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        q = f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {tab})"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, {R(f'avg({x})', d)} AS mean, {R(f'stddev_samp({x})', d)} AS std, "
            f"{R(f'skewness({x})', d)} AS skewness, {R(f'kurtosis({x})', d)} AS kurtosis, "
            f"(SELECT CAST(count(*) AS BIGINT) FROM {tab}, {q} qq WHERE {x} < qq.q1 - 1.5 * (qq.q3 - qq.q1) "
            f"OR {x} > qq.q3 + 1.5 * (qq.q3 - qq.q1)) AS outliers_count FROM {tab}")
    return (f"WITH {cte} " if cte else "") + union(parts)


ORACLE["numeric_profile"] = _numeric_profile(None, "lineitem", LINEITEM_NUMERIC)


def _categorical_profile(cte, tab, cols, d=6):
    parts = []
    for c in cols:
        vc = f"(SELECT {c} AS v, count(*) AS f FROM {tab} WHERE {c} IS NOT NULL GROUP BY {c})"
        parts.append(f"SELECT '{c}' AS \"column\", (SELECT CAST(count(*) AS BIGINT) FROM {vc}) AS unique_values, "
                     f"(SELECT v FROM {vc} ORDER BY f DESC, v LIMIT 1) AS most_frequent, "
                     f"(SELECT {R('count(*) / sum(f)', d)} FROM {vc}) AS cardinality_ratio")
    return (f"WITH {cte} " if cte else "") + union(parts)


ORACLE["categorical_profile"] = _categorical_profile(None, "orders", ["o_orderstatus", "o_orderpriority"])


def _corr_matrix(tab, cols, d=6):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            x, y = (a, b) if i <= j else (b, a)
            parts.append(f"SELECT '{a}' AS column1, '{b}' AS column2, {i} AS pos1, {j} AS pos2, "
                         f"{R(f'corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))', d)} AS correlation FROM {tab}")
    return union(parts)


ORACLE["corr_matrix"] = _corr_matrix("lineitem", LINEITEM_NUMERIC)


def _high_pairs(cte, tab, cols, threshold, top, d=6):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            x, y = (a, b) if a < b else (b, a)
            parts.append(f"SELECT '{x}' AS column1, '{y}' AS column2, corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS r FROM {tab}")
    lim = f" LIMIT {top}" if top else ""
    return (f"WITH {cte}, " if cte else "WITH ") + f"""p AS ({union(parts)})
SELECT column1, column2, {R('r', d)} AS correlation FROM p WHERE abs(r) > {threshold}
ORDER BY abs(r) DESC, column1, column2{lim}"""


LI_GROSS = "lg AS (SELECT *, l_extendedprice * (1 + l_tax) AS l_gross FROM lineitem)"
ORACLE["corr_high_pairs"] = _high_pairs(LI_GROSS, "lg", LINEITEM_NUMERIC + ["l_gross"], 0.8, 3)

LMG = LM + ", lmg AS (SELECT *, l_extendedprice * (1 + l_tax) AS l_gross FROM lm)"
_LMG_NUM = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_gross"]
_LMG_COLS = LM_COLS + ["l_gross"]
_MISS_LMG = union([f"SELECT '{c}' AS col, {i} AS position, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM lmg"
                   for i, c in enumerate(_LMG_COLS)])
ORACLE["eda_insights"] = f"""WITH {LMG},
p AS ({union([f"SELECT '{min(a, b)}' AS column1, '{max(a, b)}' AS column2, corr({min(a, b)}, {max(a, b)}) AS r FROM lmg"
               for i, a in enumerate(_LMG_NUM) for b in _LMG_NUM[i + 1:]])}),
hp AS (SELECT * FROM p WHERE abs(r) > 0.8),
ms AS ({_MISS_LMG}),
hm AS (SELECT col, position FROM ms WHERE share > 0.5)
SELECT 'correlation' AS kind, 'High correlation: ' || column1 || ' ↔ ' || column2 || ' (' || printf('%.3f', r) || ')' AS insight FROM hp
UNION ALL
SELECT 'correlation', 'No strong correlations found' WHERE (SELECT count(*) FROM hp) = 0
UNION ALL
SELECT 'missing', 'High missing data: ' || string_agg(col, ', ' ORDER BY position) || ' (>50%)' FROM hm HAVING count(*) > 0
UNION ALL
SELECT 'numeric', 'Dataset contains {len(_LMG_NUM)} numeric features suitable for ML'
UNION ALL
SELECT 'missing_flag', 'Missing data detected - auto-cleaning suggestions available' WHERE (SELECT max(share) FROM ms) > 0"""


# ------------------------------------------------------------------ 2.5 cleaning

LD = LM.replace("         l_linestatus\n  FROM lineitem)", """         l_linestatus,
         CAST(l_partkey AS VARCHAR) AS l_partkey_txt,
         strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_txt,
         CASE WHEN l_orderkey % 15 = 0 THEN 1000000.0 ELSE l_quantity END AS l_spiky
  FROM lineitem)""").replace("lm AS (", "ld AS (", 1)
LD_COLS = LM_COLS + ["l_partkey_txt", "l_shipdate_txt", "l_spiky"]
LD_STRINGS = ["l_returnflag", "l_linestatus", "l_partkey_txt", "l_shipdate_txt"]
LD_NUMERIC = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_spiky"]
LD_DOUBLES = ["l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_spiky"]


def _suggest(cte, tab, cols, strings, nums):
    cands = []
    for i, c in enumerate(cols):
        share = f"(SELECT CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*) FROM {tab})"
        cands.append(f"SELECT 'drop_column' AS type, '{c}' AS col, 'Drop {c} (missing: ' || printf('%.1f', {share} * 100) || '%)' AS description, "
                     f"'high' AS severity, 0 AS sev, {i} AS pos, 0 AS tr WHERE {share} > 0.5")
        cands.append(f"SELECT 'impute', '{c}', 'Impute {c} (missing: ' || printf('%.1f', {share} * 100) || '%)', "
                     f"'medium', 1, {i}, 0 WHERE {share} > 0.1 AND {share} <= 0.5")
        if c in strings:
            nn = f"(SELECT count({c}) FROM {tab})"
            isnum = f"(SELECT count(*) FROM {tab} WHERE regexp_matches({c}, '{INT_PATTERN}') OR regexp_matches({c}, '{FLOAT_PATTERN}'))"
            isdt = f"(SELECT count(*) FROM {tab} WHERE regexp_matches({c}, '{DATE_PATTERN}'))"
            cands.append(f"SELECT 'convert_numeric', '{c}', 'Convert {c} to numeric', 'low', 2, {i}, 1 "
                         f"WHERE {nn} > 0 AND {isnum} = {nn}")
            cands.append(f"SELECT 'convert_datetime', '{c}', 'Convert {c} to datetime', 'low', 2, {i}, 2 "
                         f"WHERE {nn} > 0 AND {isdt} = {nn}")
        if c in nums:
            zs = (f"(SELECT CAST(sum(CASE WHEN abs((CAST({c} AS DOUBLE) - m) / s) > 3.0 THEN 1 ELSE 0 END) AS DOUBLE) / count({c}) "
                  f"FROM {tab}, (SELECT avg(CAST({c} AS DOUBLE)) m, stddev_pop(CAST({c} AS DOUBLE)) s FROM {tab}) st WHERE s > 0)")
            cands.append(f"SELECT 'handle_outliers', '{c}', 'Handle outliers in {c} (' || printf('%.1f', {zs} * 100) || '% extreme values)', "
                         f"'medium', 1, {i}, 3 WHERE {zs} > 0.05")
    return f"""WITH {cte}, cand AS ({union(cands)})
SELECT CAST(row_number() OVER (ORDER BY sev, pos, tr) AS INTEGER) AS rank, type, col AS "column", description, severity
FROM cand ORDER BY sev, pos, tr"""


ORACLE["suggest_cleaning"] = _suggest(LD, "ld", LD_COLS, LD_STRINGS, LD_NUMERIC)
ORACLE["drop_column"] = f"WITH {LM} SELECT * EXCLUDE (l_discount) FROM lm"


def _select_rounded(cols, doubles, replace=None, d=6):
    out = []
    for c in cols:
        e = (replace or {}).get(c, c)
        out.append(f"{R(e, d)} AS {c}" if c in doubles else f"{e} AS {c}")
    return ", ".join(out)


LM_DOUBLES = ["l_quantity", "l_extendedprice", "l_tax", "l_discount"]
ORACLE["impute_median"] = f"WITH {LM} SELECT " + _select_rounded(
    LM_COLS, LM_DOUBLES, {c: f"coalesce({c}, (SELECT median({c}) FROM lm))" for c in ("l_tax", "l_discount", "l_quantity")}) \
    + " FROM lm"
ORACLE["impute_mean"] = f"WITH {LM} SELECT " + _select_rounded(
    LM_COLS, LM_DOUBLES, {c: f"coalesce({c}, (SELECT avg({c}) FROM lm))" for c in ("l_tax", "l_discount", "l_quantity")}) \
    + " FROM lm"
_MODE = "(SELECT v FROM (SELECT {c} AS v, count(*) AS f FROM lm WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY f DESC, v LIMIT 1)"
ORACLE["impute_mode"] = f"WITH {LM} SELECT " + _select_rounded(
    LM_COLS, [], {c: f"coalesce({c}, {_MODE.format(c=c)}, 'Unknown')" for c in ("l_returnflag", "l_linestatus")}) + " FROM lm"
ORACLE["impute_constant"] = f"WITH {LM} SELECT " + _select_rounded(
    LM_COLS, [], {c: f"coalesce({c}, 0.0)" for c in ("l_tax", "l_discount")}) + " FROM lm"

EG = """eg AS (SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)"""
ORACLE["fill_forward"] = f"""WITH {EG}
SELECT event_id, ts, user_id, event_type,
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM eg"""
ORACLE["fill_backward"] = f"""WITH {EG}
SELECT event_id, ts, user_id, event_type,
  first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
                                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM eg"""
OT_COLS = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey", "o_orderstatus"]
ORACLE["convert_numeric"] = f"WITH {OT} SELECT " + _select_rounded(
    OT_COLS, [], {c: f"TRY_CAST({c} AS DOUBLE)" for c in ("o_totalprice", "o_custkey")}) + " FROM ot"
ORACLE["convert_datetime"] = f"WITH {OT} SELECT " + _select_rounded(
    OT_COLS, [], {"o_orderdate": f"CASE WHEN regexp_matches(o_orderdate, '{DATE_PATTERN}') "
                                 f"THEN TRY_CAST(trim(o_orderdate) AS TIMESTAMP) END"}) + " FROM ot"


def _clip(c, tab):
    q = f"(SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {tab})"
    return (f"CASE WHEN {c} IS NULL THEN {c} ELSE least(greatest(CAST({c} AS DOUBLE), "
            f"(SELECT a - 1.5 * (b - a) FROM {q})), (SELECT b + 1.5 * (b - a) FROM {q})) END")


ORACLE["clip_iqr"] = f"WITH {LD} SELECT " + _select_rounded(
    LD_COLS, LD_DOUBLES, {c: _clip(c, "ld") for c in ("l_spiky", "l_extendedprice")}) + " FROM ld"
ORACLE["drop_duplicates"] = "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem"

# ------------------------------------------------------------------ 2.6 anomalies

LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
AF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _zscore_cte(feats, tab="lineitem"):
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in feats)
    zs = ", ".join(f"abs(({c} - m_{c}) / s_{c}) AS z_{c}" for c in feats)
    return f"st AS (SELECT {stats} FROM {tab}), z AS (SELECT t.*, {zs} FROM {tab} t, st)"


def _flag_select(cols, doubles, feats, prefix, threshold):
    score = f"greatest({', '.join(f'{prefix}{c}' for c in feats)})"
    flag = " OR ".join(f"{prefix}{c} > {threshold}" for c in feats)
    return _select_rounded(cols, doubles) + f", {R(score)} AS anomaly_score, coalesce({flag}, false) AS is_anomaly"


ORACLE["anomaly_zscore"] = f"WITH {_zscore_cte(AF)} SELECT {_flag_select(LI_COLS, LI_DOUBLES, AF, 'z_', 3.0)} FROM z"

_MED = ", ".join(f"median({c}) AS med_{c}" for c in AF)
_MAD = ", ".join(f"median(abs({c} - med_{c})) AS mad_{c}" for c in AF)
_MZ = ", ".join(f"abs(0.6745 * ({c} - med_{c}) / mad_{c}) AS mz_{c}" for c in AF)
ORACLE["anomaly_modified_zscore"] = f"""WITH md AS (SELECT {_MED} FROM lineitem),
ma AS (SELECT {_MAD} FROM lineitem, md),
z AS (SELECT t.*, {_MZ} FROM lineitem t, md, ma)
SELECT {_flag_select(LI_COLS, LI_DOUBLES, AF, 'mz_', 3.5)} FROM z"""

_IQ_F = ["l_spiky", "l_extendedprice"]
_IQ_COLS = ["l_orderkey", "l_partkey", "l_quantity", "l_spiky", "l_extendedprice"]
_IQ_Q = ", ".join(f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
                  f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
                  for c in _IQ_F)
ORACLE["anomaly_iqr"] = f"""WITH {LD}, b AS (SELECT {_IQ_Q} FROM ld)
SELECT {_select_rounded(_IQ_COLS, ['l_quantity', 'l_spiky', 'l_extendedprice'])},
  {R('greatest(greatest(' + ', '.join(f'lo_{c} - {c}' for c in _IQ_F) + '), greatest(' + ', '.join(f'{c} - hi_{c}' for c in _IQ_F) + '))')} AS anomaly_score,
  ({' OR '.join(f'{c} < lo_{c} OR {c} > hi_{c}' for c in _IQ_F)}) AS is_anomaly
FROM ld, b"""

ORACLE["anomaly_summary"] = f"""WITH {_zscore_cte(AF)},
f AS (SELECT coalesce({' OR '.join(f'z_{c} > 3.0' for c in AF)}, false) AS a FROM z)
SELECT 'Z-Score' AS method, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count,
       {R('sum(CASE WHEN a THEN 1 ELSE 0 END) * 100.0 / count(*)')} AS anomaly_rate_pct,
       count(*) AS rows, '{', '.join(AF)}' AS features FROM f"""

ORACLE["remove_outliers_iqr"] = f"""WITH {LD},
d0 AS (SELECT l_orderkey, l_partkey, l_spiky, l_extendedprice, l_quantity FROM ld),
q1 AS (SELECT quantile_cont(l_spiky, 0.25) AS a, quantile_cont(l_spiky, 0.75) AS b FROM d0),
d1 AS (SELECT d0.* FROM d0, q1 WHERE l_spiky >= a - 1.5 * (b - a) AND l_spiky <= b + 1.5 * (b - a)),
q2 AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM d1),
d2 AS (SELECT d1.* FROM d1, q2 WHERE l_extendedprice >= a - 1.5 * (b - a) AND l_extendedprice <= b + 1.5 * (b - a))
SELECT * FROM d2"""

# ------------------------------------------------------------------ 2.7 features

LF = "lf AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem)"
LF_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
LF_DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _poly(cols):
    return ", ".join(f"{R(f'{c} * {c}', 2)} AS {c}_squared, {R(f'ln(1 + abs({c}))')} AS {c}_log" for c in cols)


def _inter(cols):
    return ", ".join(f"{R(f'{a} * {b}')} AS {a}_x_{b}" for a, b in combinations(cols, 2))


def _bins(cols, tab):
    out = []
    for c in cols:
        st = f"(SELECT min({c}) AS lo, (max({c}) - min({c})) / 5 AS w FROM {tab})"
        idx = f"CAST(least(5, greatest(1, CAST(ceil(({c} - (SELECT lo FROM {st})) / (SELECT w FROM {st})) AS INTEGER))) AS INTEGER)"
        out.append(f"['Low', 'Low-Med', 'Medium', 'Med-High', 'High'][{idx}] AS {c}_binned")
    return ", ".join(out)


ORACLE["feat_polynomial"] = f"WITH {LF} SELECT {_select_rounded(LF_COLS, LF_DOUBLES)}, " \
                            f"{_poly(LF_DOUBLES)} FROM lf"
ORACLE["feat_interactions"] = f"WITH {LF} SELECT {_select_rounded(LF_COLS, LF_DOUBLES)}, {_inter(LF_DOUBLES)} FROM lf"
ORACLE["feat_bins"] = f"WITH {LF} SELECT {_select_rounded(LF_COLS, LF_DOUBLES)}, {_bins(LF_DOUBLES, 'lf')} FROM lf"
_FE = ["l_quantity", "l_extendedprice", "l_discount"]
ORACLE["feature_engineering"] = f"WITH {LF} SELECT {_select_rounded(LF_COLS, LF_DOUBLES)}, {_poly(_FE)}, " \
                                f"{_inter(_FE)}, {_bins(_FE, 'lf')} FROM lf"


def _label_map(c, tab):
    return (f"(SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS idx "
            f"FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS v FROM {tab}))")


ORACLE["label_encode"] = f"""WITH {LM}
SELECT l_orderkey, l_partkey, m1.idx AS l_returnflag, m2.idx AS l_linestatus
FROM lm JOIN {_label_map('l_returnflag', 'lm')} m1 ON coalesce(lm.l_returnflag, 'nan') = m1.v
        JOIN {_label_map('l_linestatus', 'lm')} m2 ON coalesce(lm.l_linestatus, 'nan') = m2.v"""

_SS = ["l_quantity", "l_extendedprice", "l_discount"]
ORACLE["standard_scale"] = "SELECT " + _select_rounded(
    ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"],
    LF_DOUBLES, {c: f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) > 0 "
                    f"THEN stddev_pop({c}) ELSE 1.0 END FROM lineitem)" for c in _SS}) + " FROM lineitem"

# ------------------------------------------------------------------ 2.11 charts

ORACLE["chart_line"] = "SELECT ts, value, event_type FROM events"
ORACLE["chart_line_bounded"] = """WITH r AS (SELECT event_type, ts, value, CAST(epoch_us(ts) AS DOUBLE) AS place FROM events
      WHERE ts IS NOT NULL AND value IS NOT NULL),
b AS (SELECT min(place) AS lo, max(place) AS hi FROM r),
p AS (SELECT event_type, ts, value, CAST(least(199, CASE WHEN hi > lo THEN floor((place - lo) / (hi - lo) * 200.0) ELSE 0 END) AS INTEGER) AS i
      FROM r, b)
SELECT DISTINCT event_type, i AS interval, ts, value FROM p
QUALIFY row_number() OVER (PARTITION BY event_type, i ORDER BY ts, value) = 1
     OR row_number() OVER (PARTITION BY event_type, i ORDER BY ts DESC, value DESC) = 1
     OR row_number() OVER (PARTITION BY event_type, i ORDER BY value, ts) = 1
     OR row_number() OVER (PARTITION BY event_type, i ORDER BY value DESC, ts DESC) = 1"""
ORACLE["chart_bar"] = f"""SELECT l_returnflag, l_linestatus, {R('sum(l_quantity)', 2)} AS sum_l_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus"""
ORACLE["chart_histogram"] = f"""WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS width FROM mm),
c AS (SELECT CAST(least(19, floor((l_extendedprice - lo) / width)) AS INTEGER) AS bin, count(*) AS n
      FROM lineitem, w GROUP BY 1)
SELECT CAST(b.i AS INTEGER) AS bin, {R('lo + b.i * width', 4)} AS bin_lo, {R('lo + (b.i + 1) * width', 4)} AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM range(20) b(i) CROSS JOIN w LEFT JOIN c ON c.bin = b.i"""
ORACLE["chart_box"] = f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1,
    quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY l_returnflag),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.l_returnflag, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3,
  {R('lower_fence')} AS lower_fence, {R('upper_fence')} AS upper_fence,
  {R('min(CASE WHEN l_extendedprice >= lower_fence AND l_extendedprice <= upper_fence THEN l_extendedprice END)')} AS whisker_low,
  {R('max(CASE WHEN l_extendedprice >= lower_fence AND l_extendedprice <= upper_fence THEN l_extendedprice END)')} AS whisker_high,
  CAST(sum(CASE WHEN l_extendedprice >= lower_fence AND l_extendedprice <= upper_fence THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM lineitem l JOIN f ON l.l_returnflag = f.l_returnflag
GROUP BY f.l_returnflag, q1, median, q3, lower_fence, upper_fence"""
ORACLE["chart_box_null_groups"] = f"""WITH b AS (SELECT CASE WHEN l_linenumber > 2 THEN NULL ELSE l_linenumber END AS g, l_extendedprice AS v FROM lineitem),
q AS (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY g),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.g, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3, {R('lower_fence')} AS lower_fence, {R('upper_fence')} AS upper_fence,
  {R('min(CASE WHEN v >= lower_fence AND v <= upper_fence THEN v END)')} AS whisker_low,
  {R('max(CASE WHEN v >= lower_fence AND v <= upper_fence THEN v END)')} AS whisker_high,
  CAST(sum(CASE WHEN v >= lower_fence AND v <= upper_fence THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM b JOIN f ON b.g IS NOT DISTINCT FROM f.g GROUP BY f.g, q1, median, q3, lower_fence, upper_fence"""
ORACLE["chart_violin"] = f"""WITH st AS (SELECT l_linestatus, min(l_discount) AS lo, max(l_discount) AS hi,
    stddev_samp(l_discount) AS sd, count(*) AS n FROM lineitem GROUP BY l_linestatus),
st2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st WHERE sd * pow(CAST(n AS DOUBLE), -0.2) > 0),
st3 AS (SELECT *, CAST(greatest(1, ceil((hi - lo) / h * 10)) AS BIGINT) AS nb FROM st2),
st4 AS (SELECT *, (hi - lo) / nb AS w FROM st3),
hist AS (SELECT s.l_linestatus, s.lo, s.hi, s.n, s.h, s.w,
           CAST(least(s.nb - 1, floor((l.l_discount - s.lo) / s.w)) AS INTEGER) AS bin, count(*) AS cnt
         FROM lineitem l JOIN st4 s ON l.l_linestatus = s.l_linestatus
         GROUP BY s.l_linestatus, s.lo, s.hi, s.n, s.h, s.w, s.nb, bin),
g AS (SELECT hist.*, lo + (bin + 0.5) * w AS c, p.point, lo + p.point * ((hi - lo) / 49) AS y
      FROM hist, range(50) p(point))
SELECT l_linestatus, CAST(point AS INTEGER) AS point, {R('y')} AS y,
  {R('sum(cnt * exp(-0.5 * ((y - c) / h) * ((y - c) / h)) / sqrt(2 * pi())) / (n * h)')} AS density
FROM g GROUP BY l_linestatus, point, y, n, h"""
ORACLE["train_test_split"] = """WITH u AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
    CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|42'), 1, 12) AS BIGINT) AS DOUBLE)
      / 281474976710656.0 AS u FROM lineitem),
c AS (SELECT l_returnflag AS s, quantile_cont(u, 0.2) AS cut FROM u GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, CASE WHEN u <= cut THEN 'test' ELSE 'train' END AS split
FROM u JOIN c ON l_returnflag = s"""
ORACLE["chart_scatter"] = "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem"
ORACLE["chart_map"] = """SELECT c_custkey, CAST(c_custkey % 180 - 90 AS DOUBLE) AS latitude,
  CAST(c_nationkey * 14 - 175 AS DOUBLE) AS longitude, c_acctbal FROM customer"""
ORACLE["chart_pie"] = f"""SELECT l_returnflag, {R('sum(l_extendedprice)', 2)} AS value,
  {R('sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem)')} AS share
FROM lineitem GROUP BY l_returnflag"""
ORACLE["chart_corr_heatmap"] = f"SELECT * FROM ({_corr_matrix('lineitem', LINEITEM_NUMERIC)}) WHERE pos1 >= pos2"
ORACLE["chart_anomaly"] = f"""WITH {_zscore_cte(AF)}
SELECT {R('l_quantity')} AS l_quantity, {R('l_extendedprice')} AS l_extendedprice,
  coalesce({' OR '.join(f'z_{c} > 3.0' for c in AF)}, false) AS is_anomaly,
  {R('greatest(' + ', '.join(f'z_{c}' for c in AF) + ')')} AS anomaly_score FROM z"""

# ------------------------------------------------------------------ 2.10 evaluation

RP = "rp AS (SELECT l_extendedprice AS y, l_quantity * 950.0 AS p FROM lineitem)"
ORACLE["eval_regression"] = f"""WITH {RP}, e AS (SELECT y, p, y - p AS e, abs(y - p) AS ae FROM rp)
SELECT {R('avg(ae)', 4)} AS mae, {R('avg(e * e)', 2)} AS mse, {R('sqrt(avg(e * e))', 4)} AS rmse,
  {R('1.0 - avg(e * e) / var_pop(y)')} AS r2, {R('1.0 - var_pop(e) / var_pop(y)')} AS explained_variance,
  {R('median(ae)', 4)} AS median_ae, {R('max(ae)', 4)} AS max_error FROM e"""
ORACLE["eval_residuals"] = f"""WITH {RP}, e AS (SELECT y, p, y - p AS e FROM rp),
s AS (SELECT avg(e) AS m, stddev_pop(e) AS sd, avg(CASE WHEN y <> 0 THEN abs(e) / abs(y) END) AS mape FROM e)
SELECT {R('mape', 4)} AS mape, {R('m', 4)} AS residual_mean, {R('sd', 4)} AS residual_std,
  {R('avg(CASE WHEN abs(e) <= 1.28 * sd THEN 1.0 ELSE 0.0 END)', 4)} AS coverage_80pct,
  {R('avg(CASE WHEN abs(e) <= 1.96 * sd THEN 1.0 ELSE 0.0 END)', 4)} AS coverage_95pct FROM e, s GROUP BY mape, m, sd"""

LDOC = """ldoc AS (SELECT l.doc_id, l.quality AS label, CASE WHEN d.n_chars >= 2000 THEN 1 ELSE 0 END AS prediction,
  d.n_chars / (d.n_chars + 2000.0) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
ORACLE["eval_classification"] = f"""WITH {LDOC},
cm AS (SELECT CAST(label AS VARCHAR) AS y, CAST(prediction AS VARCHAR) AS p, CAST(count(*) AS DOUBLE) AS n FROM ldoc GROUP BY 1, 2),
t AS (SELECT y AS c, sum(n) AS t FROM cm GROUP BY 1), q AS (SELECT p AS c, sum(n) AS q FROM cm GROUP BY 1),
tp AS (SELECT y AS c, n AS tp FROM cm WHERE y = p),
per AS (SELECT coalesce(t.c, q.c) AS c, coalesce(t.t, 0) AS t, coalesce(q.q, 0) AS q FROM t FULL JOIN q ON t.c = q.c),
per1 AS (SELECT per.*, coalesce(tp.tp, 0) AS tp FROM per LEFT JOIN tp ON per.c = tp.c),
per2 AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0.0 END AS prec, CASE WHEN t > 0 THEN tp / t ELSE 0.0 END AS rec FROM per1),
per3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM per2),
a AS (SELECT sum(t) AS s, sum(tp) AS c, sum(t * prec) AS wp, sum(t * rec) AS wr, sum(t * f1) AS wf,
        avg(CASE WHEN t > 0 THEN rec END) AS ba, sum(t * q) AS pt, sum(q * q) AS pp, sum(t * t) AS tt FROM per3)
SELECT {R('c / s')} AS accuracy, {R('wp / s')} AS precision, {R('wr / s')} AS recall, {R('wf / s')} AS f1,
  {R('ba')} AS balanced_accuracy,
  {R('CASE WHEN sqrt((s * s - pp) * (s * s - tt)) > 0 THEN (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0.0 END')} AS mcc,
  {R('CASE WHEN pt / (s * s) < 1 THEN (c / s - pt / (s * s)) / (1 - pt / (s * s)) ELSE 0.0 END')} AS cohen_kappa
FROM a"""
_HIST = """h AS (SELECT score AS s, sum(CASE WHEN CAST(label AS VARCHAR) = '1' THEN 1.0 ELSE 0.0 END) AS npos,
  sum(CASE WHEN CAST(label AS VARCHAR) = '1' THEN 0.0 ELSE 1.0 END) AS nneg FROM ldoc GROUP BY score)"""
ORACLE["eval_roc_auc"] = f"""WITH {LDOC}, {_HIST},
c AS (SELECT *, sum(nneg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cum FROM h)
SELECT {R('CASE WHEN sum(npos) > 0 AND sum(nneg) > 0 THEN sum(npos * (cum - nneg + 0.5 * nneg)) / (sum(npos) * sum(nneg)) END')} AS roc_auc
FROM c"""
ORACLE["eval_pr_auc"] = f"""WITH {LDOC}, {_HIST},
c AS (SELECT *, sum(npos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
               sum(nneg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn FROM h)
SELECT {R('sum(CASE WHEN npos > 0 THEN npos / (SELECT sum(npos) FROM h) * (cp / (cp + cn)) ELSE 0.0 END)')} AS pr_auc FROM c"""
ORACLE["eval_log_loss"] = f"""WITH {LDOC}
SELECT {R("avg(-ln(least(greatest(CASE WHEN CAST(label AS VARCHAR) = '1' THEN score ELSE 1 - score END, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))")} AS log_loss
FROM ldoc"""
ORACLE["predict_vs_actual"] = f"""WITH {RP}, r AS (SELECT regr_slope(p, y) AS slope, regr_intercept(p, y) AS intercept FROM rp)
SELECT {R('y', 4)} AS actual, {R('p', 4)} AS predicted, {R('intercept + slope * y', 4)} AS trend,
  {R('slope', 4)} AS slope, {R('intercept', 4)} AS intercept FROM rp, r"""

# ------------------------------------------------------------------ 2.8 cluster metrics

ORACLE["cluster_sizes"] = f"""WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY c_mktsegment)
SELECT c_mktsegment, size, {R('(SELECT stddev_pop(size) / avg(size) FROM s)')} AS balance FROM s"""
EMB = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
cs AS (SELECT label, i, sum(v) AS s FROM d GROUP BY label, i),
cn AS (SELECT label, count(*) AS n, sum(list_sum(list_transform(x, lambda t: t * t))) AS q FROM e GROUP BY label),
tot AS (SELECT i, sum(s) AS s FROM cs GROUP BY i),
nn AS (SELECT sum(n) AS n, count(*) AS k FROM cn),
wc AS (SELECT sum(q) - (SELECT sum(ss / n) FROM (SELECT cs.label, sum(s * s) AS ss FROM cs GROUP BY cs.label) x
                          JOIN cn ON x.label = cn.label) AS wcss FROM cn),
bc AS (SELECT sum(cn.n * (cs.s / cn.n - tot.s / nn.n) * (cs.s / cn.n - tot.s / nn.n)) AS bcss
       FROM cs JOIN cn ON cs.label = cn.label JOIN tot ON cs.i = tot.i CROSS JOIN nn)"""
ORACLE["cluster_wcss_ratio"] = f"""WITH {EMB}
SELECT {R('wcss', 4)} AS wcss, {R('bcss', 4)} AS bcss,
  {R('CASE WHEN wcss + bcss > 0 THEN bcss / (wcss + bcss) ELSE 0.0 END', 4)} AS variance_ratio FROM wc, bc"""
ORACLE["cluster_calinski_harabasz"] = f"""WITH {EMB}
SELECT {R('(bcss / (k - 1)) / (wcss / (n - k))')} AS calinski_harabasz FROM wc, bc, nn"""
ORACLE["cluster_davies_bouldin"] = f"""WITH {EMB},
cent AS (SELECT cs.label, cs.i, cs.s / cn.n AS mu FROM cs JOIN cn ON cs.label = cn.label),
pd AS (SELECT d.vec_id, d.label, sqrt(sum((d.v - cent.mu) * (d.v - cent.mu))) AS dist
       FROM d JOIN cent ON d.label = cent.label AND d.i = cent.i GROUP BY d.vec_id, d.label),
sp AS (SELECT label, avg(dist) AS s FROM pd GROUP BY label),
cd AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.mu - b.mu) * (a.mu - b.mu))) AS dd
       FROM cent a JOIN cent b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label),
w AS (SELECT la, max((sa.s + sb.s) / dd) AS worst FROM cd JOIN sp sa ON cd.la = sa.label JOIN sp sb ON cd.lb = sb.label GROUP BY la)
SELECT {R('avg(worst)')} AS davies_bouldin FROM w"""
ORACLE["cluster_silhouette"] = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
pr AS (SELECT a.vec_id, a.label AS la, b.label AS lb,
         sum(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS sd
       FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
m AS (SELECT pr.vec_id, pr.la, pr.lb,
        CASE WHEN pr.la = pr.lb THEN pr.sd / (n.n - 1) ELSE pr.sd / n.n END AS md FROM pr JOIN n ON pr.lb = n.label),
ab AS (SELECT vec_id, la, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM m GROUP BY vec_id, la),
s AS (SELECT ab.vec_id, CASE WHEN n.n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
      FROM ab JOIN n ON ab.la = n.label)
SELECT {R('avg(s)')} AS silhouette FROM s"""
ORACLE["cluster_silhouette_squared"] = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
pr AS (SELECT a.vec_id, a.label AS la, b.label AS lb,
         sum(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS sd
       FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
m AS (SELECT pr.vec_id, pr.la, pr.lb,
        CASE WHEN pr.la = pr.lb THEN pr.sd / (n.n - 1) ELSE pr.sd / n.n END AS md FROM pr JOIN n ON pr.lb = n.label),
ab AS (SELECT vec_id, la, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM m GROUP BY vec_id, la),
s AS (SELECT ab.vec_id, CASE WHEN n.n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
      FROM ab JOIN n ON ab.la = n.label)
SELECT {R('avg(s)')} AS silhouette FROM s"""


# ------------------------------------------------------------------ 2.1 sources and sinks

ORACLE["scan_csv"] = "SELECT * FROM part"
ORACLE["scan_csv_encodings"] = "SELECT c_custkey, c_name || ' né' AS c_name, c_nationkey FROM customer"
ORACLE["load_metadata"] = f"""SELECT 'lineitem' AS source, (SELECT count(*) FROM lineitem) AS rows, {len(LM_COLS)} AS columns,
  quality_score FROM ({ORACLE['quality_score']})"""
ORACLE["scan_json"] = "SELECT * FROM customer"
ORACLE["sink_csv"] = ORACLE["filter_conjunction"]
_LI_CELLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in LI_COLS if c != "l_returnflag")
_LI_QUALITY = ("greatest(0.0, least(100.0, 100.0 - missing_cells / (rows * 11) * 30 - dups / rows * 20 "
               "+ ((10 + (CASE WHEN u_ls < rows * 0.8 THEN 1 ELSE 0 END)) / 11.0) * 10))")
_LI_FOLDERS = f"""WITH g AS (
  SELECT l_returnflag, count(*) AS rows, sum({_LI_CELLS}) AS missing_cells,
         count(DISTINCT l_linestatus) AS u_ls FROM lineitem GROUP BY l_returnflag),
d AS (SELECT l_returnflag, sum(n - 1) AS dups FROM (
        SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL_COLS) GROUP BY l_returnflag)
""".replace("ALL_COLS", ", ".join(LI_COLS))
ORACLE["scan_batch"] = f"""{_LI_FOLDERS}SELECT g.l_returnflag, g.rows,
  {R(_LI_QUALITY)} AS quality_score
FROM g JOIN d ON g.l_returnflag = d.l_returnflag"""
ORACLE["batch_summary"] = f"""{_LI_FOLDERS}SELECT count(*) AS files, CAST(sum(g.rows) AS BIGINT) AS total_rows,
  {R(f'avg({_LI_QUALITY})')} AS avg_quality
FROM g JOIN d ON g.l_returnflag = d.l_returnflag"""


def _profile_report(d=4):
    cols = LM_COLS
    nums = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount"]
    cats = ["l_returnflag", "l_linestatus"]
    cells = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in cols)
    nul = "CAST(NULL AS VARCHAR)"
    parts = [
        f"SELECT 'basic_info' AS section, {nul} AS \"column\", 'rows' AS metric, {R('count(*)', d)} AS num_value, {nul} AS str_value FROM p",
        f"SELECT 'basic_info', {nul}, 'columns', {R(str(len(cols)), d)}, {nul}",
        f"SELECT 'basic_info', {nul}, 'missing_values', {R(f'sum({cells})', d)}, {nul} FROM p",
        f"SELECT 'basic_info', {nul}, 'duplicates', {R('sum(n - 1)', d)}, {nul} FROM "
        f"(SELECT count(*) AS n FROM p GROUP BY {', '.join(cols)})",
    ]
    for c in nums:
        x = f"CAST({c} AS DOUBLE)"
        q = f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM p)"
        outl = (f"(SELECT count(*) FROM p, {q} qq WHERE {x} < qq.q1 - 1.5 * (qq.q3 - qq.q1) "
                f"OR {x} > qq.q3 + 1.5 * (qq.q3 - qq.q1))")
        for m, e in (("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("skewness", f"skewness({x})"),
                     ("kurtosis", f"kurtosis({x})"), ("outliers_count", outl)):
            src = "" if m == "outliers_count" else " FROM p"
            parts.append(f"SELECT 'numeric_analysis', '{c}', '{m}', {R(e, d)}, {nul}{src}")
    for c in cats:
        vc = f"(SELECT {c} AS v, count(*) AS f FROM p WHERE {c} IS NOT NULL GROUP BY {c})"
        parts.append(f"SELECT 'categorical_analysis', '{c}', 'unique_values', {R('count(*)', d)}, {nul} FROM {vc}")
        parts.append(f"SELECT 'categorical_analysis', '{c}', 'most_frequent', CAST(NULL AS DOUBLE), "
                     f"(SELECT v FROM {vc} ORDER BY f DESC, v LIMIT 1)")
        parts.append(f"SELECT 'categorical_analysis', '{c}', 'cardinality_ratio', {R('count(*) / sum(f)', d)}, {nul} FROM {vc}")
    pairs = union([f"SELECT '{a}' AS c1, '{b}' AS c2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM p"
                   for i, a in enumerate(nums) for b in nums[i + 1:]])
    parts.append(f"SELECT 'correlations', c1 || ' | ' || c2, 'correlation', {R('r', d)}, {nul} FROM ({pairs}) "
                 f"WHERE abs(r) > 0.7")
    return f"WITH {LM}, p AS (SELECT * FROM lm)\n" + union(parts)


ORACLE["profile_report"] = _profile_report()
ORACLE["sink_json"] = ORACLE["profile_report"]


# ------------------------------------------------------------------ models with a known answer

ORACLE["kmeans_separable"] = ORACLE["kmeans_mini_batch_separable"] = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 3 AS INTEGER) AS cluster FROM lineitem"
ORACLE["rf_separable"] = union([f"SELECT 'RandomForest' AS model, '{m}' AS metric, {R('1.0')} AS value"
                                for m in ("accuracy", "precision", "recall", "f1", "roc_auc", "cohen_kappa")])
ORACLE["rf_deep_separable"] = ORACLE["rf_separable"]
ORACLE["rf_deep_recall"] = f"""SELECT l_orderkey, l_linenumber,
    {R('avg(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber)')} AS prediction FROM lineitem"""
ORACLE["rf_deep_min_split"] = f"""SELECT l_linenumber, {R('avg(l_quantity)')} AS prediction, count(*) AS n, true AS split_of_two
    FROM lineitem GROUP BY l_linenumber UNION ALL
    SELECT l_linenumber, {R('(SELECT avg(l_quantity) FROM lineitem)')}, count(*), false FROM lineitem GROUP BY l_linenumber"""
ORACLE["mlp_separable"] = ORACLE["mlp_separable_text"] = ORACLE["rf_separable"].replace("'RandomForest'", "'MLP'")
ORACLE["isolation_forest_planted"] = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 200 = 0"


def _anova(features, label, k):
    parts = [f"""SELECT '{c}' AS feature, (ssb / (g - 1)) / ((sst - ssb) / (n - g)) AS f FROM (
    SELECT sum(n) AS n, count(*) AS g, sum(n * (m - gm) * (m - gm)) AS ssb, max(sst) AS sst FROM (
      SELECT count(*) AS n, avg({c}) AS m, (SELECT avg({c}) FROM lineitem) AS gm,
             (SELECT var_pop({c}) * count(*) FROM lineitem) AS sst FROM lineitem GROUP BY {label}))""" for c in features]
    return f"WITH f AS ({union(parts)}) SELECT feature, row_number() OVER (ORDER BY f DESC) <= {k} AS selected FROM f"


ORACLE["select_k_best"] = _anova(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"], "l_linenumber", 2)
