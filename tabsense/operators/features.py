"""Feature engineering and preprocessing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.ordered import cumulative_sums
from tabsense.functions.quantiles import beside, kept_groups, quantiles
from tabsense.functions.schema import categorical_columns, numeric_columns, qcol
from tabsense.functions.stats import stats_row
from tabsense.operators.normalize import seeded_digest

# The bin labels.
BIN_LABELS = ["Low", "Low-Med", "Medium", "Med-High", "High"]
NULL_TEXT = "nan"
BROADCAST_MAX_ROWS = 1_000_000
LOCAL_INDEX_MAX = 100_000  # distinct values numbered on the driver (proven by a bounded probe)


def _x(c):
    return F.col(f"`{c}`").cast("double")


def _numeric(df, target=None, columns=None):
    cols = list(columns) if columns else numeric_columns(df)
    return [c for c in cols if c != target]


def _stds(df, cols) -> dict:
    row = stats_row(df, {c: F.stddev_samp(_x(c)) for c in cols})
    return {c: row[c] for c in cols}


def feat_polynomial(df: DataFrame, target=None, columns=None, stds=None) -> DataFrame:
    """``x_squared`` and ``x_log`` = log1p(|x|) for every numeric column with std > 0."""
    cols = _numeric(df, target, columns)
    stds = stds if stds is not None else _stds(df, cols)
    new = {}
    for c in cols:
        if stds.get(c):
            new[f"{c}_squared"] = _x(c) * _x(c)
            new[f"{c}_log"] = F.log1p(F.abs(_x(c)))
    return df.withColumns(new) if new else df


def feat_interactions(df: DataFrame, target=None, columns=None, stds=None) -> DataFrame:
    """``a_x_b`` for every pair of numeric columns that both vary (``columns`` chooses fewer)."""
    cols = _numeric(df, target, columns)
    stds = stds if stds is not None else _stds(df, cols)
    varying = [c for c in cols if stds.get(c)]
    new = {f"{a}_x_{b}": _x(a) * _x(b) for a, b in combinations(varying, 2)}
    return df.withColumns(new) if new else df


def bin_expr(c: str, lo, hi, labels=BIN_LABELS):
    """Equal-width, right-closed bins over [lo, hi]; the minimum falls in the first bin; a
    constant column falls in the middle bin."""
    n = len(labels)
    arr = F.array(*[F.lit(s) for s in labels])
    if lo is None:
        return F.lit(None).cast("string")
    if hi == lo:
        return F.when(_x(c).isNotNull(), F.lit(labels[n // 2]))
    w = (hi - lo) / n
    idx = F.least(F.lit(n), F.greatest(F.lit(1), F.ceil((_x(c) - F.lit(lo)) / F.lit(w)).cast("int")))
    return F.when(_x(c).isNotNull(), F.element_at(arr, idx))


def feat_bins(df: DataFrame, target=None, columns=None, minmax=None) -> DataFrame:
    """``x_binned`` labels Low..High for every numeric column."""
    cols = _numeric(df, target, columns)
    if not cols:
        return df
    if minmax is None:
        row = stats_row(df, {**{f"lo|{c}": F.min(_x(c)) for c in cols}, **{f"hi|{c}": F.max(_x(c)) for c in cols}})
        minmax = {c: (row[f"lo|{c}"], row[f"hi|{c}"]) for c in cols}
    return df.withColumns({f"{c}_binned": bin_expr(c, *minmax[c]) for c in cols})


def feature_engineering(df: DataFrame, target=None, columns=None) -> DataFrame:
    """Polynomial, interaction and bin features from one statistics pass (std, min, max)."""
    cols = _numeric(df, target, columns)
    exprs = {}
    for c in cols:
        exprs[f"s|{c}"] = F.stddev_samp(_x(c))
        exprs[f"lo|{c}"] = F.min(_x(c))
        exprs[f"hi|{c}"] = F.max(_x(c))
    row = stats_row(df, exprs) if exprs else {}
    stds = {c: row[f"s|{c}"] for c in cols}
    minmax = {c: (row[f"lo|{c}"], row[f"hi|{c}"]) for c in cols}
    out = feat_polynomial(df, target, cols, stds)
    out = feat_interactions(out, target, cols, stds)
    return feat_bins(out, target, cols, minmax)


def label_index(df: DataFrame, column: str, max_local: int = LOCAL_INDEX_MAX) -> DataFrame:
    """(value, index): alphabetical 0-based index of the distinct values, NULL as 'nan'.

    A bounded probe (``orderBy(value).limit(max_local + 1)``, at most that many rows per task)
    decides the strategy: up to ``max_local`` values are numbered from the probe itself;
    beyond that the distinct values are numbered by a range-partitioned running count (no
    single-partition window), so the mapping scales with the number of distinct values.
    """
    return label_mapping(df, column, max_local)[0]


def label_mapping(df: DataFrame, column: str, max_local: int = LOCAL_INDEX_MAX):
    """(mapping DataFrame (value, index), number of values if it was numbered locally)."""
    vals = df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(NULL_TEXT)).alias("value")).distinct()
    head = [r["value"] for r in vals.orderBy("value").limit(max_local + 1).collect()]
    if len(head) <= max_local:
        local = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(head)], "value string, index int")
        return local, len(head)
    numbered = cumulative_sums(vals.withColumn("_one", F.lit(1)), "value", ["_one"])
    return numbered.select("value", (F.col("cum__one") - 1).cast("int").alias("index")), None


def label_encode(df: DataFrame, columns=None, suffix: str = "") -> DataFrame:
    """Replace (or add with ``suffix``) each string column by its alphabetical index.
    Mappings numbered locally (bounded by the probe) are broadcast; larger ones shuffle."""
    cols = list(columns) if columns else categorical_columns(df)
    out = df
    for c in cols:
        mapping, n = label_mapping(df, c)
        m = mapping.withColumnRenamed("value", "_v").withColumnRenamed("index", "_idx")
        m = F.broadcast(m) if n is not None and n <= BROADCAST_MAX_ROWS else m
        key = F.coalesce(qcol(c).cast("string"), F.lit(NULL_TEXT))
        out = out.withColumn("_k", key).join(m, F.col("_k") == F.col("_v"), "left").drop("_k", "_v")
        out = out.withColumn(f"{c}{suffix}" if suffix else c, F.col("_idx")).drop("_idx")
    return out


def standard_scale(df: DataFrame, columns=None) -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1."""
    cols = list(columns) if columns else numeric_columns(df)
    row = stats_row(df, {**{f"m|{c}": F.avg(_x(c)) for c in cols}, **{f"s|{c}": F.stddev_pop(_x(c)) for c in cols}})
    new = {}
    for c in cols:
        m, s = row[f"m|{c}"], row[f"s|{c}"]
        new[c] = (_x(c) - F.lit(m)) / F.lit(s if s else 1.0)
    return df.withColumns(new)


def adaptive_test_fraction(n_rows: int) -> float:
    """Test share min(0.3, max(0.1, 1000 / n)) used by the reference's forest trainer."""
    return min(0.3, max(0.1, 1000.0 / n_rows)) if n_rows else 0.2


def train_test_split(df: DataFrame, key_cols, test_fraction: float | str = 0.2, seed: int = 42,
                     stratify: str | None = None, n_rows: int | None = None) -> DataFrame:
    """Add ``split`` ('train' / 'test') from a seeded hash (MD5) of the key columns.

    Unstratified: hash share below the fraction.  Stratified: per class, the exact
    ``test_fraction`` quantile of the hash is the cut; the cuts are broadcast, or joined in salted
    copies where there are very many classes.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    if test_fraction == "adaptive":
        n_rows = df.count() if n_rows is None else n_rows
        test_fraction = adaptive_test_fraction(n_rows)
    u = F.conv(F.substring(seeded_digest(keys, seed), 1, 12), 16, 10).cast("double") / F.lit(16.0 ** 12)
    tagged = df.withColumn("_u", u)
    if not stratify:
        return tagged.withColumn("split", F.when(F.col("_u") < test_fraction, "test").otherwise("train")).drop("_u")
    cuts, few = kept_groups(quantiles(tagged, ["_u"], [test_fraction], by=[stratify])
                            .select(qcol(stratify), F.col("quantile").alias("_cut")))
    joined = beside(tagged, cuts, [stratify], few, "_u", "left")
    return joined.withColumn("split", F.when(F.col("_u") <= F.col("_cut"), "test").otherwise("train")) \
        .drop("_u", "_cut")


def select_k_best(df: DataFrame, features, label: str, k: int = 20, min_features: int = 0,
                  classification: bool = True) -> DataFrame:
    """Keep the ``k`` features with the best univariate F statistic; returns (feature, selected).
    A caller may keep all features when there are at most ``min_features``."""
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
    feats = list(features)
    spark = df.sparkSession
    if len(feats) <= min_features:
        return spark.createDataFrame([(f, True) for f in feats], "feature string, selected boolean")
    va = VectorAssembler(inputCols=feats, outputCol="_features", handleInvalid="skip")
    sel = UnivariateFeatureSelector(featuresCol="_features", labelCol=label, selectionMode="numTopFeatures",
                                    outputCol="_selected")
    sel.setFeatureType("continuous").setLabelType("categorical" if classification else "continuous")
    sel.setSelectionThreshold(k)
    model = sel.fit(va.transform(df.select(*feats, qcol(label).cast("double").alias(label))))
    chosen = set(model.selectedFeatures)
    return spark.createDataFrame([(f, i in chosen) for i, f in enumerate(feats)], "feature string, selected boolean")
