"""Data behind each chart; rendering is left to the caller.

Aggregated charts (bar, histogram, box, violin, pie) are group-bys whose output is bounded by
the number of categories x bins, so they stay small however large the input is.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.quantiles import beside, kept_groups, quantiles
from tabsense.functions.schema import qcol
from tabsense.functions.stats import count_if, stats_row
from tabsense.operators.normalize import sample_rows
from tabsense.operators.profile import corr_matrix

# The lat/lon column patterns.
HIST_BINS = 20
VIOLIN_GRID = 50
LINE_INTERVALS = 1000
VIOLIN_BINS_PER_BANDWIDTH = 10
LAT_PATTERN = re.compile(r".*(lat|latitude).*", re.IGNORECASE)
LON_PATTERN = re.compile(r".*(lon|lng|long|longitude).*", re.IGNORECASE)


def _x(c):
    return F.col(f"`{c}`").cast("double")


def chart_scatter(df: DataFrame, x: str, y: str, color: str | None = None,
                  max_points: int | None = None, key_cols=None) -> DataFrame:
    """The points of every row; ``max_points`` asks for a seeded sample by ``key_cols``."""
    cols = [x, y] + ([color] if color else [])
    points = df.select(*map(qcol, [*cols, *[k for k in (key_cols or []) if k not in cols]]))
    return points if max_points is None else sample_rows(points, max_points, key_cols)


def chart_line(df: DataFrame, x: str, y: str, color: str | None = None, intervals: int | None = None) -> DataFrame:
    """The points of every row in order of ``x``; ``intervals`` asks for the bounded line of :func:`line_extremes`."""
    if intervals is not None:
        return line_extremes(df, x, y, color, intervals)
    cols = [x, y] + ([color] if color else [])
    return df.select(*map(qcol, cols)).orderBy(qcol(x))


def line_extremes(df: DataFrame, x: str, y: str, color: str | None = None, intervals: int = LINE_INTERVALS) -> DataFrame:
    """``(color, interval, x, y)``: first, last, least and greatest point of each interval of ``x`` (M4).

    The range of ``x`` (numbers, dates or times) is cut into ``intervals`` equal parts; a line drawn through
    these at most four points an interval and color covers the same pixels as one through all rows.  One
    pass finds the range, one aggregation with partial states the points; rows are never sorted as a whole.
    Rows without a place (``x`` or ``y`` null, NaN, or ``x`` infinite) are left out; among equal ``x`` the
    first point is the lower and the last the higher, among equal ``y`` the least is the earlier and the
    greatest the later; a single value of ``x`` is one interval; no rows give no points.
    """
    if intervals < 1:
        raise ValueError("intervals must be at least 1")
    kind = df.schema[x].dataType
    timed = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    place = F.unix_micros(qcol(x).cast("timestamp")).cast("double") if timed else _x(x)
    rows = df.select(*([qcol(color).alias("color")] if color else []), qcol(x).alias("x"), qcol(y).alias("y"),
                     place.alias("place"))
    rows = rows.where(F.col("place").isNotNull() & ~F.isnan("place") & (F.abs("place") != float("inf"))
                      & F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
    ends = rows.agg(F.min("place").alias("lo"), F.max("place").alias("hi")).head()
    lo, hi = ends["lo"] or 0.0, ends["hi"] or 0.0
    at = F.floor((F.col("place") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(intervals))) if hi > lo else F.lit(0)
    at = F.least(at, F.lit(intervals - 1)).cast("int")
    by_x, by_y = F.struct("x", "y"), F.struct("y", "x")
    keys = (["color"] if color else []) + ["interval"]
    found = rows.withColumn("interval", at).groupBy(*keys).agg(
        F.min(by_x).alias("first"), F.max(by_x).alias("last"), F.min(by_y).alias("least"), F.max(by_y).alias("greatest"))
    ends_and_extremes = F.array(*[F.struct(F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"))
                                  for p in ("first", "last", "least", "greatest")])
    points = found.select(*keys, F.explode(F.array_distinct(ends_and_extremes)).alias("p"))
    return points.select(*([F.col("color").alias(color)] if color else []), "interval", F.col("p.x").alias(x), F.col("p.y").alias(y))


def chart_bar(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Stacked bars: sum of y per x (and color)."""
    keys = [x] + ([color] if color else [])
    return df.groupBy(*[qcol(k).alias(k) for k in keys]).agg(F.sum(_x(y)).alias(f"sum_{y}"))


def chart_histogram(df: DataFrame, column: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width counts over [min, max]; the last bin is closed.  All bins are returned."""
    row = stats_row(df, {"lo": F.min(_x(column)), "hi": F.max(_x(column))})
    lo, hi = row["lo"], row["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    idx = F.least(F.lit(bins - 1), F.floor((_x(column) - F.lit(lo)) / F.lit(width)).cast("int"))
    counts = df.where(_x(column).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"))
    return edges.join(F.broadcast(counts), "bin", "left").select(  # at most ``bins`` rows
        "bin", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def _grouped(df: DataFrame, value: str, by: str | None) -> tuple[DataFrame, list[str]]:
    """Non-null values as ``_v`` with the group as ``_g``."""
    group = [qcol(by).alias("_g")] if by else []
    return df.where(_x(value).isNotNull()).select(*group, _x(value).alias("_v")), ["_g"] if by else []


def _per_group(data: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Each value with its group's statistics, which are broadcast (joined in salted copies beyond ``MOST_SENT`` groups)."""
    if keys:
        kept, few = kept_groups(stats)
        return beside(data, kept, keys, few, "_v")
    row = stats.first()
    return data.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in stats.schema.fields})


def _named(df: DataFrame, by: str | None, columns: list[str]) -> DataFrame:
    return df.select(*([F.col("_g").alias(by)] if by else []), *columns)


def chart_box(df: DataFrame, value: str, by: str | None = None, accuracy: int | None = None) -> DataFrame:
    """Per group: Q1, median, Q3, fences (1.5 IQR), whiskers (furthest points inside the
    fences) and the number of points outside them."""
    data, keys = _grouped(df, value, by)
    q = quantiles(data, ["_v"], [0.25, 0.5, 0.75], by=keys, accuracy=accuracy)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                                  for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    wide = wide.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
               .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    fences = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    inside = (F.col("_v") >= F.col("lower_fence")) & (F.col("_v") <= F.col("upper_fence"))
    boxes = _per_group(data, wide, keys).groupBy(*keys, *fences).agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        count_if(~inside).alias("outliers"))
    return _named(boxes, by, [*fences, "whisker_low", "whisker_high", "outliers"])


def chart_violin(df: DataFrame, value: str, by: str | None = None, grid: int = VIOLIN_GRID,
                 bins_per_bandwidth: int = VIOLIN_BINS_PER_BANDWIDTH) -> DataFrame:
    """Gaussian kernel density per group on ``grid`` points from the group min to max.

    Bandwidth: Scott's rule, h = std * n^(-1/5) (sample std).  Binned KDE: one pass builds a
    per-group histogram with bins of h / ``bins_per_bandwidth`` (only bins that hold values
    exist), then each grid point sums the kernel over bin centres weighted by counts.
    A group without spread (one row, or one value) has no density: it is one row, point 0 at
    its value with a NULL density.
    """
    data, keys = _grouped(df, value, by)
    st = data.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"),
                                 F.stddev_samp("_v").alias("sd"), F.count(F.lit(1)).alias("n"))
    st = st.where("n > 0").withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    flat = st.where(~F.coalesce(F.col("h") > 0, F.lit(False))).select(
        *keys, F.lit(0).alias("point"), F.col("lo").alias("y"), F.lit(None).cast("double").alias("density"))
    st = st.where("h > 0")
    nb = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.col("h") * F.lit(bins_per_bandwidth))).cast("long")
    st = st.withColumn("nb", nb).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("nb"))
    j = _per_group(data, st, keys).where("h > 0")
    b = F.least(F.col("nb") - 1, F.floor((F.col("_v") - F.col("lo")) / F.col("w")).cast("long"))
    hist = j.groupBy(*keys, "lo", "hi", "n", "h", "nb", "w", b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("w")
    pts = hist.withColumn("c", centre).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    pts = pts.withColumn("y", F.col("lo") + F.col("point") * ((F.col("hi") - F.col("lo")) / F.lit(grid - 1)))
    u = (F.col("y") - F.col("c")) / F.col("h")
    kern = F.col("cnt") * F.exp(-0.5 * u * u) / F.lit(math.sqrt(2 * math.pi))
    curve = pts.groupBy(*keys, "point", "y", "n", "h").agg(F.sum(kern).alias("_k")).select(
        *keys, "point", "y", (F.col("_k") / (F.col("n") * F.col("h"))).alias("density"))
    return _named(curve.unionByName(flat), by, ["point", "y", "density"])


def chart_pie(df: DataFrame, names: str, values: str) -> DataFrame:
    """Sum of values per name and its share of the total."""
    g = df.groupBy(qcol(names).alias(names)).agg(F.sum(_x(values)).alias("value"))
    total = stats_row(df, {"t": F.sum(_x(values))})["t"]
    return g.withColumn("share", F.col("value") / F.lit(total) if total else F.lit(None).cast("double"))


def chart_corr_heatmap(df: DataFrame, columns=None, lower_triangle: bool = True) -> DataFrame:
    cm = corr_matrix(df, columns)
    return cm.where(F.col("pos1") >= F.col("pos2")) if lower_triangle else cm


def find_lat_lon_columns(columns) -> tuple[str | None, str | None]:
    lat = next((c for c in columns if LAT_PATTERN.match(str(c))), None)
    lon = next((c for c in columns if LON_PATTERN.match(str(c))), None)
    return lat, lon


def chart_map(df: DataFrame, lat: str | None = None, lon: str | None = None,
              max_points: int | None = None, key_cols=None) -> DataFrame:
    """Every located row; ``max_points`` asks for a seeded sample by ``key_cols``."""
    if lat is None or lon is None:
        flat, flon = find_lat_lon_columns(df.columns)
        lat, lon = lat or flat, lon or flon
    if lat is None or lon is None:
        raise ValueError("no latitude/longitude columns")
    pts = df.na.drop(subset=[lat, lon])
    return pts if max_points is None else sample_rows(pts, max_points, key_cols or df.columns)


def chart_anomaly(flagged: DataFrame, x: str, y: str) -> DataFrame:
    return flagged.select(x, y, "is_anomaly", "anomaly_score")
