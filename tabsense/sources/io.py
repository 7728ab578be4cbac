"""Sources and sinks.

Reads are plain ``spark.read`` scans (column pruning and filter pushdown stay available to
everything downstream); the encoding check is one aggregate over the string columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.schema import categorical_columns, qcol
from tabsense.operators.normalize import normalize_table
from tabsense.operators.profile import quality_score

FALLBACK_ENCODING = "ISO-8859-1"  # accepts every byte and keeps it as one character


def _decoded(df: DataFrame) -> DataFrame:
    """Strings read as ISO-8859-1, decoded as UTF-8 where their bytes are valid UTF-8.

    The choice is made value by value inside the scan's projection: no file is read twice, one
    file in another encoding doesn't touch the others, and a literal U+FFFD stays.
    """
    def name(column: str) -> str:
        try:
            return column.encode(FALLBACK_ENCODING).decode("utf-8")
        except UnicodeError:
            return column

    def value(field: T.StructField):
        c = qcol(field.name)
        if not isinstance(field.dataType, T.StringType):
            return c.alias(name(field.name))
        raw = F.encode(c, FALLBACK_ENCODING).cast("string")
        return F.when(F.is_valid_utf8(raw), raw).otherwise(c).alias(name(field.name))

    return df.select(*[value(f) for f in df.schema.fields])


def scan_csv(spark: SparkSession, path, schema=None, header: bool = True, encoding: str | None = None,
             mode: str = "PERMISSIVE") -> DataFrame:
    """CSV with header; schema inferred unless given.  Without an explicit ``encoding`` each
    value is UTF-8 if its bytes are, else ISO-8859-1."""
    r = spark.read.option("header", header).option("mode", mode).option("encoding", encoding or FALLBACK_ENCODING)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path) if encoding else _decoded(r.csv(path))


def _starts_with_array(spark: SparkSession, path) -> bool:
    """Probe one line of the input: a JSON array starts with '['."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0]["value"].lstrip().startswith("[")


def scan_json(spark: SparkSession, path, schema=None, multi_line: bool | None = None) -> DataFrame:
    """JSON array of records (``multi_line``) or JSON lines; ``None`` detects which from the
    first non-blank line."""
    if multi_line is None:
        multi_line = _starts_with_array(spark, path)
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def scan_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def load_table(spark: SparkSession, path, fmt: str = "parquet", **options) -> DataFrame:
    """Scan + the reference's load-time normalization (clean names, NaN/inf -> NULL)."""
    readers = {"csv": scan_csv, "json": scan_json, "parquet": lambda s, p, **_: scan_parquet(s, p)}
    return normalize_table(readers[fmt](spark, path, **options))


def load_metadata(df: DataFrame, source: str) -> DataFrame:
    """One row about a loaded table: source, load time, rows, columns, quality score."""
    rows = df.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    return quality_score(df).select(
        F.lit(source).alias("source"), F.current_timestamp().alias("loaded_at"), F.lit(rows).cast("long").alias("rows"),
        F.lit(len(df.columns)).alias("columns"), "quality_score")


def with_source_file(df: DataFrame) -> DataFrame:
    """Add ``source_file`` from the scan's hidden ``_metadata`` column."""
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def quality_by(df: DataFrame, by: str) -> DataFrame:
    """Quality score (see profile.quality_score) per group of ``by``: one group-by for rows,
    missing cells and distinct counts, one for duplicate rows."""
    cols = [c for c in df.columns if c != by]
    strings = [c for c in categorical_columns(df) if c != by]
    cells = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("long") for c in cols])
    base = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(cells).alias("missing_cells"),
                              *[F.count_distinct(F.col(f"`{c}`")).alias(f"u|{c}") for c in strings])
    dups = df.groupBy(by, *[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy(by).agg(F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    j = base.join(dups, by)
    n_cols = len(cols)
    consistent = [F.lit(1) if c not in strings else F.when(F.col(f"`u|{c}`") < F.col("rows") * 0.8, 1).otherwise(0)
                  for c in cols]
    share = reduce(lambda a, b: a + b, consistent) / F.lit(float(n_cols))
    raw = (F.lit(100.0) - F.col("missing_cells") / (F.col("rows") * n_cols) * 30
           - F.col("duplicate_rows") / F.col("rows") * 20 + share * 10)
    return j.select(by, "rows", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("quality_score"))


def scan_batch(spark: SparkSession, paths, fmt: str = "parquet", normalize: bool = False, unit: str = "file",
               **options) -> tuple[DataFrame, DataFrame]:
    """Read many files in one scan.  Returns (all rows with ``source_file``, per-file
    (source_file, rows, quality_score)).

    ``unit="folder"`` counts a folder's files as one, named ``source_folder``: what a distributed
    writer leaves as a table is a folder, however many files it holds.

    CSV values are decoded as :func:`scan_csv` does; ``normalize`` also cleans names and turns
    NaN and infinities into NULL, as :func:`load_table` does.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "csv":
        raw = spark.read.options(**{"header": True, "inferSchema": True, "encoding": FALLBACK_ENCODING, **options}).csv(paths)
        files = with_source_file(raw)
        df = files if "encoding" in options else _decoded(files)
    else:
        readers = {"json": lambda: spark.read.options(**options).json(paths),
                   "parquet": lambda: spark.read.options(**options).parquet(*paths)}
        df = with_source_file(readers[fmt]())
    if normalize:
        df = normalize_table(df)
    if unit == "folder":
        folder = F.regexp_extract("source_file", r"^(.*)/[^/]*$", 1)
        return df, quality_by(df.withColumn("source_folder", folder).drop("source_file"), "source_folder")
    if unit != "file":
        raise ValueError(f"unit must be 'file' or 'folder', not {unit!r}")
    return df, quality_by(df, "source_file")


def batch_summary(per_file: DataFrame) -> DataFrame:
    """files, total rows and average quality over the per-file table."""
    return per_file.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("total_rows"),
                        F.avg("quality_score").alias("avg_quality"))


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path
