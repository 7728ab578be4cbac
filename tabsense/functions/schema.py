"""Driver-side schema helpers: type groups and column-name rules (no data is read)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The column-name rule of the reference (every non-word character becomes
# "_", then leading/trailing "_" are stripped; SQL-safe form prefixes "col_" to a leading
# digit and uses "unknown_column" for an empty name).
NON_WORD = re.compile(r"[^\w]")
SQL_DIGIT_PREFIX = "col_"
EMPTY_NAME = "unknown_column"

DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def qcol(name: str):
    """Column by exact name (backtick-quoted, so spaces, dots and symbols are literal)."""
    from pyspark.sql import functions as F
    return F.col("`" + str(name).replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIME_TYPES)


def type_group(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if is_string(dtype):
        return "categorical"
    if is_datetime(dtype):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType) and f.name not in exclude]


def datetime_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in exclude]


def dtype_name(dtype: T.DataType) -> str:
    return dtype.simpleString()


def clean_name(name: str) -> str:
    """Reference rule: non-word characters to "_", strip "_"; then make it SQL-safe."""
    cleaned = NON_WORD.sub("_", str(name)).strip("_")
    if not cleaned:
        return EMPTY_NAME
    if cleaned[0].isdigit():
        cleaned = SQL_DIGIT_PREFIX + cleaned
    return cleaned


def clean_names(names: list[str]) -> list[str]:
    """Clean every name and de-duplicate collisions with a numeric suffix (_2, _3, ...)."""
    out: list[str] = []
    seen: set[str] = set()
    for name in names:
        base = clean_name(name)
        candidate, k = base, 2
        while candidate.lower() in seen:
            candidate = f"{base}_{k}"
            k += 1
        seen.add(candidate.lower())
        out.append(candidate)
    return out


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}; available: {df.columns}")
