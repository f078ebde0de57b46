"""Column lists by data type (P22), read from the schema only (no scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType, StringType


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Every numeric type, including ``bigint`` (which a dtype-name list of
    'double'/'int'/'long' silently misses)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]
