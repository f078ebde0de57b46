"""One definition of "missing" (the study uses four spellings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StringType

# Text spellings of a missing value in string columns.
MISSING_TEXT = ["", "NaN"]


def is_missing(col: str | Column, dtype: DataType, text_tokens=MISSING_TEXT) -> Column:
    """NULL for every type; NaN for floating types; "" / "NaN" for strings."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(dtype, StringType) and text_tokens:
        return c.isNull() | c.isin(*text_tokens)
    return c.isNull()


def is_null_or_empty(col: str | Column) -> Column:
    """The audit's narrower rule (NULL or empty string)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | (c == "")
