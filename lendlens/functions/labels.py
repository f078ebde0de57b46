"""Verdict labels and display text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Effect-size bands (Cohen) and significance thresholds.
EFFECT_BANDS = [(0.1, "Negligible"), (0.3, "Small"), (0.5, "Medium")]
EFFECT_TOP = "Large"
STAR_LEVELS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
NOT_SIGNIFICANT = "ns"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def effect_band(col) -> Column:
    c = _c(col)
    expr = None
    for bound, label in EFFECT_BANDS:
        expr = F.when(c < bound, label) if expr is None else expr.when(c < bound, label)
    return expr.otherwise(EFFECT_TOP)


def stars(p) -> Column:
    c = _c(p)
    expr = None
    for bound, label in STAR_LEVELS:
        expr = F.when(c < bound, label) if expr is None else expr.when(c < bound, label)
    return expr.otherwise(NOT_SIGNIFICANT)


def p_text(p) -> Column:
    """``< 0.001***`` below 0.001, else four decimals followed by stars;
    non-significant values carry `` (ns)``."""
    c = _c(p)
    return (F.when(c < 0.001, F.lit("< 0.001***"))
            .when(c < 0.01, F.concat(F.format_number(c, 4), F.lit("**")))
            .when(c < 0.05, F.concat(F.format_number(c, 4), F.lit("*")))
            .otherwise(F.concat(F.format_number(c, 4), F.lit(" (ns)"))))


def yes_no(cond: Column, yes: str = "yes", no: str = "no") -> Column:
    return F.when(cond, yes).otherwise(no)


def thousands(col, decimals: int = 2) -> Column:
    """Thousands separators with fixed decimals (display only)."""
    return F.format_number(_c(col), decimals)
