"""Profiling aggregates.

Design rules:

* a report over many columns is one job: the columns are unpivoted to
  ``(variable, value)`` and grouped once, instead of one job per column;
* group-wise "arg-max" (the modal level, W1) is an aggregate
  ``min(struct(-n, value))`` per variable, so no variable's levels are
  ever sorted inside one task (a high-cardinality column would otherwise
  put all its levels into one window partition);
* totals for shares come from a scalar subquery (computed once, inlined),
  never from a single-partition window or a driver round trip.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from ..functions.missing import is_missing, is_null_or_empty
from ..functions.schema import numeric_columns, string_columns

ROUND = 6


def _round(c: Column) -> Column:
    return F.round(c, ROUND)


def row_count(df: DataFrame) -> Column:
    """Scalar-subquery column holding ``count(*)`` of ``df``."""
    return df.select(F.count(F.lit(1))).scalar()


def melt(df: DataFrame, cols: list[str], ids: list[str] = (), cast: str = "string",
         variable: str = "variable", value: str = "value") -> DataFrame:
    """Unpivot ``cols`` (cast to one type) into ``(ids..., variable, value)``."""
    casted = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols])
    return casted.unpivot(list(ids), list(cols), variable, value)


def level_counts(df: DataFrame, cols: list[str], cast: str = "string") -> DataFrame:
    """``(variable, value, n)`` for every column in one grouped job; NULL is a level."""
    return (melt(df, cols, cast=cast)
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))


# A1 ------------------------------------------------------------------------
def class_distribution(df: DataFrame, target: str = "default") -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", _round(F.col("n") / row_count(df) * 100))


# A2 / A3 / A4 --------------------------------------------------------------
def _missing_report(df: DataFrame, preds: dict[str, Column], keep_zero: bool) -> DataFrame:
    cols = list(preds)
    if not cols:
        return df.sparkSession.createDataFrame([], "variable string, n_missing bigint, pct_missing double")
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(p).alias(c) for c, p in preds.items()])
    long = wide.unpivot(["__n"], cols, "variable", "n_missing")
    if not keep_zero:
        long = long.filter(F.col("n_missing") > 0)
    return long.select("variable", "n_missing",
                       _round(F.try_divide(F.col("n_missing"), F.col("__n")) * 100).alias("pct_missing"))


def null_report(df: DataFrame) -> DataFrame:
    """A2: NULL count and share of every column, one pass."""
    return _missing_report(df, {c: F.col(c).isNull() for c in df.columns}, keep_zero=True)


def string_missing_report(df: DataFrame) -> DataFrame:
    """A3: string columns with NULL / "" / "NaN"; only columns with > 0."""
    types = {f.name: f.dataType for f in df.schema.fields}
    preds = {c: is_missing(c, types[c]) for c in string_columns(df)}
    return _missing_report(df, preds, keep_zero=False)


def numeric_missing_report(df: DataFrame, exclude=("default",)) -> DataFrame:
    """A4: numeric columns with NULL (or NaN for floats); only columns with > 0."""
    types = {f.name: f.dataType for f in df.schema.fields}
    preds = {c: is_missing(c, types[c]) for c in numeric_columns(df, exclude)}
    return _missing_report(df, preds, keep_zero=False)


# A5 ------------------------------------------------------------------------
def type_summary(df: DataFrame, n_examples: int = 3) -> DataFrame:
    """Type -> number of columns and the first names; schema only, no scan."""
    groups: dict[str, list[str]] = {}
    for f in df.schema.fields:
        groups.setdefault(f.dataType.simpleString(), []).append(f.name)
    rows = [(t, len(names), ", ".join(names[:n_examples])) for t, names in groups.items()]
    return df.sparkSession.createDataFrame(rows, "dtype string, n_columns long, examples string")


# A6 ------------------------------------------------------------------------
def cardinality(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Distinct count per column and ratio to the row count (NULL not counted).

    ``approx=True`` switches to HyperLogLog++ (fixed memory per column), the
    right choice for a first look at very large tables.
    """
    fn = F.approx_count_distinct if approx else F.count_distinct
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[fn(c).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "variable", "n_distinct")
    return long.select("variable", "n_distinct",
                       _round(F.try_divide(F.col("n_distinct"), F.col("__n")) * 100).alias("cr_pct"))


# A7 / L1 -------------------------------------------------------------------
def top_levels(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Level frequencies with share, most frequent first (ties by level).

    With ``k`` this is a top-k (TakeOrderedAndProject: each task keeps k rows).
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("pct", _round(F.col("n") / row_count(df) * 100))
    ordered = counts.orderBy(F.col("n").desc(), F.col(col).asc_nulls_first())
    return ordered.limit(k) if k else ordered


# A8 / W1 / J1 --------------------------------------------------------------
def modal_concentration(df: DataFrame, cols: list[str]) -> DataFrame:
    """Dominant level, its share and the number of levels of each column.

    One grouped job over the unpivoted columns, then one aggregate per
    variable: ``min(struct(-n, value))`` is the modal level with ties broken
    by the smallest value (NULL first), ``count(value)`` the distinct count.
    """
    vc = level_counts(df, cols)
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value")))
    agg = vc.groupBy("variable").agg(best.alias("top"),
                                     F.count("value").alias("n_classes"),
                                     F.sum("n").alias("n_rows"))
    return agg.select("variable", "n_classes",
                      F.col("top.value").alias("dominant_class"),
                      (-F.col("top.neg_n")).alias("max_count"),
                      _round(-F.col("top.neg_n") / F.col("n_rows") * 100).alias("max_pct"))


def attach(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Lookup of a small per-key result (one row per column name or
    per level, so bounded by the schema) onto another result."""
    return big.join(F.broadcast(small), key, how)


# A9 ------------------------------------------------------------------------
def categorical_audit(df: DataFrame, descriptions: Mapping[str, str] | None = None,
                      default_text: str = "no description") -> DataFrame:
    """Levels (NULL counted as a level), NULL-or-empty share and a description
    for every string column, from one grouped job."""
    cols = string_columns(df)
    vc = level_counts(df, cols)
    audit = vc.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_levels"),
        F.sum(F.when(is_null_or_empty("value"), F.col("n")).otherwise(0)).alias("n_null_or_empty"),
        F.sum("n").alias("n_rows"))
    audit = audit.select("variable", "n_levels",
                         _round(F.col("n_null_or_empty") / F.col("n_rows") * 100).alias("null_pct"))
    if descriptions is None:
        return audit
    desc = df.sparkSession.createDataFrame(list(descriptions.items()), "variable string, description string")
    return (attach(audit, desc, "variable")
            .withColumn("description", F.coalesce("description", F.lit(default_text))))


# A10 / A11 -----------------------------------------------------------------
def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form; NULL stays a level."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, levels: list) -> DataFrame:
    """Wide form with the given column levels (no extra job to find them)."""
    wide = df.groupBy(a).pivot(b, levels).agg(F.count(F.lit(1)))
    return wide.select(a, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"n_{v}") for v in levels])


def row_percent(long: DataFrame, a: str, count_col: str = "n") -> DataFrame:
    """Share of each cell within its row (window over the small table)."""
    w = Window.partitionBy(a)
    return long.withColumn("row_pct", _round(F.col(count_col) / F.sum(count_col).over(w) * 100))


# A12 -----------------------------------------------------------------------
def level_default_rate(df: DataFrame, col: str, target: str = "default") -> DataFrame:
    """Volume and default rate per level (map-side partial aggregation)."""
    return (df.groupBy(col)
              .agg(F.count(F.lit(1)).alias("n"),
                   _round(F.avg(F.col(target).cast("double"))).alias("default_rate")))


# A15 -----------------------------------------------------------------------
def confusion(df: DataFrame, label: str = "default", prediction: str = "prediction") -> DataFrame:
    """One row (tn, fp, fn, tp) from one aggregate (prediction may be double)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"),
                  F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_long(df: DataFrame, label: str = "default", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(F.col(label).cast("int").alias(label),
                       F.col(prediction).cast("int").alias(prediction))
              .agg(F.count(F.lit(1)).alias("n")))


# A16 / F7 ------------------------------------------------------------------
def class_weights(df: DataFrame, target: str = "default", rounded: bool = True) -> DataFrame:
    """Balancing weight N / (2 * n_c) per class (rounded for reports)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    w = row_count(df).cast("double") / (F.col("n") * 2.0)
    return counts.withColumn("weight", _round(w) if rounded else w)


def with_class_weights(df: DataFrame, target: str = "default", out: str = "weight") -> DataFrame:
    """Attach the exact class weight to every row (broadcast of one row per
    class)."""
    w = class_weights(df, target, rounded=False).select(target, F.col("weight").alias(out))
    return df.join(F.broadcast(w), target, "left")


# W2 ------------------------------------------------------------------------
def numbered(result: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1..n numbering of an already small, bounded result (e.g. a top-20)."""
    return result.withColumn(name, F.row_number().over(Window.orderBy(*order)))
