"""Categorical association.

All string columns are unpivoted and counted against the target in one
grouped job: ``(variable, value, n, n1)``.  Margins are per-variable sums
over that small table, the chi-square statistic is one more aggregate, and
p-values / critical values are computed on the one-row-per-variable
summary only.  No crosstab is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, special
from ..functions.schema import string_columns
from .profile import melt

ROUND = 6


def _r(c: Column) -> Column:
    return F.round(c, ROUND)


def target_counts(df: DataFrame, cols: list[str], target: str = "default", nulls: str = "drop") -> DataFrame:
    """``(variable, value, n, n1)`` of string columns vs a binary target.

    ``nulls='drop'`` drops the NULL level of each column (row-wise for that
    column only); ``nulls='level'`` keeps NULL as a level.
    """
    m = melt(df, cols, ids=[target], cast="string")
    if nulls == "drop":
        m = m.filter(F.col("value").isNotNull())
    tc = m.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum(F.col(target).cast("long")).alias("n1"))
    # read twice (margins and cells): write once to the shared checkpoint folder
    from ..sources.tables import materialize
    return materialize(tc, "level-target-counts")


def chi_square_vs_target(tc: DataFrame, min_levels: int = 2) -> DataFrame:
    """Chi-square of each ``level x target`` table, dof, Cramér's V.

    The expected count of a cell is row total * class total / n.  A 2x2
    table gets Yates' correction (each |O - E| reduced by min(0.5, |O - E|)),
    as the usual contingency test does.  Variables with fewer than
    ``min_levels`` levels are skipped.
    """
    # one row per variable (bounded by the schema) -> broadcast, no window
    # over a variable's levels (a high-cardinality column would put all its
    # levels into one task).
    tot = tc.groupBy("variable").agg(F.sum("n").alias("tot_n"), F.sum("n1").alias("tot_n1"),
                                     F.count(F.lit(1)).alias("n_levels"))
    t = tc.join(F.broadcast(tot), "variable")
    t = t.filter(F.col("n_levels") >= min_levels)
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    tn, tn1 = F.col("tot_n").cast("double"), F.col("tot_n1").cast("double")
    n_classes = F.when(F.col("tot_n1") > 0, 1).otherwise(0) + F.when(F.col("tot_n") > F.col("tot_n1"), 1).otherwise(0)
    yates = (F.col("n_levels") == 2) & (n_classes == 2)

    def term(obs: Column, exp: Column) -> Column:
        d = F.abs(obs - exp)
        d = F.when(yates, d - F.least(F.lit(0.5), d)).otherwise(d)
        return F.when(exp > 0, d * d / exp).otherwise(F.lit(0.0))

    e1 = n * tn1 / tn
    e0 = n * (tn - tn1) / tn
    cells = t.select("variable", "tot_n", "n_levels", n_classes.alias("n_classes"),
                     (term(n1, e1) + term(n - n1, e0)).alias("contrib"))
    s = cells.groupBy("variable").agg(F.first("tot_n").alias("n"), F.first("n_levels").alias("n_levels"),
                                      F.first("n_classes").alias("n_classes"), F.sum("contrib").alias("chi2"))
    k = F.least(F.col("n_levels"), F.col("n_classes"))
    v = F.when(k > 1, F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (k - 1)))).otherwise(F.lit(0.0))
    return s.select("variable", "n", "n_levels",
                    ((F.col("n_levels") - 1) * (F.col("n_classes") - 1)).cast("long").alias("dof"),
                    F.col("chi2"), v.alias("cramers_v"))


def chi_square_table(df: DataFrame, cols: list[str] | None = None, target: str = "default",
                     nulls: str = "drop") -> DataFrame:
    """T1 (``nulls='drop'``) or T1b (``nulls='level'``), rounded for reports."""
    cols = cols if cols is not None else string_columns(df, exclude=(target,))
    if nulls == "level":
        res = chi_square_vs_target(target_counts(df, cols, target, "level"), min_levels=1)
    else:
        res = chi_square_vs_target(target_counts(df, cols, target, "drop"))
    return res.select("variable", "n", "n_levels", "dof", _r(F.col("chi2")).alias("chi2"),
                      _r(F.col("cramers_v")).alias("cramers_v"))


def holm(summary: DataFrame, p: str = "p_value", out: str = "p_holm") -> DataFrame:
    """T4 (W4): Holm step-down adjustment.

    ``summary`` has one row per tested variable (bounded by the schema), so
    one ordered window over it is fine: adj_(i) = min(1, max_{j<=i} (m-j+1) p_(j)).
    """
    order = Window.orderBy(F.col(p), F.col("variable"))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = summary.withColumn("__i", F.row_number().over(order)).withColumn("__m", m)
    scaled = (F.col("__m") - F.col("__i") + 1) * F.col(p)
    running = Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranked.withColumn(out, F.least(F.lit(1.0), F.max(scaled).over(running)))
                  .drop("__i", "__m"))


def categorical_association(df: DataFrame, target: str = "default", cols: list[str] | None = None,
                            nulls: str = "drop", alpha: float = 0.05) -> DataFrame:
    """Chi-square, dof, critical value, Holm-adjusted p, Cramér's V and
    its effect band for every string column, sorted by V."""
    cols = cols if cols is not None else string_columns(df, exclude=(target,))
    res = chi_square_vs_target(target_counts(df, cols, target, nulls),
                               min_levels=2 if nulls == "drop" else 1)
    res = res.withColumn("critical_value", special.chi2_critical(alpha, F.col("dof")))
    res = res.withColumn("p_value", special.chi2_sf(F.col("chi2"), F.col("dof")))
    res = holm(res)
    return (res.select("variable", "n", "dof", _r(F.col("chi2")).alias("chi2"),
                       F.round("critical_value", 4).alias("critical_value"),
                       _r(F.col("p_value")).alias("p_value"), _r(F.col("p_holm")).alias("p_holm"),
                       labels.p_text("p_holm").alias("p_text"),
                       labels.stars("p_holm").alias("significance"),
                       _r(F.col("cramers_v")).alias("cramers_v"),
                       labels.effect_band("cramers_v").alias("effect"))
               .orderBy(F.col("cramers_v").desc(), "variable"))


def pair_association(df: DataFrame, a: str, b: str, redundant_at: float = 0.86, alpha: float = 0.05) -> DataFrame:
    """Association of two categoricals, its critical value and effect
    band, and a nesting test.

    Uses chi2 = n * (sum O^2 / (R_i C_j) - 1), which needs only the observed
    cells (unobserved cells of the r x c table contribute through the -1).  In
    a 2x2 table all four |O - E| are one d, so the continuity correction scales
    chi2 by ((d - min(d, 0.5)) / d)^2.  ``nested`` is true when every level of
    ``b`` occurs with one level of ``a`` only (the sub-grade / grade
    situation).  The counts are one grouped job, written once; margins come
    from them.
    """
    from ..sources.tables import materialize
    cells = materialize(df.select(a, b).dropna().groupBy(a, b).agg(F.count(F.lit(1)).alias("o")), "pair-counts")
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"), F.count(F.lit(1)).alias("a_per_b"))
    full = cells.join(ra, a).join(cb, b)
    o = F.col("o").cast("double")
    agg = full.agg(F.sum(o * o / (F.col("ra") * F.col("cb"))).alias("q"),
                   F.sum("o").alias("n"), F.min("ra").cast("double").alias("r_min"), F.min("cb").cast("double").alias("c_min"),
                   F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"),
                   (F.max("a_per_b") == 1).alias("nested"))
    n = F.col("n").cast("double")
    plain = F.greatest(F.lit(0.0), n * (F.col("q") - 1))
    # chi2 = d^2 * n^3 /
    scale = F.try_divide(F.pow(n, 3), F.col("r_min") * (n - F.col("r_min")) * F.col("c_min") * (n - F.col("c_min")))
    d = F.sqrt(F.try_divide(plain, scale))
    two = (F.col("r") == 2) & (F.col("c") == 2)
    sums = agg.withColumn("chi2", F.when(two, F.pow(d - F.least(F.lit(0.5), d), 2) * scale).otherwise(plain))
    k = F.least("r", "c")
    v = F.when(k > 1, F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (k - 1)))).otherwise(F.lit(0.0))
    dof = ((F.col("r") - 1) * (F.col("c") - 1)).cast("long")
    out = sums.select("n", "chi2", dof.alias("dof"), v.alias("v"), "nested")
    return out.select(F.lit(f"{a} x {b}").alias("variable"), "n", _r(F.col("chi2")).alias("chi2"), "dof",
                      F.round(special.chi2_critical(alpha, F.col("dof")), 4).alias("critical_value"),
                      _r(F.col("v")).alias("cramers_v"), labels.effect_band("v").alias("effect"), "nested",
                      labels.yes_no(F.col("v") >= redundant_at, "redundant", "distinct").alias("conclusion"))
