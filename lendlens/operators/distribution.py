"""Distribution shape, robust outliers and group contrasts (A14, A17, A19,
T7, T8, T12, T13, T16, O1, O2, H1–H4).

All statistics run on the full data.  Medians and quartiles are exact and
distributed (:func:`rankstats.quantiles` over value counts), the MAD is
the median of ``|value - median|`` computed from the same value counts,
and per-class versions key the counts by ``(variable, cls)``.  Every join
below is against a table with one row per variable (or per variable and
class), so it is a broadcast of a schema-bounded table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, special
from . import rankstats as RK
from .association import holm

ROUND = 6
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
MAD_TO_Z = 0.6745
MAD_TO_SD = 1.4826


def _r(c: Column) -> Column:
    return F.round(c, ROUND)


# ---------------------------------------------------------------------------
# moments from value counts
# ---------------------------------------------------------------------------

def moments(vc: DataFrame, keys=("variable",)) -> DataFrame:
    """n_obs, mean, sample sd, min, max per key from ``(keys, value, n)``
    (Spark names are case-insensitive: never call a total ``N`` next to ``n``)."""
    keys = list(keys)
    first = vc.groupBy(*keys).agg(
        F.sum("n").alias("n_obs"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    dev = vc.join(F.broadcast(first.select(*keys, "mean")), keys)
    ss = dev.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2).alias("ss"))
    return first.join(F.broadcast(ss), keys).select(
        *keys, "n_obs", "mean", F.sqrt(F.try_divide(F.col("ss"), F.col("n_obs") - 1)).alias("sd"), "min", "max")


def numeric_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, sd, min, max, exact quartiles, IQR and missing share per
    column; one scan, everything else from the value counts."""
    vc_all = RK.value_counts(df, cols, keep_missing=True)
    vc = vc_all.filter(F.col("value").isNotNull())
    missing = vc_all.groupBy("variable").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum("n").alias("n_all"))
    mom = moments(vc)
    q = RK.quantiles(vc, ["variable"], QUARTILES)
    out = missing.join(F.broadcast(mom), "variable", "left").join(F.broadcast(q), "variable", "left")
    return out.select(
        "variable", _r(F.col("mean")).alias("mean"), _r(F.col("sd")).alias("sd"),
        _r(F.col("min")).alias("min"), _r(F.col("max")).alias("max"),
        _r(F.col("q1")).alias("q1"), _r(F.col("median")).alias("median"), _r(F.col("q3")).alias("q3"),
        _r(F.col("q3") - F.col("q1")).alias("iqr"),
        _r(F.try_divide(F.col("n_missing"), F.col("n_all")) * 100).alias("null_pct"))


# ---------------------------------------------------------------------------
# robust location / scale
# ---------------------------------------------------------------------------

def median_mad(vc: DataFrame, keys=("variable",)) -> DataFrame:
    """Exact median and MAD (unscaled) per key from value counts."""
    keys = list(keys)
    med = RK.quantiles(vc, keys, {"median": 0.5})
    dev = (vc.join(F.broadcast(med), keys)
             .select(*keys, F.abs(F.col("value") - F.col("median")).alias("value"), "n")
             .groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    dev = RK._materialize(dev, "abs-deviations")
    mad = RK.quantiles(dev, keys, {"mad": 0.5})
    return med.join(F.broadcast(mad), keys)


def hampel_bands(df: DataFrame, cols: list[str], t: float = 3.0) -> DataFrame:
    """O2: median +- t * 1.4826 * MAD per column."""
    mm = median_mad(RK.value_counts(df, cols))
    half = F.lit(t * MAD_TO_SD) * F.col("mad")
    return mm.select("variable", _r(F.col("median")).alias("median"), _r(F.col("mad")).alias("mad"),
                     _r(F.col("median") - half).alias("lower"), _r(F.col("median") + half).alias("upper"))


def robust_outliers(df: DataFrame, col: str, threshold: float = 3.5, k: int | None = 10) -> DataFrame:
    """O1 + A17 + L2: values with |modified z| > threshold, their score and
    frequency, largest |score| first.  Empty when the MAD is 0.

    M = 0.6745 (x - median) / MAD on the full column (no sample).
    """
    vc = RK.value_counts(df, [col])
    mm = median_mad(vc)
    scored = vc.join(F.broadcast(mm), "variable").filter(F.col("mad") > 0)
    z = F.lit(MAD_TO_Z) * (F.col("value") - F.col("median")) / F.col("mad")
    out = (scored.select(F.col("value").alias(col), _r(z).alias("modified_z"), F.col("n").alias("frequency"))
                 .filter(F.abs("modified_z") > threshold)
                 .orderBy(F.abs("modified_z").desc(), F.col(col)))
    return out.limit(k) if k else out


# ---------------------------------------------------------------------------
# per-class contrasts
# ---------------------------------------------------------------------------

def class_quartiles(cls_vc: DataFrame) -> DataFrame:
    return RK.quantiles(cls_vc, ["variable", "cls"], QUARTILES)


def brown_forsythe(cls_vc: DataFrame, cq: DataFrame) -> DataFrame:
    """Levene test centred on the class medians; F and its dof."""
    z = (cls_vc.join(F.broadcast(cq.select("variable", "cls", "median")), ["variable", "cls"])
               .select("variable", "cls", "n", F.abs(F.col("value") - F.col("median")).alias("z")))
    per = z.groupBy("variable", "cls").agg(F.sum("n").alias("nc"), (F.sum(F.col("n") * F.col("z")) / F.sum("n")).alias("zc"))
    # squares around the class mean, so that large spreads lose no digits
    within = (z.join(F.broadcast(per), ["variable", "cls"]).groupBy("variable", "cls")
               .agg(F.first("nc").alias("nc"), F.first("zc").alias("zc"),
                    F.sum(F.col("n") * (F.col("z") - F.col("zc")) ** 2).alias("ssw")))
    grand = per.groupBy("variable").agg(F.sum("nc").alias("N"),
                                        (F.sum(F.col("nc") * F.col("zc")) / F.sum("nc")).alias("zbar"),
                                        F.count(F.lit(1)).alias("k"))
    parts = within.join(F.broadcast(grand), "variable").select(
        "variable", "N", "k", (F.col("nc") * (F.col("zc") - F.col("zbar")) ** 2).alias("ssb"), "ssw")
    s = parts.groupBy("variable").agg(F.first("N").alias("N"), F.first("k").alias("k"),
                                      F.sum("ssb").alias("ssb"), F.sum("ssw").alias("ssw"))
    f = F.try_divide((F.col("N") - F.col("k")) * F.col("ssb"), (F.col("k") - 1) * F.col("ssw"))
    return s.select("variable", f.alias("bf_f"), (F.col("k") - 1).alias("bf_df1"),
                    (F.col("N") - F.col("k")).alias("bf_df2"))


def contrast_stats(df: DataFrame, cols: list[str], target: str = "default") -> DataFrame:
    """Numbers of the robust contrast: per class median and IQR (A19),
    Brown–Forsythe F (T13), Mann–Whitney U of class 0 and Rosenthal r
    (T14/T15).  Variables with fewer than 2 values in a class are skipped."""
    vc = RK.value_counts(df, cols, target)
    cls_vc = RK.by_class(vc)
    cq = class_quartiles(cls_vc)
    wide = cq.groupBy("variable").agg(
        *[F.first(F.when(F.col("cls") == c, F.col(m)), ignorenulls=True).alias(f"{m}_{c}")
          for c in (0, 1) for m in ("q1", "median", "q3")])
    bf = brown_forsythe(cls_vc, cq)
    sep = RK.separation_stats(RK.separation_sums(vc))
    out = (sep.filter((F.col("N1") >= 2) & (F.col("N") - F.col("N1") >= 2))
              .join(F.broadcast(wide), "variable").join(F.broadcast(bf), "variable"))
    return out.select(
        "variable", (F.col("N") - F.col("N1")).alias("n0"), F.col("N1").alias("n1"),
        _r(F.col("median_0")).alias("median_0"), _r(F.col("q3_0") - F.col("q1_0")).alias("iqr_0"),
        _r(F.col("median_1")).alias("median_1"), _r(F.col("q3_1") - F.col("q1_1")).alias("iqr_1"),
        _r(F.col("bf_f")).alias("bf_f"), "bf_df1", "bf_df2",
        _r(F.col("u_stat")).alias("u_stat"), _r(F.col("rosenthal_r")).alias("rosenthal_r"),
        F.col("z_mwu"))


def robust_contrast(df: DataFrame, cols: list[str], target: str = "default", alpha: float = 0.05) -> DataFrame:
    """Report of :func:`contrast_stats` with Brown–Forsythe p
    (homoscedastic yes/no), Mann–Whitney p with Holm adjustment and the
    effect band of Rosenthal's r, sorted by r."""
    st = contrast_stats(df, cols, target)
    # two classes, so F has one numerator degree of freedom
    st = st.withColumn("bf_p", F.when(F.col("bf_df1") == 1, special.f_sf(F.col("bf_f"), F.col("bf_df2"))))
    st = st.withColumn("p_value", special.norm_two_sided(F.col("z_mwu")))
    # one row per variable, written so that the tails are computed once and not
    # copied into every column that the adjusted p appears in
    st = holm(RK._materialize(st, "contrast"))

    def summary(m: str, i: str) -> Column:
        return F.concat(F.format_number(m, 2), F.lit(" ("), F.format_number(i, 2), F.lit(")"))

    return (st.select("variable", summary("median_0", "iqr_0").alias("median_iqr_0"),
                      summary("median_1", "iqr_1").alias("median_iqr_1"),
                      labels.yes_no(F.col("bf_p") > alpha).alias("homoscedastic"),
                      _r(F.col("p_value")).alias("p_value"), _r(F.col("p_holm")).alias("p_holm"), labels.p_text("p_holm").alias("p_text"),
                      "rosenthal_r", labels.effect_band("rosenthal_r").alias("effect"))
              .orderBy(F.col("rosenthal_r").desc(), "variable"))


def box_stats(df: DataFrame, cols: list[str], target: str = "default") -> DataFrame:
    """H2: five numbers and 1.5 IQR whiskers per variable and class."""
    cls_vc = RK.by_class(RK.value_counts(df, cols, target))
    cq = class_quartiles(cls_vc)
    j = cls_vc.join(F.broadcast(cq), ["variable", "cls"])
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    agg = j.groupBy("variable", "cls").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col("value") >= lo, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(F.col("value") <= hi, F.col("value"))).alias("whisker_hi"),
        F.sum(F.when((F.col("value") < lo) | (F.col("value") > hi), F.col("n")).otherwise(0)).alias("n_outside"))
    return agg.select("variable", F.col("cls").alias(target),
                      *[_r(F.col(c)).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                      "n_outside")


# ---------------------------------------------------------------------------
# shape (T7, T8, T10, T12) and plot data (H1, H3, H4)
# ---------------------------------------------------------------------------

def shape(df: DataFrame, cols: list[str]) -> DataFrame:
    """T7 + T8: population skewness, excess kurtosis and Jarque–Bera with
    its chi-square(2) p-value exp(-JB/2), per column."""
    return shape_vc(RK.value_counts(df, cols))


def shape_vc(vc: DataFrame) -> DataFrame:
    """T7 + T8 from value counts: central moments by a second pass over the
    (small) counts joined with the per-variable mean."""
    mom = vc.groupBy("variable").agg(F.sum("n").alias("n_obs"),
                                     (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mu"),
                                     (F.min("value") < F.max("value")).alias("varies"))
    # a constant column has no shape, whatever rounding leaves of its deviations
    d = vc.join(F.broadcast(mom), "variable").select(
        "variable", "n", "n_obs", F.when(F.col("varies"), F.col("value") - F.col("mu")).alias("dv"))
    dv, n = F.col("dv"), F.col("n")
    c = d.groupBy("variable").agg(F.first("n_obs").alias("n"),
                                  (F.sum(n * dv * dv) / F.first("n_obs")).alias("m2"),
                                  (F.sum(n * dv * dv * dv) / F.first("n_obs")).alias("m3"),
                                  (F.sum(n * dv * dv * dv * dv) / F.first("n_obs")).alias("m4"))
    sk = F.try_divide(F.col("m3"), F.pow("m2", 1.5))
    ku = F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")) - 3
    g = c.select("variable", "n", sk.alias("skew"), ku.alias("kurt"))
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    return g.select("variable", "n", _r(F.col("skew")).alias("skewness"), _r(F.col("kurt")).alias("kurtosis"),
                    F.round(jb, 3).alias("jarque_bera"), _r(F.exp(-jb / 2)).alias("jb_p"))


def normality_report(df: DataFrame, cols: list[str], alpha: float = 0.05, vc: DataFrame | None = None) -> DataFrame:
    """Skewness, kurtosis, Jarque–Bera, K-S against the normal and a
    verdict (normal iff every p > alpha), sorted by skewness.  Missing values
    are dropped per variable, not row-wise across all variables.  One value
    count table feeds every test."""
    vc = vc if vc is not None else RK.value_counts(df, cols)
    sh = shape_vc(vc)
    ks = RK.ks_normal_vc(vc).select("variable", "ks_normal", F.col("N").alias("n_ks"))
    out = sh.join(F.broadcast(ks), "variable")
    out = out.withColumn("ks_p", special.kolmogorov_sf(F.col("ks_normal"), F.col("n_ks")))
    normal = (F.col("jb_p") > alpha) & (F.col("ks_p") > alpha)
    return (out.select("variable", "n", "skewness", "kurtosis", "jarque_bera", "jb_p",
                       _r(F.col("ks_normal")).alias("ks_normal"), _r(F.col("ks_p")).alias("ks_p"),
                       labels.yes_no(normal).alias("normal"))
               .orderBy(F.col("skewness").desc(), "variable"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """H1: equal-width histogram density and the fitted normal density at
    each bin centre (from value counts: one scan, a few small aggregates)."""
    vc = RK.value_counts(df, [col])
    mom = moments(vc)
    j = vc.join(F.broadcast(mom), "variable")
    width = (F.col("max") - F.col("min")) / bins
    # a constant column has one bin of width 0 and no density
    at = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("min"), width)).cast("int") + 1, F.lit(1))
    b = F.least(at, F.lit(bins))
    h = j.groupBy("variable", b.alias("bin")).agg(
        F.sum("n").alias("n"), F.first("min").alias("min"), F.first("max").alias("max"),
        F.first("n_obs").alias("n_obs"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    w = (F.col("max") - F.col("min")) / bins
    lo = F.col("min") + (F.col("bin") - 1) * w
    centre = lo + w / 2
    z = F.try_divide(centre - F.col("mean"), F.col("sd"))
    pdf = F.when(w > 0, F.try_divide(F.exp(-0.5 * z ** 2), F.col("sd") * (2 * math.pi) ** 0.5))
    return h.select("bin", _r(lo).alias("bin_lo"), _r(lo + w).alias("bin_hi"), "n",
                    _r(F.try_divide(F.col("n"), F.col("n_obs") * w)).alias("density"), _r(pdf).alias("normal_density"))


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """H3: count of rows per NULL pattern ('1' = missing) on full data."""
    pattern = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def ols_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """H4: least-squares line and Pearson r of two columns (one aggregate)."""
    return df.agg(_r(F.regr_slope(y, x)).alias("slope"), _r(F.regr_intercept(y, x)).alias("intercept"),
                  _r(F.corr(x, y)).alias("pearson_r"), F.regr_count(y, x).alias("n"))


def binned_scatter(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """H4 companion: 2-D bin counts instead of shipping every point."""
    bx = F.floor(F.col(x) / x_width) * x_width
    by = F.floor(F.col(y) / y_width) * y_width
    return (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
              .groupBy(bx.alias(f"{x}_bin"), by.alias(f"{y}_bin")).agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# Shapiro–Francia on full data
# ---------------------------------------------------------------------------

_SQRT_2PI = (2 * math.pi) ** 0.5


def _phi(z: Column) -> Column:
    return F.exp(-z * z / 2) / _SQRT_2PI


def shapiro_francia(df: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    """T11 on a table; see :func:`shapiro_francia_vc`."""
    return shapiro_francia_vc(RK.value_counts(df, cols), buckets)


def shapiro_francia_vc(vc: DataFrame, buckets: int | None = None) -> DataFrame:
    """T11 (re-aimed): Shapiro–Francia W' = corr(x_(i), m_i)^2 with normal
    scores m_i = Phi^-1((i - 3/8) / (N + 1/4)), on the full column.

    This is a different statistic from the exact Shapiro–Wilk W of a
    5,000-row sample (it needs no covariance of order statistics), and it
    scales: per distinct value, a tie group spanning ranks a..b contributes
    sum m_i and sum m_i^2 through the closed forms
    int Phi^-1 = -phi(Phi^-1) and int (Phi^-1)^2 = p - z phi(z) (midpoint
    rule), so a value held by a third of the rows is still one row.  Values
    are centred first, so a large mean costs no digits.  The p-value uses
    Royston's (1993) normal approximation of ln(1 - W'), fitted for at most
    5,000 values; reports say where it is extrapolated.
    """
    mean = vc.groupBy("variable").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
                                      (F.min("value") < F.max("value")).alias("varies"))
    centred = vc.join(F.broadcast(mean), "variable").select(
        "variable", F.when(F.col("varies"), F.col("value") - F.col("mean")).otherwise(0.0).alias("value"), "n")
    cum = RK.cum_counts(centred, ["variable"], ["n"], buckets=buckets)
    tot = F.col("tot_n").cast("double")
    n, cn = F.col("n").cast("double"), F.col("cn").cast("double")
    denom = tot + 0.25
    a = cn - n + 1
    # staged projections: each normal score is computed once per row
    st = cum.select("variable", "tot_n", "value", n.alias("nn"), denom.alias("den"),
                    ((a - 0.375) / denom).alias("pm"), ((a - 0.875) / denom).alias("p1"),
                    ((cn + 0.125) / denom).alias("p2"))
    st = st.select("*", special.norm_ppf(F.col("pm")).alias("m1"), special.norm_ppf(F.col("p1")).alias("z1"),
                   special.norm_ppf(F.col("p2")).alias("z2"))
    st = st.select("*", _phi(F.col("z1")).alias("f1"), _phi(F.col("z2")).alias("f2"))
    nn, den, m1 = F.col("nn"), F.col("den"), F.col("m1")
    s1 = F.when(nn == 1, m1).otherwise(den * (F.col("f1") - F.col("f2")))
    s2 = F.when(nn == 1, m1 * m1).otherwise(
        den * ((F.col("p2") - F.col("z2") * F.col("f2")) - (F.col("p1") - F.col("z1") * F.col("f1"))))
    st = st.select("variable", "tot_n", "value", "nn", s1.alias("s1"), s2.alias("s2"))
    v = F.col("value")
    g = st.groupBy("variable").agg(
        F.first("tot_n").alias("n_obs"), F.sum(F.col("nn") * v).alias("sx"),
        F.sum(F.col("nn") * v * v).alias("sxx"),
        F.sum("s1").alias("sm"), F.sum("s2").alias("smm"), F.sum(v * F.col("s1")).alias("sxm"))
    N = F.col("n_obs").cast("double")
    cov = F.col("sxm") - F.col("sx") * F.col("sm") / N
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / N
    vm = F.col("smm") - F.col("sm") * F.col("sm") / N
    w = F.try_divide(cov * cov, vx * vm)
    u = F.log(N)
    lv = F.log(u)
    mu = -1.2725 + 1.0521 * (lv - u)
    sigma = 1.0308 - 0.26758 * (lv + F.try_divide(F.lit(2.0), u))
    z = F.try_divide(F.log(1 - w) - mu, sigma)
    return g.select("variable", "n_obs", _r(w).alias("sf_w"), z.alias("sf_z"))


def normality_report_full(df: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """T12 with all three tests: Jarque–Bera, K-S against the normal and
    Shapiro–Francia, sorted by skewness.  ``normal`` is judged by the first
    two; ``sf_p_extrapolated`` says that the column is longer than the range
    the third one's p-value was fitted on."""
    vc = RK.value_counts(df, cols)
    base = normality_report(df, cols, alpha, vc=vc)
    sf = shapiro_francia_vc(vc).select("variable", "sf_w", _r(special.norm_sf(F.col("sf_z"))).alias("sf_p"),
                                       (F.col("n_obs") > 5000).alias("sf_p_extrapolated"))
    return base.join(F.broadcast(sf), "variable", "left").orderBy(F.col("skewness").desc(), "variable")
