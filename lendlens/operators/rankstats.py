"""Rank statistics on full data without a global sort (W3, T9, T14, T15, T18,
exact quantiles).

Everything starts from a *value-count table*

    vc(variable, value, n, n1)      one row per distinct value of a column,

built by one unpivot + one grouped job (map-side partial aggregation merges
equal values before the shuffle, so a value held by a third of all rows is
one row here).  Running counts through each value (``cn``, ``cn1``) come
from :func:`cum_counts`: the table is dealt by ranges of (keys, value),
every task adds up its own sorted range, and the totals of earlier ranges
are put on (:mod:`.running`).

No window is ever partitioned by a constant or by the variable alone, and
no row carries cut points; equal values are already merged, so no tie
straddles two ranges.  What is broadcast is one row per range or per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .profile import melt
from .running import running_sums

ROUND = 6


def _r(c: Column) -> Column:
    return F.round(c, ROUND)


# ---------------------------------------------------------------------------
# value counts and running counts
# ---------------------------------------------------------------------------

def value_counts(df: DataFrame, cols: list[str], target: str | None = None,
                 materialize: bool = True, keep_missing: bool = False) -> DataFrame:
    """``(variable, value, n[, n1])`` over non-missing values of numeric ``cols``.

    ``n1`` is the number of rows with ``target == 1`` (binary target).  The
    table is the reduced form every rank statistic starts from and is read
    by several branches of a report (cut points, bucket totals, running
    counts, moments...).  With ``materialize`` it is written once to the
    shared checkpoint folder and read back, so the source is scanned once
    per report and the lineage is cut (an executor loss re-reads the
    table, it does not re-run the joins and scans above it).
    """
    ids = [target] if target else []
    m = melt(df, cols, ids=ids, cast="double")
    if keep_missing:   # NULL and NaN become one NULL level (missing count)
        m = m.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    else:
        m = m.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    aggs = [F.count(F.lit(1)).alias("n")]
    if target:
        aggs.append(F.sum(F.col(target).cast("long")).alias("n1"))
    vc = m.groupBy("variable", "value").agg(*aggs)
    return _materialize(vc, "value-counts") if materialize else vc


def _materialize(df: DataFrame, name: str) -> DataFrame:
    from ..sources.tables import materialize
    return materialize(df, name)


def by_class(vc: DataFrame, cls: str = "cls") -> DataFrame:
    """Split ``(variable, value, n, n1)`` into per-class rows
    ``(variable, cls, value, n)`` (no data shuffle: a narrow explode)."""
    parts = F.array(F.struct(F.lit(0).alias(cls), (F.col("n") - F.col("n1")).alias("cnt")),
                    F.struct(F.lit(1).alias(cls), F.col("n1").alias("cnt")))
    out = vc.select("variable", "value", F.explode(parts).alias("p"))
    return (out.select("variable", F.col(f"p.{cls}").alias(cls), "value", F.col("p.cnt").alias("n"))
               .filter(F.col("n") > 0))


def totals(vc: DataFrame, keys: list[str], weights=("n", "n1")) -> DataFrame:
    """Per-key totals ``tot_<w>`` and the number of distinct values."""
    return vc.groupBy(*keys).agg(*[F.sum(w).alias(f"tot_{w}") for w in weights],
                                 F.count(F.lit(1)).alias("n_values"))


def _ranges(vc: DataFrame, keys: list[str], order: str, buckets: int | None) -> DataFrame:
    """Writes the table by ranges of (keys, order); ``__b`` is the range's
    number.  Without ``buckets``, as many as the session shuffles into."""
    deal = [buckets] if buckets else []
    ranged = vc.repartitionByRange(*deal, *keys, order).withColumn("__b", F.spark_partition_id())
    return _materialize(ranged, "value-ranges")


def cum_counts(vc: DataFrame, keys: list[str] = ("variable",), weights=("n", "n1"),
               order: str = "value", buckets: int | None = None) -> DataFrame:
    """Inclusive running sums ``c<w>`` of each weight in ascending ``order``
    within each key group (``order`` must be unique within a key), plus the
    key totals ``tot_<w>``."""
    keys, weights = list(keys), list(weights)
    run = running_sums(vc, keys, [order], {f"c{w}": F.col(w) for w in weights}, "running-counts", partitions=buckets)
    tot = run.groupBy(*keys).agg(*[F.sum(w).alias(f"tot_{w}") for w in weights])
    # one row per key, and a key is a column of the source
    return run.join(F.broadcast(tot), keys).select(
        *vc.columns, *[f"c{w}" for w in weights], *[f"tot_{w}" for w in weights])


# ---------------------------------------------------------------------------
# exact quantiles (linear interpolation, as numpy / percentile / quantile_cont)
# ---------------------------------------------------------------------------

def quantiles(vc: DataFrame, keys: list[str], probs: dict[str, float], weight: str = "n",
              buckets: int | None = None) -> DataFrame:
    """Exact quantiles per key from the value counts.

    For probability p with N values, h = (N-1)p; the result interpolates
    between the values at 0-based ranks floor(h) and ceil(h).  The value at
    rank r is the smallest value whose running count exceeds r.  Bucket totals
    say which buckets hold a wanted rank; no other bucket is sorted.
    """
    keys = list(keys)
    vcb = _ranges(vc, keys, "value", buckets)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals_ = vcb.groupBy(*keys, "__b").agg(F.sum(weight).alias("__w"))
    offsets = totals_.select(*keys, "__b", "__w", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__off"),
                             F.sum("__w").over(Window.partitionBy(*keys)).alias("__tot"))
    h = {name: (F.col("__tot") - 1) * p for name, p in probs.items()}
    wanted = [f(x) for x in h.values() for f in (F.floor, F.ceil)]
    # only the buckets that hold a wanted rank are sorted
    holds = F.lit(False)
    for rank in wanted:
        holds = holds | ((rank >= F.col("__off")) & (rank < F.col("__off") + F.col("__w")))
    rows = vcb.join(F.broadcast(offsets.where(holds).drop("__w")), [*keys, "__b"])
    inside = Window.partitionBy(*keys, "__b").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = rows.withColumn("__cw", F.col("__off") + F.sum(weight).over(inside))
    aggs = []
    for name, x in h.items():
        aggs.append(F.min(F.when(F.col("__cw") > F.floor(x), F.col("value"))).alias(f"__lo_{name}"))
        aggs.append(F.min(F.when(F.col("__cw") > F.ceil(x), F.col("value"))).alias(f"__hi_{name}"))
        aggs.append(F.first(x - F.floor(x)).alias(f"__fr_{name}"))
    q = cum.groupBy(*keys).agg(*aggs)
    return q.select(*keys, *[
        (F.col(f"__lo_{n}") + F.col(f"__fr_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n)
        for n in probs])


def exact_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float]) -> DataFrame:
    """``(variable, <name>...)`` exact quantiles of numeric columns."""
    return quantiles(value_counts(df, cols), ["variable"], probs)


# ---------------------------------------------------------------------------
# class separation of numeric columns vs a binary target
# ---------------------------------------------------------------------------

def separation_sums(vc: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per variable: N, N1, KS, centred rank sums and tie sums.

    Ranks are average ranks of tie groups: rank = cn - (n - 1) / 2.  Sums
    are centred on the mean rank (N + 1) / 2 so they stay accurate in
    double precision at billions of rows.
    """
    cum = cum_counts(vc, ["variable"], ["n", "n1"], buckets=buckets)
    n, n1, cn, cn1 = (F.col(x).cast("double") for x in ("n", "n1", "cn", "cn1"))
    tn, tn1 = F.col("tot_n").cast("double"), F.col("tot_n1").cast("double")
    tn0 = tn - tn1
    dev = cn - (n - 1) / 2 - (tn + 1) / 2
    return cum.groupBy("variable").agg(
        F.first("tot_n").alias("N"),
        F.first("tot_n1").alias("N1"),
        F.max(F.abs(F.try_divide(cn1, tn1) - F.try_divide(cn - cn1, tn0))).alias("ks"),
        F.sum(n1 * dev).alias("r1c"),
        F.sum(n * dev * dev).alias("rss"),
        F.sum(n * n * n - n).alias("tie3"),
        F.sum(n * (n - 1) / 2).alias("tie_pairs"),
    )


def separation_stats(sums: DataFrame) -> DataFrame:
    """KS, Mann–Whitney U (of class 0, as ``mannwhitneyu(x0, x1)``), AUC,
    Kendall tau-b, Spearman rho, Rosenthal z and r per variable.

    Divisions are ``try_divide`` so a constant column gives NULL, not an
    ANSI error."""
    dv = F.try_divide
    N, N1 = F.col("N").cast("double"), F.col("N1").cast("double")
    N0 = N - N1
    r1c = F.col("r1c")
    u1 = r1c + N1 * N0 / 2
    u0 = N1 * N0 - u1
    p = dv(N1, N)
    rho = dv(dv(r1c, N), F.sqrt(dv(F.col("rss"), N) * p * (1 - p)))
    tau = dv(2 * r1c, F.sqrt((N * (N - 1) / 2 - F.col("tie_pairs")) * N1 * N0))
    z_plain = dv(u0 - N0 * N1 / 2, F.sqrt(N0 * N1 * (N + 1) / 12))
    sigma_tie = F.sqrt(N0 * N1 / 12 * ((N + 1) - dv(F.col("tie3"), N * (N - 1))))
    u_big = F.greatest(u0, u1)
    z_mwu = dv(u_big - N0 * N1 / 2 - 0.5, sigma_tie)
    return sums.select(
        "variable", "N", "N1", "ks",
        u0.alias("u_stat"), dv(u1, N1 * N0).alias("auc"),
        tau.alias("kendall_tau"), rho.alias("spearman_rho"),
        z_plain.alias("z"), dv(F.abs(z_plain), F.sqrt(N)).alias("rosenthal_r"),
        z_mwu.alias("z_mwu"))


def numeric_ranking(df: DataFrame, cols: list[str], target: str = "default",
                    top: int | None = 20, buckets: int | None = None) -> DataFrame:
    """Spearman rho, Kendall tau-b and two-sample KS of every numeric
    column against the target, ranked by |tau| (top ``top``)."""
    st = separation_stats(separation_sums(value_counts(df, cols, target), buckets))
    out = st.select("variable", _r(F.col("spearman_rho")).alias("spearman_rho"),
                    _r(F.col("kendall_tau")).alias("kendall_tau"), _r(F.col("ks")).alias("ks_stat"))
    out = out.orderBy(F.abs("kendall_tau").desc(), "variable")
    return out.limit(top) if top else out


def mann_whitney(df: DataFrame, cols: list[str], target: str = "default",
                 buckets: int | None = None) -> DataFrame:
    """T14 + T15: U, asymptotic two-sided p (tie + continuity corrected),
    Rosenthal z and r (no corrections), AUC."""
    st = separation_stats(separation_sums(value_counts(df, cols, target), buckets))
    p = special.norm_two_sided(F.col("z_mwu"))
    return st.select("variable", "N", "N1", _r(F.col("u_stat")).alias("u_stat"),
                     _r(F.col("auc")).alias("auc"), _r(F.col("z")).alias("z"),
                     _r(F.col("rosenthal_r")).alias("rosenthal_r"), _r(p).alias("p_value"))


# ---------------------------------------------------------------------------
# ROC curve and AUC of a score
# ---------------------------------------------------------------------------

def roc_curve(df: DataFrame, score: str, label: str = "default",
              buckets: int | None = None) -> DataFrame:
    """One point per distinct score: predicting 1 for scores >= threshold
    gives (fpr, tpr).  Exact, no binning; the point (0, 0) is implicit.  A
    rate of a class without rows is NULL."""
    vc = value_counts(df.select(F.col(score).cast("double").alias("score"), label), ["score"], label)
    cum = cum_counts(vc, ["variable"], ["n", "n1"], buckets=buckets)
    tp = F.col("tot_n1") - F.col("cn1") + F.col("n1")
    fp = (F.col("tot_n") - F.col("tot_n1")) - (F.col("cn") - F.col("cn1")) + (F.col("n") - F.col("n1"))
    return cum.select(F.col("value").alias("threshold"),
                      _r(F.try_divide(fp, F.col("tot_n") - F.col("tot_n1"))).alias("fpr"),
                      _r(F.try_divide(tp, F.col("tot_n1"))).alias("tpr"))


def auc(df: DataFrame, score: str, label: str = "default", buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC = U / (N1 N0) (trapezoid area with ties as diagonals)."""
    vc = value_counts(df.select(F.col(score).cast("double").alias("score"), label), ["score"], label)
    st = separation_stats(separation_sums(vc, buckets))
    return st.select(_r(F.col("auc")).alias("auc"), "N", "N1")


def ks_normal(df: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    """K-S distance of the standardised column (sd with n-1) to N(0,1)."""
    return ks_normal_vc(value_counts(df, cols), buckets)


def ks_normal_vc(vc: DataFrame, buckets: int | None = None) -> DataFrame:
    """T10 from value counts.  The ECDF jumps at each distinct value from
    (cn - n)/N to cn/N; Phi is evaluated in the JVM once per distinct value."""
    mom = vc.groupBy("variable").agg(
        F.sum("n").alias("n_obs"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    # a constant column has no spread, whatever rounding leaves of it
    sd = (vc.join(F.broadcast(mom), "variable")
            .groupBy("variable")
            .agg(F.when(F.min("value") < F.max("value"),
                        F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2),
                                            F.first("n_obs") - 1))).alias("sd"), F.first("mean").alias("mean"),
                 F.first("n_obs").alias("n_obs")))
    cum = cum_counts(vc, ["variable"], ["n"], buckets=buckets).join(F.broadcast(sd), "variable")
    cum = cum.select("variable", "n", "cn", "n_obs",
                     special.norm_cdf(F.try_divide(F.col("value") - F.col("mean"), F.col("sd"))).alias("phi"))
    phi = F.col("phi")
    total = F.col("n_obs").cast("double")
    d = F.greatest(F.col("cn") / total - phi, phi - (F.col("cn") - F.col("n")) / total)
    return cum.groupBy("variable").agg(F.first("n_obs").alias("N"), F.max(d).alias("ks_normal"))
