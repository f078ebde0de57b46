"""Spearman correlation matrix and correlated-pair pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import rankstats as RK


HOT_SHARE = 64


def _cold_cells(data: DataFrame, hot: dict[str, dict[float, float]], key: str) -> DataFrame:
    """(row, variable, value) of the cells whose value is not hot in its column."""
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value"), _rank(c, hot[c]).isNull().alias("cold"))
                               for c in hot]), lambda x: x["cold"])
    return data.select(key, F.explode(cells).alias("x")).select(key, "x.variable", "x.value")


def _rank(col: str, known: dict[float, float]) -> Column:
    """The rank of a hot value, null for other values."""
    if not known:
        return F.lit(None).cast("double")
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col(col)]


def _row_ranks(data: DataFrame, ranks: DataFrame, hot: dict[str, dict[float, float]], key: str) -> DataFrame:
    """(row, __r_<column>...)"""
    cold = _cold_cells(data, hot, key).join(ranks, ["variable", "value"])
    beside = data.select(key, *[_rank(c, hot[c]).alias(f"__r_{c}") for c in hot])
    apart = cold.select(key, *[F.when(F.col("variable") == c, F.col("rank")).alias(f"__r_{c}") for c in hot])
    return beside.union(apart).groupBy(key).agg(*[F.max(f"__r_{c}").alias(f"__r_{c}") for c in hot])


def spearman_matrix(df: DataFrame, cols: list[str], fill_zero: bool = True, lower_only: bool = True,
                    vc: DataFrame | None = None) -> DataFrame:
    """T5: Spearman rho of every pair, long form ``(var_a, var_b, rho)``.

    Missing values become 0 first, as in the study (P17) -- this shifts
    ranks; ``fill_zero=False`` drops incomplete rows instead.  Each row
    gets a number of its own, so no column need be a key.

    One plan for every size and number of columns: average ranks per distinct
    value come from the running counts (no global sort).  A value that holds
    one in ``HOT_SHARE`` of the rows of its column (such as the one that missing
    cells were filled with; ``HOT_SHARE`` values a column at most) keeps its
    rank beside it in the plan and is not shuffled; only the other cells, as
    (row, variable, value), meet their ranks in one join.  One regroup by row
    puts a row's ranks together again, and one aggregate computes all
    k(k-1)/2 correlations from centred sums.

    With ``fill_zero``, a caller that has the columns' value counts with their
    missing level hands them in as ``vc``, and the cells are not counted again.
    """
    key = "__row"
    # written with the table, so the numbers stand
    data = df.select(F.monotonically_increasing_id().alias(key), *[F.col(c).cast("double").alias(c) for c in cols])
    data = materialize(data.fillna(0.0, subset=cols) if fill_zero else data.dropna(subset=cols), "spearman-input")
    if vc is None or not fill_zero:
        vc = RK.value_counts(data, cols)
    else:
        vc = vc.groupBy("variable", F.coalesce("value", F.lit(0.0)).alias("value")).agg(F.sum("n").alias("n"))
    cum = RK.cum_counts(vc, ["variable"], ["n"])
    ranks = materialize(cum.select("variable", "value", (F.col("cn") - (F.col("n") - 1) / 2).alias("rank"),
                                   (F.col("n") * HOT_SHARE > F.col("tot_n")).alias("hot")), "avg-ranks")
    hot: dict[str, dict[float, float]] = {c: {} for c in cols}
    for r in ranks.where("hot").collect():
        hot[r["variable"]][r["value"]] = r["rank"]
    ranked = _row_ranks(data, ranks.where(~F.col("hot")).drop("hot"), hot, key)
    # centred ranks: the mean rank of every column is (N + 1) / 2, so the
    # Pearson correlation needs only sums of products (one cheap aggregate)
    mid = (data.select(F.count(F.lit(1))).scalar() + 1) / 2
    cen = ranked.select(*[(F.col(f"__r_{c}") - mid).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    sq = {c: F.col(f"ss_{c}") for c in cols}
    sums = cen.agg(*[F.sum(F.col(c) * F.col(c)).alias(f"ss_{c}") for c in cols],
                   *[F.sum(F.col(a) * F.col(b)).alias(f"sp_{i}") for i, (a, b) in enumerate(pairs)])
    rho = [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                    F.round(F.try_divide(F.col(f"sp_{i}"), F.sqrt(sq[a] * sq[b])), 6).alias("rho"))
           for i, (a, b) in enumerate(pairs)]
    if not lower_only:
        rho += [F.struct(F.lit(b).alias("var_a"), F.lit(a).alias("var_b"),
                         F.round(F.try_divide(F.col(f"sp_{i}"), F.sqrt(sq[a] * sq[b])), 6).alias("rho"))
                for i, (a, b) in enumerate(pairs)]
        rho += [F.struct(F.lit(c).alias("var_a"), F.lit(c).alias("var_b"), F.lit(1.0).alias("rho")) for c in cols]
    long = sums.select(F.explode(F.array(*rho)).alias("p")).select("p.*")
    return long


def prune_correlated(df: DataFrame, cols: list[str], target: str = "default",
                     threshold: float = 0.85) -> DataFrame:
    """For each pair with |rho| > threshold, drop the member with the
    smaller two-sample KS against the target.  Both start from one table of
    value counts."""
    vc = RK.value_counts(df, cols, target, keep_missing=True)
    pairs = spearman_matrix(df, cols, vc=vc).filter(F.abs("rho") > threshold)
    ks = RK.separation_stats(RK.separation_sums(vc.where(F.col("value").isNotNull()))) \
        .select("variable", F.round("ks", 6).alias("ks"))
    ka = ks.select(F.col("variable").alias("var_a"), F.col("ks").alias("ks_a"))
    kb = ks.select(F.col("variable").alias("var_b"), F.col("ks").alias("ks_b"))
    out = pairs.join(F.broadcast(ka), "var_a").join(F.broadcast(kb), "var_b")
    drop = F.when(F.col("ks_a") < F.col("ks_b"), F.col("var_a")).otherwise(F.col("var_b"))
    return out.select("var_a", "var_b", "rho", "ks_a", "ks_b", drop.alias("drop"))
