"""Rank statistics: distributed prefix sums against brute force."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lendlens.operators import rankstats as RK


def _frame(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.25).astype(int)
    a = np.round(rng.normal(10 + 2 * y, 3, n), 1)          # ties
    b = rng.integers(0, 7, n).astype(float) + y             # heavy ties
    c = rng.exponential(1.0, n)                             # no ties
    c[::37] = np.nan
    pdf = pd.DataFrame({"y": y, "a": a, "b": b, "c": c})
    return spark.createDataFrame(pdf), pdf


def _avg_ranks(x):
    return pd.Series(x).rank(method="average").to_numpy()


def test_cum_counts_equal_plain_window(spark):
    df, _ = _frame(spark)
    vc = RK.value_counts(df, ["a", "b", "c"], "y")
    got = RK.cum_counts(vc, ["variable"], ["n", "n1"], buckets=8)
    w = Window.partitionBy("variable").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ref = vc.select("variable", "value", F.sum("n").over(w).alias("rn"), F.sum("n1").over(w).alias("rn1"))
    j = got.join(ref, ["variable", "value"])
    assert j.count() == vc.count()
    assert j.filter((F.col("cn") != F.col("rn")) | (F.col("cn1") != F.col("rn1"))).count() == 0


def test_no_single_partition_exchange(spark):
    df, _ = _frame(spark)
    cum = RK.cum_counts(RK.value_counts(df, ["a", "b"], "y"), ["variable"], ["n", "n1"])
    plan = cum._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_separation_against_brute_force(spark):
    df, pdf = _frame(spark)
    st = {r["variable"]: r for r in RK.separation_stats(RK.separation_sums(
        RK.value_counts(df, ["a", "b", "c"], "y"))).collect()}
    for col in ("a", "b", "c"):
        d = pdf[["y", col]].dropna()
        x, y = d[col].to_numpy(), d["y"].to_numpy()
        x0, x1 = x[y == 0], x[y == 1]
        # KS: sup |F1 - F0| over the pooled values
        grid = np.unique(x)
        f1 = np.searchsorted(np.sort(x1), grid, side="right") / len(x1)
        f0 = np.searchsorted(np.sort(x0), grid, side="right") / len(x0)
        ks = np.max(np.abs(f1 - f0))
        # U of class 0 by pairwise comparison
        diff = x0[:, None] - x1[None, :]
        u0 = np.sum(diff > 0) + 0.5 * np.sum(diff == 0)
        # Kendall tau-b and Spearman rho brute force
        r = _avg_ranks(x)
        rho = np.corrcoef(r, y)[0, 1]
        dx = np.sign(x[:, None] - x[None, :])
        dy = np.sign(y[:, None] - y[None, :])
        num = np.sum(dx * dy) / 2
        tx = np.sum(dx != 0) / 2
        ty = np.sum(dy != 0) / 2
        tau = num / np.sqrt(tx * ty)
        s = st[col]
        assert s["ks"] == pytest.approx(ks, abs=1e-12)
        assert s["u_stat"] == pytest.approx(u0, rel=1e-12)
        assert s["auc"] == pytest.approx(1 - u0 / (len(x0) * len(x1)), rel=1e-12)
        assert s["spearman_rho"] == pytest.approx(rho, abs=1e-10)
        assert s["kendall_tau"] == pytest.approx(tau, abs=1e-10)


def test_rho_invariant_under_monotone_map(spark):
    df, _ = _frame(spark)
    df2 = df.withColumn("a", F.exp(F.col("a") / 5))
    r1 = RK.numeric_ranking(df, ["a"], "y", top=None).first()
    r2 = RK.numeric_ranking(df2, ["a"], "y", top=None).first()
    assert r1["spearman_rho"] == r2["spearman_rho"]
    assert r1["kendall_tau"] == r2["kendall_tau"]


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_quantiles_match_numpy(spark, buckets):
    df, pdf = _frame(spark)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}
    got = {r["variable"]: r for r in RK.quantiles(RK.value_counts(df, ["a", "b", "c"]), ["variable"], probs,
                                                   buckets=buckets).collect()}
    for col in ("a", "b", "c"):
        x = pdf[col].dropna().to_numpy()
        for name, p in probs.items():
            assert got[col][name] == pytest.approx(np.percentile(x, p * 100), rel=1e-12, abs=1e-12)


def test_roc_points_and_auc(spark):
    df, pdf = _frame(spark)
    roc = RK.roc_curve(df, "a", "y").orderBy(F.col("threshold").desc()).toPandas()
    assert roc["tpr"].is_monotonic_increasing and roc["fpr"].is_monotonic_increasing
    assert roc["tpr"].iloc[-1] == 1.0 and roc["fpr"].iloc[-1] == 1.0
    fpr = np.concatenate([[0.0], roc["fpr"].to_numpy()])
    tpr = np.concatenate([[0.0], roc["tpr"].to_numpy()])
    trapezoid = np.sum((fpr[1:] - fpr[:-1]) * (tpr[1:] + tpr[:-1]) / 2)
    assert RK.auc(df, "a", "y").first()["auc"] == pytest.approx(trapezoid, abs=2e-6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_u_statistics_sum_to_n0_n1(spark, seed):
    df, pdf = _frame(spark, n=800, seed=seed)
    for r in RK.separation_stats(RK.separation_sums(RK.value_counts(df, ["a", "b"], "y"))).collect():
        n1 = r["N1"]
        n0 = r["N"] - n1
        u1 = r["auc"] * n0 * n1
        assert r["u_stat"] + u1 == pytest.approx(n0 * n1, rel=1e-12)
        assert 0.0 <= r["auc"] <= 1.0 and -1.0 <= r["kendall_tau"] <= 1.0
