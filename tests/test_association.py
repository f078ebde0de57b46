"""Chi-square / Cramér's V / Holm against hand computations."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.operators import association as AS


def _chi2(table, yates=False):
    t = np.asarray(table, float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    d = np.abs(t - e)
    if yates:
        d = d - np.minimum(0.5, d)
    return float(np.sum(d * d / e))


def test_three_level_chi_square(spark):
    rows = [("a", 0)] * 30 + [("a", 1)] * 10 + [("b", 0)] * 20 + [("b", 1)] * 20 + [("c", 0)] * 25 + \
           [("c", 1)] * 5 + [(None, 1)] * 7
    df = spark.createDataFrame(rows, "lvl string, default int")
    r = AS.chi_square_table(df, ["lvl"]).first()
    stat = _chi2([[30, 10], [20, 20], [25, 5]])
    assert r["chi2"] == pytest.approx(stat, abs=1e-6)
    assert r["dof"] == 2 and r["n"] == 110
    assert r["cramers_v"] == pytest.approx(np.sqrt(stat / 110), abs=1e-6)


def test_two_by_two_uses_yates(spark):
    rows = [("x", 0)] * 12 + [("x", 1)] * 5 + [("y", 0)] * 9 + [("y", 1)] * 11
    df = spark.createDataFrame(rows, "lvl string, default int")
    r = AS.chi_square_table(df, ["lvl"]).first()
    assert r["chi2"] == pytest.approx(_chi2([[12, 5], [9, 11]], yates=True), abs=1e-6)


def test_single_level_is_skipped_and_null_level_variant(spark):
    rows = [("only", 0), ("only", 1), (None, 1)]
    df = spark.createDataFrame(rows, "lvl string, default int")
    assert AS.chi_square_table(df, ["lvl"]).count() == 0
    assert AS.chi_square_table(df, ["lvl"], nulls="level").first()["n_levels"] == 2


def test_nested_levels_give_v_one(spark):
    rows = [(g, f"{g}{i}") for g in "ABC" for i in range(1, 4) for _ in range(5 + i)]
    df = spark.createDataFrame(rows, "grade string, sub_grade string")
    r = AS.pair_association(df, "grade", "sub_grade").first()
    assert r["nested"] is True
    assert r["cramers_v"] == pytest.approx(1.0, abs=1e-9)
    assert r["conclusion"] == "redundant"


def test_pair_chi_square_matches_dense_table(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, 500)
    b = (a + rng.integers(0, 3, 500)) % 5
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    table = np.zeros((4, 5))
    for x, y in zip(a, b):
        table[x, y] += 1
    table = table[:, table.sum(0) > 0]
    r = AS.pair_association(df.select(F.col("a").cast("string"), F.col("b").cast("string")), "a", "b").first()
    assert r["chi2"] == pytest.approx(_chi2(table), abs=1e-5)


def test_holm_matches_definition(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.2]
    df = spark.createDataFrame([(f"v{i}", x) for i, x in enumerate(p)], "variable string, p_value double")
    got = {r["variable"]: r["p_holm"] for r in AS.holm(df).collect()}
    order = np.argsort(p)
    m = len(p)
    adj = np.minimum(1, np.maximum.accumulate([(m - i) * p[j] for i, j in enumerate(order)]))
    for i, j in enumerate(order):
        assert got[f"v{j}"] == pytest.approx(adj[i])
        assert got[f"v{j}"] >= p[j]


def test_holm_is_monotone_in_raw_order(spark):
    rng = np.random.default_rng(9)
    p = rng.random(30) ** 3
    df = spark.createDataFrame([(f"v{i:02d}", float(x)) for i, x in enumerate(p)], "variable string, p_value double")
    rows = sorted(AS.holm(df).collect(), key=lambda r: (r["p_value"], r["variable"]))
    adj = [r["p_holm"] for r in rows]
    assert all(a <= b for a, b in zip(adj, adj[1:]))
    assert all(r["p_holm"] >= r["p_value"] and r["p_holm"] <= 1.0 for r in rows)
