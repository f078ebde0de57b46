"""Constant columns, single rows, one class and empty tables give NULL, not errors."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.operators import association as AS
from lendlens.operators import distribution as D
from lendlens.operators import models as M
from lendlens.operators import profile as A
from lendlens.operators import rankstats as RK
from lendlens.operators import sampling as SA


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, 0.1, float(i % 7), None, i % 2) for i in range(100)]
    return spark.createDataFrame(rows, "id bigint, const double, x double, missing double, y int")


def test_constant_column_does_not_stop_a_report(frame):
    got = {r["variable"]: r for r in D.normality_report_full(frame, ["const", "x"]).collect()}
    assert set(got) == {"const", "x"}
    assert got["const"]["ks_normal"] is None and got["const"]["sf_w"] is None and got["const"]["skewness"] is None
    assert got["const"]["normal"] == "no" and got["x"]["ks_normal"] > 0
    h = D.histogram(frame, "const").collect()
    assert [(r["bin"], r["n"], r["density"]) for r in h] == [(1, 100, None)]
    audit = {r["variable"]: r for r in D.numeric_audit(frame, ["const", "missing"]).collect()}
    assert audit["const"]["sd"] == 0 and audit["missing"]["mean"] is None and audit["missing"]["null_pct"] == 100


def test_single_row(frame):
    one = frame.limit(1)
    r = D.normality_report_full(one, ["x"]).first()
    assert (r["ks_normal"], r["sf_w"], r["normal"]) == (None, None, "no")
    assert RK.ks_normal(one, ["x"]).first()["ks_normal"] is None
    assert D.histogram(one, "x").first()["n"] == 1


def test_one_class(frame):
    zeros = frame.where("y = 0")
    roc = RK.roc_curve(zeros, "x", "y").collect()
    assert roc and all(r["tpr"] is None and 0 < r["fpr"] <= 1 for r in roc)
    assert RK.auc(zeros, "x", "y").first()["auc"] is None
    with pytest.raises(ValueError, match="classes"):
        M.ClassWeigher(labelCol="y", weightCol="w").fit(zeros)


def test_empty_table(frame):
    none = frame.limit(0)
    assert all(r["pct_missing"] is None for r in A.null_report(none).collect())
    assert A.string_missing_report(none).count() == A.numeric_missing_report(none, ()).count() == 0
    assert all(r["cr_pct"] is None for r in A.cardinality(none, ["x"]).collect())
    assert D.normality_report_full(none, ["x"]).count() == 0
    assert RK.roc_curve(none, "x", "y").count() == 0


def test_two_by_two_is_corrected(spark):
    cells = {("a", "c"): 12, ("a", "d"): 5, ("b", "c"): 3, ("b", "d"): 9}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "p string, q string")
    r = AS.pair_association(df, "p", "q").first()
    assert r["chi2"] == pytest.approx(4.171458, abs=1e-6) and r["critical_value"] == pytest.approx(3.8415, abs=1e-4)
    assert r["cramers_v"] == pytest.approx((4.171458 / 29) ** 0.5, abs=1e-6) and r["effect"] == "Medium"


def test_shapiro_francia_does_not_depend_on_the_mean(spark):
    x = np.random.default_rng(3).normal(size=2000)
    df = spark.createDataFrame([(float(v), float(v + 1e9)) for v in x], "a double, b double")
    got = {r["variable"]: r["sf_w"] for r in D.shapiro_francia(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(got["b"], abs=1e-5) and got["a"] > 0.99


def test_stratified_folds_are_even(frame):
    got = SA.assign_folds(frame, 5, 1, stratify="y").groupBy("y", "fold").count().collect()
    assert len(got) == 10 and all(r["count"] == 10 for r in got)


def test_exact_split_of_any_fraction(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(500)], "id bigint, y boolean")
    for frac in (0.0, 0.001, 0.37, 1.0):
        got = {(r["y"], r["split"]): r["count"] for r in
               SA.stratified_split(df, "y", frac, 7, exact=True).groupBy("y", "split").count().collect()}
        for cls, n in ((True, 167), (False, 333)):
            assert got.get((cls, "train"), 0) == round(n * frac)


def test_only_wanted_buckets_are_sorted(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4000)], "x double")
    plan = RK.quantiles(RK.value_counts(df, ["x"]), ["variable"], {"m": 0.5}, buckets=16)
    assert plan.first()["m"] == 1999.5
    below = plan._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)[1]
    # what the running count sorts has met the few wanted buckets first
    assert "Join Inner" in below.split("Window [", 1)[0]


def test_explanations_draw_any_number_of_levels(spark):
    from lendlens.operators import explain as X
    train = spark.createDataFrame([(f"l{i % 5000}", "a" if i % 4 else None) for i in range(20000)], "c string, d string")
    shares = X.level_shares(train, ["c", "d"])
    rows = spark.range(1).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(3999))))
    drawn = X._draw_levels(rows, shares, ["c", "d"], 0, "id", 3)
    assert drawn.count() == 4000
    assert drawn.select("__l_c").distinct().count() > 2000
    share = drawn.where("__l_d is null").count() / 4000
    assert 0.22 < share < 0.28
