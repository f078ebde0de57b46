"""Row-level rules, including ANSI-safe casts of garbage text."""
from pyspark.sql import functions as F

from lendlens.operators import recode as R


def test_target_and_recodes(spark):
    rows = [("Fully Paid", "w", "10+ years", "RENT", "$30,100", "Debt consolidation loan", "Jan-2015", "Feb-1999"),
            ("Charged Off", " F ", "< 1 year", None, "12.5%", "my credit card", "Mar-2016", "f"),
            ("Current", "72", "garbage", "ANY", "n/a", None, "x", "Jan-2000")]
    df = spark.createDataFrame(rows, "loan_status string, ils string, emp string, home string, num string, "
                                     "title string, issue string, earliest string")
    t = R.create_target(df)
    assert sorted(r["default"] for r in t.collect()) == [0, 1]
    out = df.select(R.normalize_code("ils").alias("ils"), R.map_values("emp", R.EMP_LENGTH_YEARS).alias("emp"),
                    R.keep_levels("home", R.HOME_OWNERSHIP_LEVELS).alias("home"),
                    R.clean_numeric_text("num").alias("num"), R.group_text("title").alias("title"),
                    R.months_between_text("issue", "earliest").alias("age"),
                    R.coerce_int("earliest").alias("bad_int")).collect()
    assert [r["ils"] for r in out] == ["Whole", "Fractional", None]
    assert [r["emp"] for r in out] == [10, 0, None]
    assert [r["home"] for r in out] == ["RENT", "OTHER", "OTHER"]
    assert [r["num"] for r in out] == [30100.0, 12.5, None]
    assert [r["title"] for r in out] == ["Debt Consolidation", "Credit Card Refinancing", "Other"]
    assert [r["age"] for r in out] == [191, None, None]
    assert [r["bad_int"] for r in out] == [None, None, None]


def test_null_outside_and_drop_sparse(spark):
    df = spark.createDataFrame([(150.0, None), (50.0, None), (-1.0, 1.0)], "dti double, sparse double")
    got = [r[0] for r in df.select(R.null_outside("dti", 0, 100)).collect()]
    assert got == [None, 50.0, None]
    assert R.drop_sparse(df, 50.0).columns == ["dti"]
    assert R.drop_present(df, ["sparse", "absent"]).columns == ["dti"]


def test_share_uses_scalar_subquery(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "lvl string")
    counts = df.groupBy("lvl").agg(F.count(F.lit(1)).alias("n"))
    got = {r["lvl"]: r["pct"] for r in R.with_share(counts, df).collect()}
    assert abs(got["a"] - 200 / 3) < 1e-9
    plan = R.with_share(counts, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
