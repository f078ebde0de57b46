"""Splits and folds: sizes, stratification and reproducibility."""
from pyspark.sql import functions as F

from lendlens.operators import sampling as SA


def _df(spark, n=5000):
    return spark.range(n).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("default"))


def test_hash_split_sums_and_is_partition_independent(spark):
    df = _df(spark)
    a = SA.stratified_split(df).groupBy("split").count().collect()
    assert sum(r["count"] for r in a) == 5000
    b = SA.stratified_split(df.repartition(13)).select("id", "split")
    c = SA.stratified_split(df.repartition(3)).select("id", "split")
    assert b.exceptAll(c).count() == 0


def test_exact_split_is_exact_per_class(spark):
    df = _df(spark)
    out = SA.stratified_split(df, exact=True).groupBy("default", "split").count().collect()
    got = {(r["default"], r["split"]): r["count"] for r in out}
    assert got[(1, "train")] == round(1000 * 0.8) and got[(0, "train")] == round(4000 * 0.8)


def test_union_keeps_every_row_and_folds_cover(spark):
    df = _df(spark)
    u = SA.class_wise_union(df)
    assert u.count() == 5000 and u.select("id").distinct().count() == 5000
    folds = SA.assign_folds(df, 5).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]
    assert min(r["count"] for r in folds) > 800


def test_sample_size_is_exact(spark):
    df = _df(spark)
    assert SA.sample_size(df, 123).count() == 123
    audit = {r["split"]: r["n"] for r in SA.split_audit(SA.stratified_split(df)).collect()}
    assert audit["all"] == audit["train"] + audit["test"] == 5000


def test_exact_split_descends_until_a_range_can_be_sorted(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3 == 0).alias("y"))
    h = SA.keyed_hash("id", 3)
    hashed = df.where("y is not null").select(F.col("y").cast("string").alias("__cls"), h.alias("__h"))
    for frac in (0.0, 0.37, 1.0):
        wide, deep = (sorted(map(tuple, SA._cuts(hashed, frac, b).collect())) for b in (1 << 30, 48))
        part = lambda cuts: {c: hashed.where((F.col("__cls") == c) & (F.col("__h") <= x)).count() for c, x in cuts}
        assert part(wide) == part(deep) == {"false": round(2133 * frac), "true": round(1067 * frac)}
    got = SA.stratified_split(df, "y", 0.37, 3, exact=True)
    assert got.where("y is null and split is not null").count() == 0
    plan = SA._cuts(hashed, 0.37, 48)._jdf.queryExecution().optimizedPlan().toString()
    assert "[__cls" in plan and ", __at" in plan  # the last sort is inside a class's range


def test_stratified_folds_of_rows_without_a_class(spark):
    df = spark.range(101).select("id", F.when(F.col("id") < 50, "a").alias("y"))
    got = SA.assign_folds(df, 5, 1, stratify="y").groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in got) == [10] * 9 + [11]
