"""Plan shape: pruning at the scan, one source scan per report, no
single-partition windows."""
import re

import __spark_entry__ as E


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark, sf_small):
    df = E.queries()["s3_curated"](spark, sf_small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = [s for s in schemas if "l_orderkey" in s]
    assert lineitem and all(s == "l_orderkey:bigint" for s in lineitem)
    assert not any("o_comment" in s for s in schemas)


def test_report_reads_value_counts_not_source(spark, sf_small):
    for name in ("a14_numeric_audit", "t16_contrast_stats", "o1_outliers_dti", "t9_numeric_ranking"):
        plan = _final_plan(E.queries()[name](spark, sf_small))
        assert "orders.parquet" not in plan, name


def test_no_single_partition_window(spark, sf_small):
    for name in ("t9_numeric_ranking", "a8_modal_concentration", "r3_exact_split", "t18_roc_int_rate",
                 "t16_contrast_stats"):
        lines = _final_plan(E.queries()[name](spark, sf_small)).splitlines()
        for i, line in enumerate(lines):
            if re.search(r"\bWindow \[", line):
                below = next((ln for ln in lines[i + 1:] if "Exchange" in ln), "")
                assert "SinglePartition" not in below, (name, line)


def test_single_pass_queries_are_lazy_and_pruned(spark, sf_small):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "building plans")
    frames = {n: E.queries()[n](spark, sf_small) for n in ("p5_title_grouped", "a1_class_distribution", "a12_default_rate_by_sub_grade")}
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("lazy") for i in tracker.getJobInfo(j).stageIds]
    # nothing but reading the tables' schemas
    assert all(s.name.startswith("parquet at") and s.numTasks == 1 for s in stages if s)
    spark.sparkContext.setJobGroup("rest", "")
    plan = frames["p5_title_grouped"]._jdf.queryExecution().executedPlan().toString()
    orders = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "o_orderkey" in s]
    assert orders and all("o_totalprice" not in s and "o_orderdate" not in s for s in orders)
    assert "lineitem" not in plan


def test_spearman_shuffles_the_rows_twice(spark, sf_small):
    from lendlens.operators import correlation as CO
    df = spark.range(200).selectExpr("id", *[f"cast((id * {k}) % 97 as double) as c{k}" for k in (3, 5, 7, 11)])
    plan = CO.spearman_matrix(df, ["c3", "c5", "c7", "c11"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_spearman_counts_rows_that_share_an_id(spark):
    from lendlens.operators import correlation as CO
    rows = [(None if i % 3 else i % 6, float(i * 7 % 20), float(i * 11 % 23)) for i in range(40)]
    shared = spark.createDataFrame(rows, "id bigint, a double, b double")
    own = spark.createDataFrame([(i, a, b) for i, (_, a, b) in enumerate(rows)], "id bigint, a double, b double")
    got, want = ([tuple(r) for r in CO.spearman_matrix(df, ["a", "b"]).collect()] for df in (shared, own))
    rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    ra, rb = rank([a for _, a, _ in rows]), rank([b for _, _, b in rows])
    mid = (len(rows) + 1) / 2
    dot = lambda u, v: sum((x - mid) * (y - mid) for x, y in zip(u, v, strict=True))
    assert got == want == [("a", "b", round(dot(ra, rb) / (dot(ra, ra) * dot(rb, rb)) ** 0.5, 6))]


def test_spearman_does_not_shuffle_hot_values(spark):
    from pyspark.sql import functions as F

    from lendlens.operators import correlation as CO
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("a").cast("double"),
                                  (F.col("id") * 7 % 1000).cast("double").alias("b"))
    data = df.fillna(0.0)
    cold = CO._cold_cells(data, {"a": {0.0: 1350.0}, "b": {}}, "id")
    assert cold.where("variable = 'a'").count() == 299 and cold.where("variable = 'b'").count() == 3000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in cold.repartition("variable", "value").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = CO.spearman_matrix(df, ["a", "b"]).first()["rho"]
    pdf = data.toPandas()
    assert abs(got - pdf["a"].rank().corr(pdf["b"].rank())) < 1e-6


def test_pruning_counts_the_cells_once(spark, monkeypatch):
    from lendlens.operators import correlation as CO
    rows = [(i % 4 // 3, None if i % 5 == 0 else float(i % 9), float("nan") if i % 7 == 0 else float(i % 9 - 4), float(i * 7 % 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double")
    plain, calls = CO.RK.value_counts, []
    monkeypatch.setattr(CO.RK, "value_counts", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = sorted(map(tuple, CO.prune_correlated(df, ["a", "b", "c"], "y", 0.0).collect()))
    assert len(calls) == 1
    rho = {(r["var_a"], r["var_b"]): r["rho"] for r in CO.spearman_matrix(df, ["a", "b", "c"]).collect()}
    ks = {r["variable"]: round(r["ks"], 6) for r in CO.RK.separation_stats(CO.RK.separation_sums(plain(df, ["a", "b", "c"], "y"))).collect()}
    assert [r[:5] for r in got] == sorted((a, b, v, ks[a], ks[b]) for (a, b), v in rho.items())
