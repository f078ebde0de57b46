"""Evaluation arithmetic, class weights and the batch explanation solver."""
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lendlens.operators import explain as X
from lendlens.operators import models as M
from lendlens.operators import profile as A
from lendlens.operators import sampling as SA
from lendlens.plans import study as S


def test_metrics_are_zero_safe(spark):
    cm = spark.createDataFrame([(10, 0, 5, 0)], "tn long, fp long, fn long, tp long")
    r = M.metrics_from_confusion(cm).first()
    assert (r["precision"], r["recall"], r["f1_score"]) == (0.0, 0.0, 0.0)
    assert r["accuracy"] == pytest.approx(10 / 15, abs=1e-6)
    empty = spark.createDataFrame([(0, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    assert M.metrics_from_confusion(empty).first()["accuracy"] == 0.0


def test_published_confusion_matrix_metrics(spark):
    cm = spark.createDataFrame([(146187, 69035, 21245, 32408)], "tn long, fp long, fn long, tp long")
    r = M.metrics_from_confusion(cm).first()
    assert r["accuracy"] == pytest.approx(0.6642, abs=1e-4)
    assert r["precision"] == pytest.approx(0.3195, abs=1e-4)
    assert r["recall"] == pytest.approx(0.6040, abs=1e-4)


def test_class_weights_sum_to_n(spark, sf_small):
    df = S.curated_loans(spark, sf_small)
    w = A.with_class_weights(df, "default").agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(df.count(), rel=1e-9)


@pytest.fixture(scope="module")
def fitted(spark, sf_small):
    df = S.curated_loans(spark, sf_small)
    train, test = SA.split_frames(df)
    model, _ = M.fit(train, S.NUMERIC_FEATURES, num_trees=5, max_depth=4, seed=1)
    return model, train, test


def test_forest_scores_every_row(spark, fitted):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    model, _, test = fitted
    pred = M.score(model, test, S.NUMERIC_FEATURES)
    assert pred.count() == test.count()
    ev = {r["metric"]: r["value"] for r in M.evaluate(pred).collect()}
    # the target carries signal but the features do not give it away
    assert 0.55 < ev["auc_exact"] < 0.9
    binned = BinaryClassificationEvaluator(labelCol="default", rawPredictionCol="p_default").evaluate(pred)
    assert ev["auc_exact"] == pytest.approx(binned, abs=0.005)
    doubles = pred.withColumns({c: F.col(c).cast("double") for c in ("default", "prediction")})
    mc = MulticlassClassificationEvaluator(labelCol="default", predictionCol="prediction")
    for ours, theirs in (("accuracy", "accuracy"), ("weighted_f1", "f1"), ("weighted_precision", "weightedPrecision")):
        assert ev[ours] == pytest.approx(mc.evaluate(doubles, {mc.metricName: theirs}), abs=1e-6)


def test_grid_search_on_a_small_grid(spark, fitted):
    _, train, _ = fitted
    got = M.grid_search(SA.assign_folds(train, 2, 42), S.NUMERIC_FEATURES, trees=(20,), depths=(2, 6), k=2).collect()
    assert {(r["max_depth"], r["n_estimators"]) for r in got} == {(2, 20), (6, 20)}
    # guessing at the base rate of 0.25 scores about 0.33
    assert all(0.34 < r["f1_score"] < 0.9 for r in got), got


def test_pipeline_medians_are_the_exact_ones(spark, sf_small):
    from lendlens.operators import features as FE
    df = S.curated_loans(spark, sf_small)
    model = FE.median_imputer(["dti", "avg_cur_bal"]).fit(df)
    want = {r["variable"]: r["m"] for r in FE.RK.exact_quantiles(df, ["dti", "avg_cur_bal"], {"m": 0.5}).collect()}
    assert model.getOrDefault(model.medians) == [want["dti"], want["avg_cur_bal"]]


def test_explanation_solver_matches_numpy_ridge(spark, fitted):
    model, train, test = fitted
    num = S.NUMERIC_FEATURES
    cases = M.prepare(test, num).orderBy("id").limit(1)
    got = X.explain(model, M.prepare(train, num), cases, num, n_samples=400, top=len(num)).toPandas()
    # brute force: same perturbations, numpy weighted ridge
    from lendlens.operators.features import impute
    bins = X.fit_bins(M.prepare(train, num), num)
    c2 = impute(cases, {n: b["edges"][1] for n, b in bins.items()})
    pert = X.perturb(c2, bins, "id", 400, 42)
    scored = model.transform(pert).withColumn("y", vector_to_array("probability")[1])
    pdf = scored.select("y", *[f"z_{n}" for n in bins]).toPandas()
    z = pdf[[f"z_{n}" for n in bins]].to_numpy()
    y = pdf["y"].to_numpy()
    w = np.sqrt(np.exp(-((1 - z) ** 2).sum(1) / (0.75 * np.sqrt(len(bins))) ** 2))
    zm, ym = np.average(z, 0, w), np.average(y, weights=w)
    zc, yc = z - zm, y - ym
    coef = np.linalg.solve(zc.T @ (zc * w[:, None]) + np.eye(len(bins)), zc.T @ (w * yc))
    ref = dict(zip(bins, coef))
    for _, r in got.iterrows():
        assert r["weight"] == pytest.approx(ref[r["feature"]], abs=1e-8)


def test_alias_table_keeps_the_shares_exactly(spark):
    from lendlens.operators import explain as X
    levels = [("a", 500), ("b", 300), ("c", 90), ("d", 90), (None, 15), ("e", 4), ("f", 1)]
    train = spark.createDataFrame([(v, v if v in ("a", None) else "same", "one") for v, n in levels for _ in range(n)], "x string, y string, z string")
    table = X.level_shares(train, ["x", "y", "z"]).collect()
    for var, want in (("x", dict(levels)), ("y", {"a": 500, "same": 485, None: 15}), ("z", {"one": 1000})):
        rows = [r for r in table if r["variable"] == var]
        assert sorted(r["slot"] for r in rows) == list(range(len(want))) and {r["k"] for r in rows} == {len(want)}
        got = dict.fromkeys(want, 0.0)
        for r in rows:
            got[r["level"]] += r["keep"] / len(want)
            if r["keep"] < 1:
                got[r["other"]] += (1 - r["keep"]) / len(want)
            assert -1e-12 <= r["keep"] <= 1
        assert all(abs(got[k] - n / 1000) < 1e-12 for k, n in want.items())


def test_draws_of_many_levels_cost_one_match(spark):
    from lendlens.operators import explain as X
    train = spark.range(1_000_000).select(F.when(F.col("id") < 200_000, 0).otherwise(F.col("id")).cast("string").alias("c"))
    table = X.level_shares(train, ["c"])
    assert table.count() == table.select("slot").distinct().count() == 800_001
    rows = spark.range(1).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(4999))))
    drawn = X._draw_levels(rows, table, ["c"], 0, "id", 3)
    assert drawn.count() == 5000 and 900 < drawn.where("__l_c = '0'").count() < 1100
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan and ">=" not in [ln for ln in plan.splitlines() if "Join Inner" in ln and "slot" in ln][0]


def test_samples_of_few_cases_lie_in_many_partitions(spark):
    from lendlens.operators import explain as X
    train = spark.range(400).select("id", (F.col("id") % 40).cast("double").alias("v"), (F.col("id") % 4).cast("string").alias("c"))
    bins, levels = X.fit_bins(train, ["v"]), X.level_shares(train, ["c"])
    out = X.perturb(train.where("id < 2"), bins, "id", 1000, 1, levels, ["c"])
    slots = spark.sparkContext.defaultParallelism
    assert out.rdd.getNumPartitions() >= slots
    assert out.select(F.spark_partition_id()).distinct().count() >= slots and out.count() == 2000


@pytest.fixture(scope="module")
def small_forest(spark, fitted):
    model, _, test = fitted
    ready = model.transform(M.prepare(test, S.NUMERIC_FEATURES)).select("id", "default", "features", "probability", "prediction")
    return model.stages[-1], M.materialize(ready, "small-forest-rows")


def _walk(nodes, tree, x, steps):
    node = nodes[tree, 0]
    while node["left"] >= 0 and steps:
        v = x[node["feature"]]
        left = v in node["left_levels"] if node["levels"] >= 0 else v <= node["threshold"]
        node, steps = nodes[tree, node["left"] if left else node["right"]], steps - 1
    return node["share"]


def test_cut_forest_is_what_its_inner_nodes_say(small_forest):
    from lendlens.operators import trees as TR
    rf, rows = small_forest
    nodes = {(r["tree"], r["node"]): r for r in TR.tree_table(rf).collect()}
    forest = TR.Forest.of(TR.tree_table(rf))
    assert forest.depth == 4 and len(forest.roots) == 5
    some = rows.limit(120).collect()
    x = np.array([r["features"].toArray() for r in some])
    shares = forest.shares(x, [0, 2, 4])
    for d in (0, 2, 4):
        want = np.array([[_walk(nodes, t, v, d) for v in x] for t in range(5)])
        assert np.allclose(shares[d], want, atol=1e-12)
    # uncut, it is the fitted forest
    assert np.allclose(shares[4].mean(axis=0), [r["probability"][1] for r in some], atol=1e-9)
    got = {(r["max_depth"], r["n_estimators"]): r for r in TR.cut_confusions(rf, rows, [2, 5], [1, 4]).collect()}
    whole = A.confusion(rows, "default", "prediction").first()
    assert len(got) == 4 and all(got[4, 5][c] == whole[c] for c in ("tn", "fp", "fn", "tp"))


def test_sql_scores_the_exported_trees(small_forest):
    import duckdb

    from lendlens.operators import features as FE
    from lendlens.operators import trees as TR
    rf, rows = small_forest
    con = duckdb.connect()
    nodes, values = TR.tree_table(rf).toArrow(), FE.vector_rows(rows).toArrow()
    con.register("nodes", nodes)
    con.register("vals", values)
    con.register("ids", rows.select("id").toArrow())
    got = dict(con.execute("""
WITH RECURSIVE walk AS (
  SELECT id, tree, node, "left" AS l, "right" AS r, feature, threshold, levels, left_levels, share FROM ids, nodes WHERE node = 0
  UNION ALL
  SELECT w.id, w.tree, n.node, n."left", n."right", n.feature, n.threshold, n.levels, n.left_levels, n.share
  FROM walk w LEFT JOIN vals v ON v.id = w.id AND v.slot = w.feature
  JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN
    CASE WHEN w.levels >= 0 THEN list_contains(w.left_levels, CAST(COALESCE(v.value, 0) AS INTEGER)) ELSE COALESCE(v.value, 0) <= w.threshold END
    THEN w.l ELSE w.r END
  WHERE w.l >= 0)
SELECT id, SUM(share) / 5 FROM walk WHERE l < 0 GROUP BY id""").fetchall())
    want = {r["id"]: float(r["probability"][1]) for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_slots_have_names(small_forest):
    from lendlens.operators import features as FE
    names = FE.slot_names(small_forest[1])
    assert names[0] == "int_rate_imp" and len(names) == small_forest[1].first()["features"].size


def test_nested_grid_is_near_the_independent_one(spark, fitted):
    _, train, _ = fitted
    folds = SA.assign_folds(train, 2, 42)
    grid = {"trees": (5, 20), "depths": (3, 6), "k": 2}
    a, b = ({(r["max_depth"], r["n_estimators"]): r["f1_score"] for r in f(folds, S.NUMERIC_FEATURES, **grid).collect()}
            for f in (M.grid_search, M.independent_grid_search))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.08 for k in a), (a, b)


def test_training_rows_are_dealt_by_what_a_pass_reads(spark, sf_small, monkeypatch):
    train, _ = SA.split_frames(S.curated_loans(spark, sf_small))
    n = train.count()
    # more than the task slots ask for
    monkeypatch.setattr(M, "TASK_BYTES", n * M.pass_bytes(60, 5) // 20)
    parts = []
    plain = M.RandomForestClassifier.fit
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or plain(self, df))
    model, _ = M.fit(train, S.NUMERIC_FEATURES, num_trees=5, max_depth=2, seed=1)
    assert parts[0] >= 20 and model.stages[-1].getNumTrees == 5


def test_folds_are_prepared_and_judged_beside_the_fits(spark, fitted, monkeypatch):
    import threading
    _, train, _ = fitted
    where = {"prepare": [], "fit": [], "judge": []}

    def noted(owner, name, step):
        plain = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, **k: where[step].append(threading.get_ident()) or plain(*a, **k))
    noted(M.ClassWeigher, "_fit", "prepare")
    noted(M.RandomForestClassifier, "fit", "fit")
    noted(M, "cut_confusions", "judge")
    got = M.grid_search(SA.assign_folds(train, 3, 42), S.NUMERIC_FEATURES, trees=(3, 6), depths=(2, 4), k=3).collect()
    assert len(got) == 4 and {len(x) for x in where.values()} == {3}
    # one thread per fold, the caller's, and one that is neither
    assert len(set(where["prepare"])) == 3 and set(where["fit"]) == {threading.get_ident()}
    assert len(set(where["judge"])) == 1 and not set(where["judge"]) & set(where["fit"])


def _made_forest(spark, trees, depth, seed):
    """Full trees over feature 0 (150 thresholds) and feature 1 (150 levels)."""
    rng = np.random.default_rng(seed)
    rows, inner = [], 2 ** depth - 1
    for t in range(trees):
        for n in range(2 * inner + 1):
            by_level, leaf = bool(rng.integers(2)), n >= inner
            some = sorted(rng.choice(150, 60, replace=False).tolist())
            rows.append((t, n, -1 if leaf else int(by_level), None if leaf or by_level else float(rng.integers(150)),
                         150 if by_level and not leaf else -1, some if by_level and not leaf else [],
                         -1 if leaf else 2 * n + 1, -1 if leaf else 2 * n + 2, float(rng.random())))
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, levels int, left_levels array<int>, "
                                       "left int, right int, share double")


def test_walk_agrees_with_every_node_beyond_64_bins(spark):
    from lendlens.operators import trees as TR
    table = _made_forest(spark, 8, 7, 5)
    nodes, forest = {(r["tree"], r["node"]): r for r in table.collect()}, TR.Forest.of(table)
    assert forest.depth == 7 and any(len(c) > 64 for c in forest.cuts.values())
    values = np.arange(-1, 151)
    x = np.column_stack([np.repeat(values, 3) + np.tile([0.0, 0.5, 0.0], len(values)), np.resize(np.arange(150.0), 3 * len(values))])
    x[2::9, 0] = np.nan  # a column without values: on no threshold's left
    shares = forest.shares(x, [3, 7])
    for d in (3, 7):
        assert np.array_equal(shares[d], [[_walk(nodes, t, v, d) for v in x] for t in range(8)])


def test_levels_beyond_those_that_go_left_go_right(spark):
    from lendlens.operators import trees as TR
    rows = [(0, 0, 0, None, 80, [63], 1, 2, 0.5), (0, 1, -1, None, -1, [], -1, -1, 1.0), (0, 2, -1, None, -1, [], -1, -1, 0.0)]
    forest = TR.Forest.of(spark.createDataFrame(rows, _made_forest(spark, 1, 1, 0).schema))
    assert forest.shares(np.array([[62.0], [63.0], [64.0], [79.0]]), [1])[1].tolist() == [[0.0, 1.0, 0.0, 0.0]]


def test_walk_holds_little_beside_its_result(spark):
    import tracemalloc

    from lendlens.operators import trees as TR
    forest = TR.Forest.of(_made_forest(spark, 30, 6, 1))
    x = np.random.default_rng(2).integers(0, 150, (20_000, 2)).astype(float)
    tracemalloc.start()
    shares = forest.shares(x, [6])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shares[6].shape == (30, 20_000) and peak < 2 * shares[6].nbytes, peak
