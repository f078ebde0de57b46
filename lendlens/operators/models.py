"""Weighted random forests, grid search with cross-validation, scoring and
evaluation (M1–M4, E1–E5, A18).

The forest is MLlib's: trees are grown level by level from per-partition
split statistics that are aggregated across executors, so training data is
never gathered in one place.  Class weights are an Estimator in the
pipeline, so inside cross-validation they are recomputed from each fold's
training part, like the imputer medians.
"""

from __future__ import annotations

import time
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasWeightCol, Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_dir, materialize
from . import features as FE
from . import rankstats as RK
from .profile import class_weights, confusion
from .trees import cut_confusions

ROUND = 6
#: What a task may read in one pass over the training rows.
TASK_BYTES = 256 << 20


def _r(c: Column) -> Column:
    return F.round(c, ROUND)


# ---------------------------------------------------------------------------
# class weights as an estimator (A16 inside a pipeline)
# ---------------------------------------------------------------------------

class ClassWeightModel(Model, HasLabelCol, HasWeightCol):
    w0 = Param(Params._dummy(), "w0", "weight of class 0", typeConverter=TypeConverters.toFloat)
    w1 = Param(Params._dummy(), "w1", "weight of class 1", typeConverter=TypeConverters.toFloat)

    def __init__(self, labelCol="default", weightCol="weight", w0=1.0, w1=1.0):
        super().__init__()
        self._set(labelCol=labelCol, weightCol=weightCol, w0=w0, w1=w1)

    def _transform(self, df: DataFrame) -> DataFrame:
        y = F.col(self.getLabelCol())
        return df.withColumn(self.getWeightCol(),
                             F.when(y == 1, F.lit(self.getOrDefault(self.w1))).otherwise(F.lit(self.getOrDefault(self.w0))))


class ClassWeigher(Estimator, HasLabelCol, HasWeightCol):
    """Balancing weights N / (2 n_c) learnt from the data it is fitted on."""

    @keyword_only
    def __init__(self, labelCol="default", weightCol="weight"):
        super().__init__()
        self._set(labelCol=labelCol, weightCol=weightCol)

    def _fit(self, df: DataFrame) -> ClassWeightModel:
        learnt = class_weights(df, self.getLabelCol(), rounded=False)
        weight = {int(r[self.getLabelCol()]): r["weight"] for r in learnt.collect()}
        if weight.keys() != {0, 1}:
            raise ValueError(f"the training rows hold the classes {sorted(weight)}, not 0 and 1")
        return ClassWeightModel(self.getLabelCol(), self.getWeightCol(), weight[0], weight[1])


# ---------------------------------------------------------------------------
# model
# ---------------------------------------------------------------------------

def random_forest(num_trees: int = 100, max_depth: int = 15, max_bins: int = 64, min_instances: int = 1,
                  seed: int = 42, label: str = "default", weight: str | None = "weight",
                  max_memory_mb: int = 1024) -> RandomForestClassifier:
    """M1/M2.  ``max_bins`` must exceed the largest number of levels of an
    indexed categorical (+1 for the unseen slot): 32 fails on a 36-level
    column, hence 64.

    Deep forests are pass-bound: every pass over the data grows the nodes
    whose split statistics fit in ``max_memory_mb`` per task (set it to about
    half of an executor's heap share of one task; the trees do not depend on
    it).  Node ids are cached with the training points (checkpointed every 10
    iterations to the shared checkpoint folder) instead of re-walking each
    tree per pass.
    """
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=num_trees, maxDepth=max_depth,
                                maxBins=max_bins, minInstancesPerNode=min_instances, seed=seed,
                                maxMemoryInMB=max_memory_mb,
                                cacheNodeIds=True, checkpointInterval=10)
    if weight:
        rf.setWeightCol(weight)
    return rf


def prepare(df: DataFrame, numeric: list[str], label: str = "default") -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in numeric}) \
             .withColumn(label, F.col(label).cast("int"))


def preparation(numeric: list[str], label: str = "default") -> Pipeline:
    """All that is learnt before the forest: encoders, medians, class weights."""
    return Pipeline(stages=[*FE.encoding_pipeline(numeric).getStages(), ClassWeigher(labelCol=label, weightCol="weight")])


def pass_bytes(slots: int, trees: int) -> int:
    """Bytes that a pass of the forest reads of one training row: its bins and
    bootstrap counts twice (for the split statistics and for the node ids), and
    its node ids."""
    return 2 * (4 * slots + 4 * trees + 120) + 4 * trees + 16


def _dealt(rows: DataFrame, trees: int) -> DataFrame:
    """Training rows in so many parts that no task reads more than
    ``TASK_BYTES`` of them in a pass; as they are, if their parts are small
    enough."""
    cluster = rows.sparkSession.sparkContext.defaultParallelism
    need = -(-rows.count() * pass_bytes(len(FE.slot_names(rows)), trees) // TASK_BYTES)
    need = cluster * -(-need // cluster)
    return rows if rows.rdd.getNumPartitions() >= need else rows.repartition(need)


def _training_table(train: DataFrame, numeric: list[str], label: str) -> DataFrame:
    """Training rows written once to the shared checkpoint folder: each
    pipeline stage fit (indexers, imputer, weights) and the forest then read
    this table instead of re-running the scans and joins that produced it."""
    checkpoint_dir(train.sparkSession)   # forest node-id checkpoints need it too
    return materialize(prepare(train, numeric, label), "training-rows", spread=True)


def fit(train: DataFrame, numeric: list[str], label: str = "default", **rf_args) -> tuple[PipelineModel, float]:
    """Fit the full pipeline on ``train``; returns the model and seconds
    (including writing the training table once)."""
    t0 = time.time()
    data = _training_table(train, numeric, label)
    ready = preparation(numeric, label).fit(data)
    rf = random_forest(label=label, **rf_args)
    forest = rf.fit(_dealt(ready.transform(data).select("features", label, "weight"), rf.getNumTrees()))
    return PipelineModel([*ready.stages, forest]), time.time() - t0


def score(model: PipelineModel, df: DataFrame, numeric: list[str], key: str = "id",
          label: str = "default") -> DataFrame:
    """M4: ``(key, label, prediction, p_default)`` for every row."""
    pred = model.transform(prepare(df, numeric, label))
    return pred.select(key, label, F.col("prediction").cast("int").alias("prediction"),
                       vector_to_array("probability")[1].alias("p_default"))


def timed_scoring(model: PipelineModel, df: DataFrame, numeric: list[str]) -> float:
    """Seconds to score every row, forced by a ``noop`` write (no caching,
    no collect)."""
    t0 = time.time()
    score(model, df, numeric).write.format("noop").mode("overwrite").save()
    return time.time() - t0


# ---------------------------------------------------------------------------
# grid search
# ---------------------------------------------------------------------------

def _prepared_folds(train: DataFrame, numeric: list[str], fold_col: str, k: int, label: str):
    """Per fold: prepared training rows and held-out rows, written.

    Imputation, encoding and class weights depend on the fold only, so they
    are fitted once per fold on its training part (no statistic leaks from the
    held-out fold).  They are many short jobs, so the folds are prepared beside
    each other."""
    data = _training_table(train, numeric, label)

    def one(fold: int):
        part, held = data.filter(F.col(fold_col) != fold), data.filter(F.col(fold_col) == fold)
        ready = preparation(numeric, label).fit(part)
        fitted = materialize(ready.transform(part).select("features", label, "weight"), "fold-train", spread=True)
        judged = materialize(ready.transform(held).select("features", label), "fold-held", spread=True)
        return fitted, judged

    with ThreadPool(k) as pool:
        return pool.map(inheritable_thread_target(train.sparkSession)(one), range(k))


GRID_SCHEMA = "max_depth int, n_estimators int, f1_score double"


def grid_search(train: DataFrame, numeric: list[str], trees=(10, 50, 100), depths=(5, 10, 15),
                fold_col: str = "fold", k: int = 5, label: str = "default", min_instances: int = 10,
                max_bins: int = 64, seed: int = 42) -> DataFrame:
    """k-fold CV over trees x depth; mean F1 of class 1 per configuration.

    One forest per fold is fitted, the largest of the grid; the others are its
    first trees cut at their depth (see :mod:`.trees` for how that differs from
    :func:`independent_grid_search`, which fits every configuration).
    ``fold_col`` comes from the keyed-hash fold assignment (R4).  A fold's
    held-out rows are judged while the next fold's forest grows.
    """
    total = {(d, t): 0.0 for d in depths for t in trees}

    def judge(model, judged):
        cells = metrics_from_confusion(cut_confusions(model, judged, trees, depths, label), keep=["max_depth", "n_estimators"])
        return cells.collect()  # one row per configuration

    with ThreadPool(1) as pool:
        waiting = []
        for fitted, judged in _prepared_folds(train, numeric, fold_col, k, label):
            model = random_forest(max(trees), max(depths), max_bins, min_instances, seed, label).fit(fitted)
            waiting.append(pool.apply_async(inheritable_thread_target(train.sparkSession)(judge), (model, judged)))
        for rows in waiting:
            for r in rows.get():
                total[r["max_depth"], r["n_estimators"]] += r["f1_score"] / k
    return train.sparkSession.createDataFrame([(int(d), int(t), f1) for (d, t), f1 in total.items()], GRID_SCHEMA)


def independent_grid_search(train: DataFrame, numeric: list[str], trees=(10, 50, 100), depths=(5, 10, 15),
                            fold_col: str = "fold", k: int = 5, label: str = "default", min_instances: int = 10,
                            max_bins: int = 64, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """As :func:`grid_search`, with a forest of its own for every configuration
    and fold, ``parallelism`` at a time."""
    grid = [(d, t) for d in depths for t in trees]
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    total = dict.fromkeys(grid, 0.0)
    for fitted, judged in _prepared_folds(train, numeric, fold_col, k, label):
        def one(config, fitted=fitted, judged=judged):
            depth, n = config
            rf = random_forest(n, depth, max_bins, min_instances, seed, label)
            return config, float(ev.evaluate(rf.fit(fitted).transform(judged)))

        with ThreadPool(parallelism) as pool:
            for config, f1 in pool.map(inheritable_thread_target(train.sparkSession)(one), grid):
                total[config] += f1 / k
    return train.sparkSession.createDataFrame([(int(d), int(t), f1) for (d, t), f1 in total.items()], GRID_SCHEMA)


def cutoff_grid(df: DataFrame, label: str, rows: tuple[str, list[float]], cols: tuple[str, list[float]]) -> DataFrame:
    """``(<row name>, <column name>, f1_score)``: F1 of class 1 of the rule "row
    score at least r, or column score at most c" for every pair of cut-offs,
    all from one aggregate (four counts per cell); a null score never fires."""
    y = F.coalesce(F.col(label).cast("int"), F.lit(-1))
    over, under = F.col(rows[0]), F.col(cols[0])
    cells = [(r, c) for r in rows[1] for c in cols[1]]

    def counts(r: float, c: float) -> Column:
        yes = F.coalesce(over >= r, F.lit(False)) | F.coalesce(under <= c, F.lit(False))
        return F.struct(F.lit(float(r)).alias(rows[0]), F.lit(float(c)).alias(cols[0]),
                        F.count_if((y == 0) & ~yes).alias("tn"), F.count_if((y == 0) & yes).alias("fp"),
                        F.count_if((y == 1) & ~yes).alias("fn"), F.count_if((y == 1) & yes).alias("tp"))

    long = df.agg(F.array(*[counts(r, c) for r, c in cells]).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")
    return metrics_from_confusion(long, keep=[rows[0], cols[0]]).select(rows[0], cols[0], "f1_score")


def grid_pivot(results: DataFrame, row: str = "max_depth", col: str = "n_estimators", names: list | None = None) -> DataFrame:
    """A table of F1 with one column per value of ``col``."""
    return results.groupBy(row).pivot(col, names).agg(F.first("f1_score")).orderBy(row)


def best_config(results: DataFrame, row: str = "max_depth", col: str = "n_estimators") -> DataFrame:
    """The configuration with the best F1; of equal ones the smallest."""
    best = F.max_by(F.struct(row, col, "f1_score"), F.struct("f1_score", -F.col(row), -F.col(col)))
    return results.agg(best.alias("b")).select("b.*")


# ---------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------

def metrics_from_confusion(cm: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, F.when(b > 0, b)), F.lit(0.0))

    prec, rec = safe(tp, tp + fp), safe(tp, tp + fn)
    f1 = safe(2 * prec * rec, prec + rec)
    return cm.select(*keep, "tn", "fp", "fn", "tp", _r(safe(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
                     _r(prec).alias("precision"), _r(rec).alias("recall"), _r(f1).alias("f1_score"))


def weighted_metrics(cm: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1 over both classes and
    accuracy (what MLlib's multiclass evaluator calls weightedPrecision,
    weightedRecall and f1)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def safe(a, b):
        return F.coalesce(F.try_divide(a, F.when(b > 0, b)), F.lit(0.0))

    n = tn + fp + fn + tp
    s0, s1 = tn + fp, fn + tp
    p0, p1 = safe(tn, tn + fn), safe(tp, tp + fp)
    r0, r1 = safe(tn, tn + fp), safe(tp, tp + fn)
    f0, f1 = safe(2 * p0 * r0, p0 + r0), safe(2 * p1 * r1, p1 + r1)
    return cm.select(_r(safe(tp + tn, n)).alias("accuracy"),
                     _r(safe(s0 * p0 + s1 * p1, n)).alias("weighted_precision"),
                     _r(safe(s0 * r0 + s1 * r1, n)).alias("weighted_recall"),
                     _r(safe(s0 * f0 + s1 * f1, n)).alias("weighted_f1"))


def _long(row: DataFrame, cols: list[str]) -> DataFrame:
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")).select("m.*")


CLASS_METRICS = ["accuracy", "precision", "recall", "f1_score"]


def evaluate(pred: DataFrame, label: str = "default", score_col: str = "p_default") -> DataFrame:
    """E1 + E2 + E3 in long form ``(metric, value)``: class-1 and weighted
    metrics from one confusion aggregate and the exact AUC from value counts.
    The scored rows are written once (scoring is the expensive part)."""
    pred = materialize(pred.select(F.col(label).cast("double").alias(label),
                                   F.col("prediction").cast("double").alias("prediction"), score_col),
                       "scored-rows")
    cm = confusion(pred, label, "prediction")
    auc = RK.auc(pred, score_col, label).select(F.col("auc").alias("auc_exact"))
    return _long(metrics_from_confusion(cm), CLASS_METRICS).unionByName(
        _long(weighted_metrics(cm), ["weighted_precision", "weighted_recall", "weighted_f1"])).unionByName(
        _long(auc, ["auc_exact"]))


def run_metrics(df: DataFrame, label: str, runs: dict[str, Column]) -> DataFrame:
    """``(metric, run, value)`` of several decision rules, from one aggregate."""
    y = F.col(label).cast("int")
    counts = df.agg(*[F.struct(
        F.count_if((y == 0) & ~p).alias("tn"), F.count_if((y == 0) & p).alias("fp"),
        F.count_if((y == 1) & ~p).alias("fn"), F.count_if((y == 1) & p).alias("tp")).alias(name) for name, p in runs.items()])
    rows = counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("run"), F.col(n).alias("cm")) for n in runs])).alias("r")).select("r.run", "r.cm.*")
    cells = metrics_from_confusion(rows.select("tn", "fp", "fn", "tp", "run"), keep=["run"])
    return cells.select("run", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in CLASS_METRICS])).alias("m")) \
        .select("m.metric", "run", "m.value")


def compare_runs(long: DataFrame, runs: list[str]) -> DataFrame:
    """``(metric, <run>...)`` side by side from ``(metric, run, value)``."""
    return long.groupBy("metric").pivot("run", runs).agg(F.first("value"))


def compare_fits(train: DataFrame, test: DataFrame, numeric: list[str], label: str, runs: dict[str, dict]) -> DataFrame:
    """E4 for models: fit and score each run, and compare metrics, AUC, training
    and prediction seconds; ``speed_up`` is the first run's seconds over each
    run's, training and prediction together."""
    test = materialize(test, "compared-rows", spread=True)
    seconds, long = {}, None
    for name, args in runs.items():
        model, fit_s = fit(train, numeric, label, **args)
        score_s = timed_scoring(model, test, numeric)
        seconds[name] = fit_s + score_s
        timed = train.sparkSession.createDataFrame(
            [("train_seconds", fit_s), ("predict_seconds", score_s), ("speed_up", seconds[next(iter(runs))] / seconds[name])],
            "metric string, value double")
        part = evaluate(score(model, test, numeric, label=label), label).unionByName(timed).withColumn("run", F.lit(name))
        long = part if long is None else long.unionByName(part)
    return compare_runs(long, list(runs))


def pick_cases(pred: DataFrame, key: str = "id", label: str = "default") -> DataFrame:
    """E5: the first false negative and the first true negative (by key)."""
    y, p = F.col(label), F.col("prediction")
    case = F.when((y == 1) & (p == 0), "false_negative").when((y == 0) & (p == 0), "true_negative")
    return (pred.select(case.alias("case_type"), key).filter(F.col("case_type").isNotNull())
                .groupBy("case_type").agg(F.min(key).alias(key)))
