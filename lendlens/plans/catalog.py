"""Query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator id.

Every query reads the driver tables (through the derived ``loans`` table),
so its work grows with the data; none runs on made-up input.  Floating
results of aggregates are rounded to 6 decimals so Spark and the SQL oracle
hash alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import study as S
from ..operators import association as AS
from ..operators import correlation as CO
from ..operators import explain as X
from ..operators import features as FE
from ..operators import models as M
from ..operators import sampling as SA
from ..operators import distribution as D
from ..operators import profile as A
from ..operators import rankstats as RK
from ..operators import recode as R
from ..functions import labels, special
from ..sources import files as FS
from ..sources.tables import source_stamp

T = S.TARGET

# The columns each report looks at (the study's own lists,
# restricted to those the derived table carries).
STRING_AUDIT_DESCRIPTIONS = {
    "addr_state": "State of residence given by the applicant.",
    "purpose": "Declared use of the loan.",
    "initial_list_status": "Initial listing status of the loan (whole or fractional).",
    "sub_grade": "Detailed risk grade assigned by the lender.",
    "home_ownership": "Home ownership status (own, mortgage, rent, other).",
    "verification_status": "Whether the income was verified.",
}
CONCENTRATION_COLUMNS = ["emp_length", "policy_code", "initial_list_status", "inq_last_6mths",
                         "earliest_cr_line", "addr_state", "grade", "purpose", "title_grouped",
                         "pymnt_plan", "issue_d", "verification_status", "home_ownership", "sub_grade"]
CARDINALITY_COLUMNS = ["id", "emp_title", "title"]
RANKED_NUMERIC = S.RANKING_FEATURES + ["inq_last_6mths", "annual_inc", "revol_util",
                                       "credit_age_months", "emp_length_int"]
SCORECARD_CUTOFF = 12.0
HAMPEL_COLUMNS = ["int_rate", "dti", "avg_cur_bal", "tot_hi_cred_lim", "total_bc_limit"]
BOX_COLUMNS = ["int_rate", "dti", "fico_range_high", "avg_cur_bal"]
# policy_code is constant: its rows show what a report says of such a column
SHAPE_COLUMNS = ["policy_code", "int_rate", "fico_range_high", "fico_range_low", "dti", "acc_open_past_24mths",
                 "avg_cur_bal", "tot_hi_cred_lim", "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m",
                 "percent_bc_gt_75", "total_bc_limit", "num_actv_rev_tl", "num_rev_tl_bal_gt_0",
                 "inq_last_6mths"]
PATTERN_COLUMNS = ["dti", "avg_cur_bal", "bc_open_to_buy", "emp_length", "title", "home_ownership",
                   "mths_since_last_record"]


_LEARNED: dict = {}


def _memo(spark, sf_dir, name, build):
    """Per-session memo of small learned things (fitted models, grid results,
    P3's column list); it is dropped when the source files change."""
    stamp = source_stamp(spark, sf_dir, S.SOURCES)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LEARNED or _LEARNED[key][0] != stamp:
        _LEARNED[key] = stamp, build()
    return _LEARNED[key][1]


def _lt(spark, sf_dir):
    """Lazy, from the driver tables (queries of one row-wise pass)."""
    return S.loans_with_target(spark, sf_dir)


def _any_lt(spark, sf_dir):
    """For reports of one pass: the shared table if there is one, else lazy."""
    return S.shared_loans(spark, sf_dir, write=False)


def _shared_lt(spark, sf_dir):
    """For reports of several passes."""
    return S.shared_loans(spark, sf_dir)


def _cleaned(spark, sf_dir):
    return S.cleaned_loans(spark, sf_dir, _memo(spark, sf_dir, "sparse", lambda: S.sparse_columns(spark, sf_dir)))


def _curated(spark, sf_dir):
    """For reports of one pass; see :func:`_any_lt`."""
    return S.curated(S.shared_recoded(spark, sf_dir, write=False))


def _shared_curated(spark, sf_dir):
    return S.curated(S.shared_recoded(spark, sf_dir))


def _reduced(spark, sf_dir):
    """Cleaned table after the cardinality and low-variance drops."""
    return R.drop_present(_cleaned(spark, sf_dir), R.HIGH_CARDINALITY_COLUMNS + R.LOW_VARIANCE_COLUMNS)


# --- sources ---------------------------------------------------------------
def s3_loans(spark, sf_dir):
    return S.loans(spark, sf_dir)


def s3_curated(spark, sf_dir):
    """The full preparation plan from the raw tables (filters pushed to the
    orders scan, columns pruned at every scan)."""
    return S.curated_loans(spark, sf_dir)


def s5_preview(spark, sf_dir):
    cols = ["id", "int_rate", "annual_inc", "revol_util", "inq_last_6mths"]
    return FS.preview(_any_lt(spark, sf_dir), cols, 12, "id")


def s2_csv_roundtrip(spark, sf_dir):
    """Raw loans written as gzip CSV by the executors, read back with the
    explicit schema (no inference)."""
    raw = S.loans(spark, sf_dir)
    path = FS.write_csv(raw, FS.scratch_path(spark, "loans-csv"))
    return FS.read_csv(spark, path, raw.schema, partitions=spark.sparkContext.defaultParallelism)


def s4_curated_sink(spark, sf_dir):
    path = FS.write_curated(_curated(spark, sf_dir), FS.scratch_path(spark, "curated"),
                            S.FINAL_FEATURES, T, extra=["id"])
    return spark.read.parquet(path)


# --- P: projections / filters ---------------------------------------------
def p1_create_target(spark, sf_dir):
    return R.create_target(S.loans(spark, sf_dir)).select("id", "loan_status", T)


def p2_drop_policy_columns(spark, sf_dir):
    return R.drop_present(_lt(spark, sf_dir),
                          R.LEAKAGE_COLUMNS + R.HIGH_CARDINALITY_COLUMNS + R.LOW_VARIANCE_COLUMNS)


def p3_drop_sparse(spark, sf_dir):
    return R.drop_sparse(_lt(spark, sf_dir), 50.0)


def p4_select_features(spark, sf_dir):
    return R.select_features(_cleaned(spark, sf_dir), S.FINAL_FEATURES, T)


def p5_title_grouped(spark, sf_dir):
    return _lt(spark, sf_dir).select("id", R.group_text("title").alias("title_grouped"))


def p6_list_status_codes(spark, sf_dir):
    return _lt(spark, sf_dir).select("id", R.normalize_code("initial_list_status").alias("initial_list_status"))


def p7_keep_present(spark, sf_dir):
    df = _lt(spark, sf_dir).withColumn("initial_list_status", R.normalize_code("initial_list_status"))
    return R.keep_present(df, "initial_list_status").select("id", "initial_list_status")


def p8_emp_length_years(spark, sf_dir):
    return _lt(spark, sf_dir).select("id", R.map_values("emp_length", R.EMP_LENGTH_YEARS).alias("emp_length_int"))


def p9_home_ownership_levels(spark, sf_dir):
    return _lt(spark, sf_dir).select("id", R.keep_levels("home_ownership", R.HOME_OWNERSHIP_LEVELS)
                                     .alias("home_ownership"))


def p10_verification_labels(spark, sf_dir):
    labels = {"Verified": "Income verified", "Source Verified": "Source verified",
              "Not Verified": "Not verified"}
    return _lt(spark, sf_dir).select("id", R.map_values("verification_status", labels).alias("verification_label"))


def p11_cast_double(spark, sf_dir):
    return R.cast_to_double(_lt(spark, sf_dir).select("id", "inq_last_6mths", "emp_length"),
                            ["inq_last_6mths", "emp_length"])


def p12_numeric_text(spark, sf_dir):
    return R.fix_numeric_types(_lt(spark, sf_dir).select("id", "annual_inc", "revol_util"),
                               ["annual_inc", "revol_util"])


def p13_coerce_int(spark, sf_dir):
    return _lt(spark, sf_dir).select("id", R.coerce_int("inq_last_6mths").alias("inq_last_6mths"))


def p14_credit_age_months(spark, sf_dir):
    return _lt(spark, sf_dir).select(
        "id", R.months_between_text("issue_d", "earliest_cr_line").alias("credit_age_months"))


def p15_range_nulling(spark, sf_dir):
    return _lt(spark, sf_dir).select(
        "id", R.null_outside("dti", *S.DTI_RANGE).alias("dti"),
        R.null_outside("tot_hi_cred_lim", None, S.CREDIT_LIMIT_MAX).alias("tot_hi_cred_lim"))


def p21_display_text(spark, sf_dir):
    """Amounts with thousands separators, as the report tables show them."""
    df = _lt(spark, sf_dir)
    return df.select("id", labels.thousands("tot_hi_cred_lim").alias("credit_limit_text"),
                     labels.thousands("total_bc_limit", 0).alias("bc_limit_text"))


def t3_pair_list_status_plan(spark, sf_dir):
    """A 2x2 pair, which takes the continuity correction."""
    df = _lt(spark, sf_dir).select(R.normalize_code("initial_list_status").alias("initial_list_status"), "pymnt_plan")
    return AS.pair_association(df, "initial_list_status", "pymnt_plan")


def p16_dropna(spark, sf_dir):
    return _curated(spark, sf_dir).dropna(subset=S.NUMERIC_FEATURES).select("id", T)


def p17_fillna_zero(spark, sf_dir):
    cols = ["dti", "avg_cur_bal", "bc_open_to_buy", "inq_last_6mths"]
    return _curated(spark, sf_dir).select("id", *cols).fillna(0, subset=cols)


def p18_class_filter(spark, sf_dir):
    return R.keep_class(_curated(spark, sf_dir), T, 1).select("id", "int_rate")


def p19_level_share(spark, sf_dir):
    df = _curated(spark, sf_dir)
    counts = df.groupBy("purpose").agg(F.count(F.lit(1)).alias("n"))
    return R.with_share(counts, df).withColumn("pct", F.round("pct", 6))


# --- A: aggregations -------------------------------------------------------
def a1_class_distribution(spark, sf_dir):
    return A.class_distribution(_any_lt(spark, sf_dir), T)


def a2_null_report(spark, sf_dir):
    return A.null_report(_any_lt(spark, sf_dir))


def a3_string_missing(spark, sf_dir):
    return A.string_missing_report(_any_lt(spark, sf_dir))


def a4_numeric_missing(spark, sf_dir):
    return A.numeric_missing_report(_cleaned(spark, sf_dir), exclude=(T,))


def a6_cardinality(spark, sf_dir):
    return A.cardinality(_any_lt(spark, sf_dir), CARDINALITY_COLUMNS)


def a7_top_emp_title(spark, sf_dir):
    return A.top_levels(_any_lt(spark, sf_dir), "emp_title", 20)


def a7_top_inq_last_6mths(spark, sf_dir):
    return A.top_levels(_any_lt(spark, sf_dir), "inq_last_6mths", 20)


def a7_top_initial_list_status(spark, sf_dir):
    return A.top_levels(_any_lt(spark, sf_dir), "initial_list_status", 5)


def a7_top_emp_length(spark, sf_dir):
    return A.top_levels(_any_lt(spark, sf_dir), "emp_length", 12)


def a7_home_ownership_levels(spark, sf_dir):
    return A.top_levels(_cleaned(spark, sf_dir), "home_ownership")


def a8_modal_concentration(spark, sf_dir):
    df = _any_lt(spark, sf_dir).withColumn("title_grouped", R.group_text("title"))
    return A.modal_concentration(df, CONCENTRATION_COLUMNS)


def a9_categorical_audit(spark, sf_dir):
    return A.categorical_audit(_reduced(spark, sf_dir), STRING_AUDIT_DESCRIPTIONS)


def a10_crosstab_grade_sub_grade(spark, sf_dir):
    return A.crosstab_long(_any_lt(spark, sf_dir), "grade", "sub_grade")


def a10_crosstab_verification_wide(spark, sf_dir):
    return A.crosstab_wide(_curated(spark, sf_dir), "verification_status", T, [0, 1])


def a11_row_percent_verification(spark, sf_dir):
    return A.row_percent(A.crosstab_long(_shared_curated(spark, sf_dir), "verification_status", T),
                         "verification_status")


def a12_default_rate_by_sub_grade(spark, sf_dir):
    return A.level_default_rate(_curated(spark, sf_dir), "sub_grade", T)


def a15_confusion_scorecard(spark, sf_dir):
    df = _curated(spark, sf_dir).withColumn(
        "prediction", (F.col("int_rate") >= SCORECARD_CUTOFF).cast("double"))
    return A.confusion(df, T, "prediction")


def a15_confusion_long(spark, sf_dir):
    df = _curated(spark, sf_dir).withColumn(
        "prediction", (F.col("int_rate") >= SCORECARD_CUTOFF).cast("double"))
    return A.confusion_long(df, T, "prediction")


def a16_class_weights(spark, sf_dir):
    return A.class_weights(_curated(spark, sf_dir), T)


# --- T: rank statistics ----------------------------------------------------
def t9_numeric_ranking(spark, sf_dir):
    top = RK.numeric_ranking(_cleaned(spark, sf_dir), RANKED_NUMERIC, T, top=20)
    return (A.numbered(top, [F.abs("kendall_tau").desc(), F.col("variable")], "rank")
             .withColumn("rank", F.col("rank").cast("long")))


def t1_chi_square(spark, sf_dir):
    return AS.chi_square_table(_shared_curated(spark, sf_dir), S.CATEGORICAL_FEATURES, T)


def t1b_chi_square_null_level(spark, sf_dir):
    return AS.chi_square_table(_shared_lt(spark, sf_dir), None, T, nulls="level")


def t3_pair_grade_sub_grade(spark, sf_dir):
    return AS.pair_association(_shared_lt(spark, sf_dir), "grade", "sub_grade")


def t3_pair_purpose_title(spark, sf_dir):
    df = _shared_lt(spark, sf_dir).withColumn("title_grouped", R.group_text("title"))
    return AS.pair_association(df, "purpose", "title_grouped")


def t17_categorical_report(spark, sf_dir):
    return AS.categorical_association(_shared_curated(spark, sf_dir), T, S.CATEGORICAL_FEATURES)


def a14_numeric_audit(spark, sf_dir):
    return D.numeric_audit(_shared_curated(spark, sf_dir), S.NUMERIC_FEATURES)


def o1_outliers_dti(spark, sf_dir):
    return D.robust_outliers(_shared_lt(spark, sf_dir), "dti", 3.5, 10)


def o1_outliers_credit_limit(spark, sf_dir):
    return D.robust_outliers(_shared_lt(spark, sf_dir), "tot_hi_cred_lim", 3.5, 10)


def o2_hampel_bands(spark, sf_dir):
    return D.hampel_bands(_lt(spark, sf_dir), HAMPEL_COLUMNS)


def t16_contrast_stats(spark, sf_dir):
    return D.contrast_stats(_shared_curated(spark, sf_dir), S.NUMERIC_FEATURES, T).drop("z_mwu")


def t16_robust_contrast(spark, sf_dir):
    return D.robust_contrast(_shared_curated(spark, sf_dir), S.NUMERIC_FEATURES, T)


def t14_mann_whitney(spark, sf_dir):
    return RK.mann_whitney(_shared_curated(spark, sf_dir), S.NUMERIC_FEATURES, T)


def h2_box_stats(spark, sf_dir):
    return D.box_stats(_shared_curated(spark, sf_dir), BOX_COLUMNS, T)


def t7_shape(spark, sf_dir):
    return D.shape(_cleaned(spark, sf_dir), SHAPE_COLUMNS)


def t10_ks_normal(spark, sf_dir):
    ks = RK.ks_normal(_cleaned(spark, sf_dir), SHAPE_COLUMNS)
    return ks.select("variable", "N", F.round("ks_normal", 6).alias("ks_normal"))


def t12_normality_report(spark, sf_dir):
    return D.normality_report(_cleaned(spark, sf_dir), SHAPE_COLUMNS)


def t11_shapiro_francia(spark, sf_dir):
    return D.shapiro_francia(_cleaned(spark, sf_dir), SHAPE_COLUMNS).drop("sf_z")


def t12_normality_full(spark, sf_dir):
    return D.normality_report_full(_cleaned(spark, sf_dir), SHAPE_COLUMNS)


def t4_holm_mann_whitney(spark, sf_dir):
    """Holm over the Mann–Whitney p-values of the numeric features, with the
    significance stars, p text and effect band (T4, P20, P21)."""
    st = RK.separation_stats(RK.separation_sums(RK.value_counts(_shared_curated(spark, sf_dir), S.NUMERIC_FEATURES, T)))
    p = special.norm_two_sided(F.col("z_mwu"))
    out = AS.holm(st.select("variable", "rosenthal_r", p.alias("p_value")))
    # the tail's size where the rounded p shows only zeros
    size = F.round(-F.log10(F.when(F.col("p_value") > 0, F.col("p_value"))), 3)
    return out.select("variable", F.round("p_value", 6).alias("p_value"), F.round("p_holm", 6).alias("p_holm"),
                      size.alias("neg_log10_p"),
                      labels.stars("p_holm").alias("significance"), labels.p_text("p_holm").alias("p_text"),
                      F.round("rosenthal_r", 6).alias("rosenthal_r"),
                      labels.effect_band("rosenthal_r").alias("effect"))


def h1_histogram_int_rate(spark, sf_dir):
    return D.histogram(_shared_curated(spark, sf_dir), "int_rate", 30)


def h3_missing_patterns(spark, sf_dir):
    return D.missing_patterns(_any_lt(spark, sf_dir), PATTERN_COLUMNS)


def h4_ols_fico(spark, sf_dir):
    return D.ols_line(_cleaned(spark, sf_dir), "fico_range_high", "fico_range_low")


def h4_ols_balances(spark, sf_dir):
    return D.ols_line(_cleaned(spark, sf_dir), "avg_cur_bal", "tot_hi_cred_lim")


def h4_binned_scatter(spark, sf_dir):
    return D.binned_scatter(_cleaned(spark, sf_dir), "fico_range_low", "int_rate", 20.0, 1.0)


def t18_roc_int_rate(spark, sf_dir):
    return RK.roc_curve(_shared_curated(spark, sf_dir), "int_rate", T)


def e3_auc_int_rate(spark, sf_dir):
    return RK.auc(_shared_curated(spark, sf_dir), "int_rate", T)


# --- correlation -----------------------------------------------------------
def t5_spearman_matrix(spark, sf_dir):
    return CO.spearman_matrix(_cleaned(spark, sf_dir), S.RANKING_FEATURES)


def t6_prune_correlated(spark, sf_dir):
    return CO.prune_correlated(_cleaned(spark, sf_dir), S.RANKING_FEATURES, T, 0.85)


# --- sampling and splits -----------------------------------------------------
def r1_sample_fraction(spark, sf_dir):
    return SA.sample_fraction(_lt(spark, sf_dir), 0.005, 42, key="id").select("id", T)


def r2_sample_size(spark, sf_dir):
    return SA.sample_size(_lt(spark, sf_dir), 500, 42, key="id").select("id", "int_rate")


def r3_stratified_split(spark, sf_dir):
    return SA.stratified_split(_curated(spark, sf_dir), T, 0.8, 42).select("id", T, "split")


def r3_exact_split(spark, sf_dir):
    return SA.stratified_split(_shared_curated(spark, sf_dir), T, 0.8, 42, exact=True).select("id", T, "split")


def r4_folds(spark, sf_dir):
    return SA.assign_folds(_curated(spark, sf_dir), 5, 42).select("id", T, "fold")


def r4_stratified_folds(spark, sf_dir):
    return SA.assign_folds(_shared_curated(spark, sf_dir), 5, 42, stratify=T).select("id", T, "fold")


def u1_class_wise_union(spark, sf_dir):
    return SA.class_wise_union(_curated(spark, sf_dir), T, train_frac=0.8, seed=42).select("id", T, "split")


def a13_split_audit(spark, sf_dir):
    return SA.split_audit(SA.stratified_split(_curated(spark, sf_dir), T, 0.8, 42), T)


# --- features ---------------------------------------------------------------
def _train_test(spark, sf_dir):
    return SA.split_frames(_shared_curated(spark, sf_dir), target=T, train_frac=0.8, seed=42)


def _encoded(spark, sf_dir, *cols):
    """(training rows, all rows) with ``id`` and ``cols`` only: the split takes
    the id alone."""
    df = S.shared_columns(spark, sf_dir, ["id", *cols])
    return SA.split_frames(df, target=T, train_frac=0.8, seed=42)[0], df


def f1_ordinal_index(spark, sf_dir):
    train, df = _encoded(spark, sf_dir, "sub_grade")
    out = FE.ordinal_index(train, df, "sub_grade")
    return out.select("id", "sub_grade", "sub_grade_idx")


def f1b_ordinal_unseen_minus_one(spark, sf_dir):
    """Level A1 is left out of the training rows, so that the table has a level
    the encoder has not seen."""
    train, df = _encoded(spark, sf_dir, "sub_grade")
    train = train.filter(F.col("sub_grade") != "A1")
    out = FE.ordinal_index(train, df, "sub_grade", unseen_as_minus_one=True)
    return out.select("id", "sub_grade", "sub_grade_idx")


def f2_nominal_index(spark, sf_dir):
    train, df = _encoded(spark, sf_dir, "purpose", "addr_state")
    model = FE.nominal_indexer(["purpose", "addr_state"]).fit(train)
    return model.transform(df).select("id", "purpose_idx", "addr_state_idx")


def f3_one_hot(spark, sf_dir):
    cols = ["home_ownership", "verification_status"]
    train, df = _encoded(spark, sf_dir, *cols)
    idx = FE.nominal_indexer(cols).fit(train)
    ohe = FE.one_hot(cols).fit(idx.transform(train))
    out = ohe.transform(idx.transform(df))
    return out.select("id", *[F.col(f"{c}_ohe").cast("string").alias(f"{c}_ohe") for c in cols])


def f5_feature_pipeline(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    numeric = S.NUMERIC_FEATURES
    model = FE.encoding_pipeline(numeric).fit(M.prepare(train, numeric))
    out = model.transform(M.prepare(test, numeric))
    return out.select("id", T, F.col("features").cast("string").alias("features"))


def f5_feature_rows(spark, sf_dir):
    """The vectors of :func:`f5_feature_pipeline` as (id, slot, value) rows
    (F4, F5, J2)."""
    train, test = _train_test(spark, sf_dir)
    numeric = S.NUMERIC_FEATURES
    model = FE.encoding_pipeline(numeric).fit(M.prepare(train, numeric))
    return FE.vector_rows(model.transform(M.prepare(test, numeric))).withColumn("value", F.round("value", 6))


def f6_median_impute(spark, sf_dir):
    train, _ = _train_test(spark, sf_dir)
    cols = ["dti", "avg_cur_bal", "bc_open_to_buy", "inq_last_6mths"]
    med = FE.fit_medians(train, cols)
    return FE.impute(_shared_curated(spark, sf_dir).select("id", *cols), med).select(
        "id", *[F.round(c, 6).alias(c) for c in cols])


# --- models and evaluation -----------------------------------------------------
MODEL_NUMERIC = S.NUMERIC_FEATURES
FINAL_FOREST = {"num_trees": 100, "max_depth": 15, "max_bins": 64, "seed": 42}


def _scorecard(spark, sf_dir):
    df = _curated(spark, sf_dir)
    return df.withColumn("prediction", (F.col("int_rate") >= SCORECARD_CUTOFF).cast("int"))


def _forest(spark, sf_dir):
    def build():
        train, _ = _train_test(spark, sf_dir)
        return M.fit(train, MODEL_NUMERIC, T, **FINAL_FOREST)[0]
    return _memo(spark, sf_dir, "forest", build)


def _grid(spark, sf_dir):
    def build():
        train, _ = _train_test(spark, sf_dir)
        folded = SA.assign_folds(train, 5, 42)
        rows = M.grid_search(folded, MODEL_NUMERIC, trees=(10, 50, 100), depths=(5, 10, 15), k=5).collect()
        return [tuple(r) for r in rows]
    rows = _memo(spark, sf_dir, "grid", build)
    return spark.createDataFrame(rows, "max_depth int, n_estimators int, f1_score double")


def m1_random_forest_scores(spark, sf_dir):
    _, test = _train_test(spark, sf_dir)
    return M.score(_forest(spark, sf_dir), test, MODEL_NUMERIC).withColumn("p_default", F.round("p_default", 6))


def m3_grid_search(spark, sf_dir):
    return _grid(spark, sf_dir)


def a18_grid_pivot(spark, sf_dir):
    return M.grid_pivot(_grid(spark, sf_dir))


def a18_grid_best(spark, sf_dir):
    return M.best_config(_grid(spark, sf_dir))


RATE_CUTS, FICO_CUTS = [8.0, 10.0, 12.0, 14.0, 16.0], [665.0, 700.0, 735.0]


def _cutoffs(spark, sf_dir):
    return M.cutoff_grid(_curated(spark, sf_dir), T, ("int_rate", RATE_CUTS), ("fico_range_high", FICO_CUTS))


def a18_cutoff_pivot(spark, sf_dir):
    """F1 of a two-score rule over a grid of cut-offs, one column per FICO cut-off."""
    return M.grid_pivot(_cutoffs(spark, sf_dir), "int_rate", "fico_range_high", FICO_CUTS)


def a18_cutoff_best(spark, sf_dir):
    return M.best_config(_cutoffs(spark, sf_dir), "int_rate", "fico_range_high")


def e1_metrics_scorecard(spark, sf_dir):
    return M.metrics_from_confusion(A.confusion(_scorecard(spark, sf_dir), T, "prediction"))


def e2_weighted_metrics_scorecard(spark, sf_dir):
    return M.weighted_metrics(A.confusion(_scorecard(spark, sf_dir), T, "prediction"))


def e3_model_evaluation(spark, sf_dir):
    _, test = _train_test(spark, sf_dir)
    return M.evaluate(M.score(_forest(spark, sf_dir), test, MODEL_NUMERIC), T)


def e5_model_cases(spark, sf_dir):
    _, test = _train_test(spark, sf_dir)
    return M.pick_cases(M.score(_forest(spark, sf_dir), test, MODEL_NUMERIC), "id", T)


def x1_explain_cases(spark, sf_dir):
    """Local weights for the first false negative and true negative of
    the forest on the test split (the study's two explained cases)."""
    train, test = _train_test(spark, sf_dir)
    model = _forest(spark, sf_dir)
    picked = e5_model_cases(spark, sf_dir).select("id")
    cases = M.prepare(test, MODEL_NUMERIC).join(F.broadcast(picked), "id")
    out = X.explain(model, M.prepare(train, MODEL_NUMERIC), cases, MODEL_NUMERIC, "id", n_samples=5000, top=8,
                    categorical=S.CATEGORICAL_FEATURES)
    return out.withColumn("weight", F.round("weight", 6)).withColumn("intercept", F.round("intercept", 6))


def e4_run_comparison(spark, sf_dir):
    """Two cut-off rules side by side: metrics from one aggregate, and the AUC
    of the score behind each rule."""
    df = _shared_curated(spark, sf_dir)
    runs = {"rate_cutoff": F.col("int_rate") >= SCORECARD_CUTOFF, "fico_cutoff": F.col("fico_range_high") <= 700}
    sep = RK.separation_stats(RK.separation_sums(RK.value_counts(df, ["int_rate", "fico_range_high"], T)))
    up = F.when(F.col("variable") == "int_rate", F.col("auc")).otherwise(1 - F.col("auc"))
    name = F.when(F.col("variable") == "int_rate", "rate_cutoff").otherwise("fico_cutoff")
    aucs = sep.select(F.lit("auc").alias("metric"), name.alias("run"), F.round(up, 6).alias("value"))
    return M.compare_runs(M.run_metrics(df, T, runs).unionByName(aucs), list(runs))


def e4_model_runs(spark, sf_dir):
    """Two forests of different size: metrics, AUC, seconds and speed-up."""
    train, test = _train_test(spark, sf_dir)
    runs = {"small": {"num_trees": 5, "max_depth": 5}, "large": {"num_trees": 20, "max_depth": 8}}
    return M.compare_fits(train, test, MODEL_NUMERIC, T, runs)


def e5_case_selection(spark, sf_dir):
    return M.pick_cases(_scorecard(spark, sf_dir), "id", T)


QUERIES = {name: fn for name, fn in dict(globals()).items()
           if callable(fn) and name[:1] in "spatoheflmrxuw" and name[1:2].isdigit()}
