"""The study's data preparation as one lazy plan.

``loans_with_target`` is the raw table after the target rule (P1);
``cleaned_loans`` applies every recode the study decides on, and
``curated_loans`` projects the final feature set (P4/S4).  All steps are
column expressions, so Catalyst collapses them into a single projection
and filter on top of the join that builds ``loans``; the only data-driven
decision (the > 50 % NULL drop, P3) is taken from one aggregate row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recode as R
from ..sources.loans import raw_loans
from ..sources.shared import SHARED

TARGET = "default"

# The curated feature set.
CATEGORICAL_FEATURES = ["addr_state", "sub_grade", "purpose", "home_ownership",
                        "verification_status", "initial_list_status"]
NUMERIC_FEATURES = ["int_rate", "fico_range_high", "dti", "acc_open_past_24mths", "avg_cur_bal",
                    "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m", "percent_bc_gt_75",
                    "total_bc_limit", "num_actv_rev_tl", "inq_last_6mths"]
FINAL_FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES

# Numeric predictors examined before the redundancy pruning.
RANKING_FEATURES = ["int_rate", "fico_range_high", "fico_range_low", "dti", "acc_open_past_24mths",
                    "avg_cur_bal", "tot_hi_cred_lim", "bc_open_to_buy", "mort_acc",
                    "num_tl_op_past_12m", "percent_bc_gt_75", "total_bc_limit",
                    "num_actv_rev_tl", "num_rev_tl_bal_gt_0"]

# Text columns that hold numbers.
NUMERIC_TEXT_COLUMNS = ["annual_inc", "revol_util"]

# Range rules.
DTI_RANGE = (0, 100)
CREDIT_LIMIT_MAX = 4000000

# Redundant members of correlated pairs (decided by T6).
REDUNDANT_COLUMNS = ["fico_range_low", "tot_hi_cred_lim", "num_rev_tl_bal_gt_0"]


#: Driver tables that the loans are derived from.
SOURCES = ["orders", "customer", "nation", "lineitem"]


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_loans(spark, sf_dir)


def shared_loans(spark: SparkSession, sf_dir: str, write: bool = True) -> DataFrame:
    """The loans with target, from the table that reports share.  Without
    ``write``: from it if it is there, else as a lazy plan."""
    if write:
        return SHARED.get(spark, sf_dir, "loans", SOURCES, lambda: _with_target(raw_loans(spark, sf_dir, salted=True)))
    have = SHARED.peek(spark, sf_dir, "loans", SOURCES)
    return loans_with_target(spark, sf_dir) if have is None else have


def shared_recoded(spark: SparkSession, sf_dir: str, write: bool = True) -> DataFrame:
    """Every recoded column, from the shared table of that name (or lazily, as
    :func:`shared_loans`); the cleaned and the curated table are subsets."""
    if write:
        return SHARED.get(spark, sf_dir, "recoded", SOURCES, lambda: recode_loans(shared_loans(spark, sf_dir)))
    have = SHARED.peek(spark, sf_dir, "recoded", SOURCES)
    return recode_loans(shared_loans(spark, sf_dir, write=False)) if have is None else have


def shared_columns(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    """A few columns of the curated table, for reports of several passes that
    read no others: from the shared table if there is one, else written alone
    (joins that only other columns need are not run)."""
    have = SHARED.peek(spark, sf_dir, "recoded", SOURCES)
    if have is not None:
        return curated(have).select(*cols)

    def build() -> DataFrame:
        held = SHARED.peek(spark, sf_dir, "loans", SOURCES)
        rows = _with_target(raw_loans(spark, sf_dir, salted=True)) if held is None else held
        return curated(recode_loans(rows)).select(*cols)
    return SHARED.get(spark, sf_dir, "curated-" + "-".join(cols), SOURCES, build)


def loans_with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_target(loans(spark, sf_dir))


def _with_target(raw: DataFrame) -> DataFrame:
    return R.create_target(raw).drop("loan_status")


def recode_loans(df: DataFrame) -> DataFrame:
    """Every per-row rule of the study, in one projection + one filter."""
    df = R.fix_numeric_types(df, [c for c in NUMERIC_TEXT_COLUMNS if c in df.columns])
    df = R.drop_present(df, R.LEAKAGE_COLUMNS)
    df = df.withColumn("title_grouped", R.group_text("title")).drop("title")
    df = df.withColumns({
        "credit_age_months": R.months_between_text("issue_d", "earliest_cr_line"),
        "inq_last_6mths": R.coerce_int("inq_last_6mths"),
        "initial_list_status": R.normalize_code("initial_list_status"),
        "emp_length_int": R.map_values("emp_length", R.EMP_LENGTH_YEARS),
        "home_ownership": R.keep_levels("home_ownership", R.HOME_OWNERSHIP_LEVELS),
        "dti": R.null_outside("dti", *DTI_RANGE),
        "tot_hi_cred_lim": R.null_outside("tot_hi_cred_lim", None, CREDIT_LIMIT_MAX),
    }).drop("issue_d", "earliest_cr_line", "emp_length")
    return R.keep_present(df, "initial_list_status")


def sparse_columns(spark: SparkSession, sf_dir: str) -> list[str]:
    """P3's decision, from one aggregate pass over the raw table."""
    df = shared_loans(spark, sf_dir)
    kept = set(R.drop_sparse(df, 50.0).columns)
    return [c for c in df.columns if c not in kept]


def cleaned_loans(spark: SparkSession, sf_dir: str, sparse: list[str] | None = None) -> DataFrame:
    """Recoded table with ``id`` and every surviving column; columns that are
    NULL in more than half of the rows go (P3).  Reads the shared table."""
    sparse = sparse_columns(spark, sf_dir) if sparse is None else sparse
    return R.drop_present(shared_recoded(spark, sf_dir), sparse)


def curated_loans(spark: SparkSession, sf_dir: str, keep_id: bool = True) -> DataFrame:
    """P4/S4 projection: final features + target (+ ``id`` as the row key), as
    one lazy plan from the driver tables."""
    return curated(recode_loans(loans_with_target(spark, sf_dir)), keep_id)


def curated(recoded: DataFrame, keep_id: bool = True) -> DataFrame:
    return recoded.select(*FINAL_FEATURES, TARGET, *(["id"] if keep_id else []))
