"""Row-level cleaning and recoding.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
column expressions, so a chain of them collapses into one projection and
one filter inside whole-stage codegen.  No operator triggers a job except
:func:`drop_sparse`, whose decision needs the null shares (one aggregate
row, bounded by the number of columns).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Loan outcomes kept by the study and the bad one.
GOOD_STATUS = "Fully Paid"
BAD_STATUS = "Charged Off"

# Columns the study drops, by policy.
LEAKAGE_COLUMNS = [
    "recoveries", "collection_recovery_fee",
    "total_pymnt", "total_pymnt_inv", "total_rec_prncp",
    "total_rec_int", "total_rec_late_fee", "last_pymnt_amnt",
    "last_pymnt_d", "next_pymnt_d",
    "out_prncp", "out_prncp_inv",
    "last_fico_range_high", "last_fico_range_low", "last_credit_pull_d",
]
HIGH_CARDINALITY_COLUMNS = ["id", "zip_code", "emp_title"]
LOW_VARIANCE_COLUMNS = [
    "pymnt_plan", "hardship_flag", "policy_code",
    "acc_now_delinq", "disbursement_method", "collections_12_mths_ex_med",
    "application_type", "debt_settlement_flag", "pub_rec",
    "delinq_2yrs", "term", "title_grouped", "grade", "url",
]

# Free-text grouping of loan titles (first match wins).
TITLE_RULES = [("%debt consolidation%", "Debt Consolidation"),
               ("%credit card%", "Credit Card Refinancing")]
TITLE_OTHER = "Other"

# List-status codes.
LIST_STATUS_CODES = {"w": "Whole", "f": "Fractional"}

# Employment tenure labels -> years.
EMP_LENGTH_YEARS = {
    "10+ years": 10, "9 years": 9, "8 years": 8, "7 years": 7, "6 years": 6,
    "5 years": 5, "4 years": 4, "3 years": 3, "2 years": 2, "1 year": 1,
    "< 1 year": 0,
}

# Home ownership levels kept as they are.
HOME_OWNERSHIP_LEVELS = ["MORTGAGE", "RENT", "OWN"]
OTHER_LEVEL = "OTHER"

# Characters stripped from numeric text.
NUMERIC_NOISE = "[%$, ]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# P1 ------------------------------------------------------------------------
def create_target(df: DataFrame, status_col: str = "loan_status", target: str = "default",
                  good: str = GOOD_STATUS, bad: str = BAD_STATUS) -> DataFrame:
    """Keep the two final outcomes; ``target`` = 1 for the bad one."""
    return (df.filter(F.col(status_col).isin(good, bad))
              .withColumn(target, F.when(F.col(status_col) == bad, 1).otherwise(0)))


# P2 ------------------------------------------------------------------------
def drop_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist; absent names are ignored."""
    present = set(df.columns)
    return df.drop(*[c for c in cols if c in present])


# P3 ------------------------------------------------------------------------
def null_shares(df: DataFrame) -> dict[str, float]:
    """Share (%) of NULLs per column, from one aggregate over the table."""
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    n = row["__n"] or 0
    return {c: (row[c] / n * 100.0 if n else 0.0) for c in df.columns}


def drop_sparse(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Drop columns whose NULL share is strictly above ``threshold`` %."""
    shares = null_shares(df)
    return df.drop(*[c for c, s in shares.items() if s > threshold])


# P4 ------------------------------------------------------------------------
def select_features(df: DataFrame, features: list[str], target: str = "default") -> DataFrame:
    return df.select(*features, target)


# P5 ------------------------------------------------------------------------
def group_text(col, rules=TITLE_RULES, other: str = TITLE_OTHER) -> Column:
    """``lower(col) LIKE pattern`` rules, first match wins, else ``other``."""
    low = F.lower(_c(col))
    expr = None
    for pattern, label in rules:
        expr = F.when(low.like(pattern), label) if expr is None else expr.when(low.like(pattern), label)
    return expr.otherwise(other)


# P6 ------------------------------------------------------------------------
def normalize_code(col, codes: Mapping[str, str] = LIST_STATUS_CODES) -> Column:
    """``lower(trim(col))`` looked up in ``codes``; anything else is NULL."""
    key = F.lower(F.trim(_c(col)))
    expr = None
    for code, label in codes.items():
        expr = F.when(key == code, label) if expr is None else expr.when(key == code, label)
    return expr


# P7 / P18 ------------------------------------------------------------------
def keep_present(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def keep_class(df: DataFrame, target: str, value) -> DataFrame:
    return df.filter(F.col(target) == value)


# P8 / P10 ------------------------------------------------------------------
def map_values(col, mapping: Mapping) -> Column:
    """Dictionary recode as a literal map lookup; unmapped or NULL -> NULL."""
    lit_map = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(lit_map, _c(col))


# P9 ------------------------------------------------------------------------
def keep_levels(col, levels, other: str = OTHER_LEVEL) -> Column:
    """Listed levels stay; every other value, NULL included, becomes ``other``."""
    c = _c(col)
    return F.when(c.isin(*levels), c).otherwise(other)


# P11 -----------------------------------------------------------------------
def cast_to_double(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Bulk cast in one projection; unparsable text becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


# P12 -----------------------------------------------------------------------
def clean_numeric_text(col, to: str = "double") -> Column:
    """Strip %, currency, thousands marks and blanks, then cast."""
    return F.regexp_replace(F.trim(_c(col)).cast("string"), NUMERIC_NOISE, "").try_cast(to)


def fix_numeric_types(df: DataFrame, cols: Iterable[str], to: str = "double") -> DataFrame:
    return df.withColumns({c: clean_numeric_text(c, to) for c in cols})


# P13 -----------------------------------------------------------------------
def coerce_int(col) -> Column:
    """Coercive cast to int: garbage becomes NULL (ANSI-safe)."""
    return _c(col).try_cast("int")


# P14 -----------------------------------------------------------------------
def months_between_text(later, earlier, fmt: str = "MMM-yyyy") -> Column:
    """Whole months between two month-year texts; unparsable -> NULL."""
    return F.months_between(F.try_to_date(_c(later), fmt),
                            F.try_to_date(_c(earlier), fmt)).cast("int")


# P15 -----------------------------------------------------------------------
def null_outside(col, lo=None, hi=None) -> Column:
    """NULL when the value is below ``lo`` or above ``hi``."""
    c = _c(col)
    out = F.lit(False)
    if lo is not None:
        out = out | (c < lo)
    if hi is not None:
        out = out | (c > hi)
    return F.when(out, F.lit(None)).otherwise(c)


# P19 -----------------------------------------------------------------------
def with_share(counts: DataFrame, base: DataFrame, count_col: str = "n", out: str = "pct") -> DataFrame:
    """``count / total * 100`` where the total is the row count of ``base``.

    The total is a scalar subquery: Spark runs it once and inlines the value,
    no join and no single-partition window.
    """
    total = base.select(F.count(F.lit(1))).scalar()
    return counts.withColumn(out, F.col(count_col) / total * 100)
