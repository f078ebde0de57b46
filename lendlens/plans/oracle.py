"""DuckDB oracle SQL, one string per query id of :mod:`.catalog`."""

from __future__ import annotations

from .oracle_base import with_cleaned, with_curated, with_loans
from . import sqlgen as G
from .sqlgen import SEPARATION, numeric_vc, per_column, q, unpivot

LT_COLUMNS = ["id", "addr_state", "grade", "sub_grade", "int_rate", "fico_range_low", "fico_range_high",
              "dti", "tot_hi_cred_lim", "avg_cur_bal", "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m",
              "acc_open_past_24mths", "percent_bc_gt_75", "total_bc_limit", "num_actv_rev_tl",
              "num_rev_tl_bal_gt_0", "inq_last_6mths", "initial_list_status", "emp_length", "home_ownership",
              "verification_status", "purpose", "title", "emp_title", "annual_inc", "revol_util", "issue_d",
              "earliest_cr_line", "mths_since_last_record", "pymnt_plan", "policy_code", "recoveries", "default"]
LT_STRINGS = ["addr_state", "grade", "sub_grade", "inq_last_6mths", "initial_list_status", "emp_length",
              "home_ownership", "verification_status", "purpose", "title", "emp_title", "annual_inc",
              "revol_util", "issue_d", "earliest_cr_line", "pymnt_plan"]
CLEANED_NUMERIC = ["id", "int_rate", "fico_range_low", "fico_range_high", "dti", "tot_hi_cred_lim",
                   "avg_cur_bal", "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m", "acc_open_past_24mths",
                   "percent_bc_gt_75", "total_bc_limit", "num_actv_rev_tl", "num_rev_tl_bal_gt_0",
                   "inq_last_6mths", "annual_inc", "revol_util", "policy_code",
                   "credit_age_months", "emp_length_int"]
CLEANED_DOUBLES = {"int_rate", "fico_range_low", "fico_range_high", "dti", "tot_hi_cred_lim", "avg_cur_bal",
                   "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m", "acc_open_past_24mths",
                   "percent_bc_gt_75", "total_bc_limit", "num_actv_rev_tl", "num_rev_tl_bal_gt_0",
                   "annual_inc", "revol_util"}
FEATURES = ["addr_state", "sub_grade", "purpose", "home_ownership", "verification_status",
            "initial_list_status", "int_rate", "fico_range_high", "dti", "acc_open_past_24mths", "avg_cur_bal",
            "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m", "percent_bc_gt_75", "total_bc_limit",
            "num_actv_rev_tl", "inq_last_6mths"]
NUMERIC_FEATURES = FEATURES[6:]
CONCENTRATION = ["emp_length", "policy_code", "initial_list_status", "inq_last_6mths", "earliest_cr_line",
                 "addr_state", "grade", "purpose", "title_grouped", "pymnt_plan", "issue_d",
                 "verification_status", "home_ownership", "sub_grade"]
AUDIT = {
    "addr_state": "State of residence given by the applicant.",
    "purpose": "Declared use of the loan.",
    "initial_list_status": "Initial listing status of the loan (whole or fractional).",
    "sub_grade": "Detailed risk grade assigned by the lender.",
    "home_ownership": "Home ownership status (own, mortgage, rent, other).",
    "verification_status": "Whether the income was verified.",
}
RANKED = ["int_rate", "fico_range_high", "fico_range_low", "dti", "acc_open_past_24mths", "avg_cur_bal",
          "tot_hi_cred_lim", "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m", "percent_bc_gt_75",
          "total_bc_limit", "num_actv_rev_tl", "num_rev_tl_bal_gt_0", "inq_last_6mths", "annual_inc",
          "revol_util", "credit_age_months", "emp_length_int"]

TITLE_CASE = ("CASE WHEN lower(title) LIKE '%debt consolidation%' THEN 'Debt Consolidation' "
              "WHEN lower(title) LIKE '%credit card%' THEN 'Credit Card Refinancing' ELSE 'Other' END")


def _top(col: str, k: int | None, table: str = "lt") -> str:
    lim = f" LIMIT {k}" if k else ""
    return (f"SELECT {col}, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM {table}) * 100, 6) AS pct "
            f"FROM {table} GROUP BY {col} ORDER BY n DESC, {col} ASC NULLS FIRST{lim}")


def _missing(table: str, cols: list[str], pred: str, keep_zero: bool) -> str:
    body = per_column(cols, "SELECT '{name}' AS variable, COUNT_IF(" + pred + ") AS n_missing, "
                      "COUNT(*) AS n_all FROM " + table)
    where = "" if keep_zero else " WHERE n_missing > 0"
    return (f"SELECT variable, n_missing, ROUND(n_missing / n_all * 100, 6) AS pct_missing "
            f"FROM ({body}){where}")


SQL = {
    "s3_loans": with_loans("SELECT * FROM loans"),
    "s3_curated": with_curated("SELECT * FROM curated"),
    "s2_csv_roundtrip": with_loans("SELECT * FROM loans"),
    "s4_curated_sink": with_curated("SELECT * FROM curated"),
    "s5_preview": with_cleaned(
        "SELECT id, int_rate, annual_inc, revol_util, inq_last_6mths FROM lt ORDER BY id LIMIT 12"),

    "p1_create_target": with_loans("""
SELECT id, loan_status, CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS "default"
FROM loans WHERE loan_status IN ('Fully Paid', 'Charged Off')"""),
    "p2_drop_policy_columns": with_cleaned(
        "SELECT * EXCLUDE (recoveries, id, emp_title, pymnt_plan, policy_code, grade) FROM lt"),
    "p3_drop_sparse": with_cleaned("SELECT * EXCLUDE (mths_since_last_record) FROM lt"),
    "p4_select_features": with_cleaned(f"SELECT {', '.join(FEATURES)}, \"default\" FROM cleaned"),
    "p5_title_grouped": with_cleaned(f"SELECT id, {TITLE_CASE} AS title_grouped FROM lt"),
    "p6_list_status_codes": with_cleaned("""
SELECT id, CASE lower(trim(initial_list_status)) WHEN 'w' THEN 'Whole' WHEN 'f' THEN 'Fractional' END
  AS initial_list_status FROM lt"""),
    "p7_keep_present": with_cleaned("SELECT id, initial_list_status FROM cleaned"),
    "p8_emp_length_years": with_cleaned("""
SELECT id, CASE emp_length WHEN '10+ years' THEN 10 WHEN '9 years' THEN 9 WHEN '8 years' THEN 8
  WHEN '7 years' THEN 7 WHEN '6 years' THEN 6 WHEN '5 years' THEN 5 WHEN '4 years' THEN 4
  WHEN '3 years' THEN 3 WHEN '2 years' THEN 2 WHEN '1 year' THEN 1 WHEN '< 1 year' THEN 0 END
  AS emp_length_int FROM lt"""),
    "p9_home_ownership_levels": with_cleaned("""
SELECT id, CASE WHEN home_ownership IN ('MORTGAGE', 'RENT', 'OWN') THEN home_ownership ELSE 'OTHER' END
  AS home_ownership FROM lt"""),
    "p10_verification_labels": with_cleaned("""
SELECT id, CASE verification_status WHEN 'Verified' THEN 'Income verified'
  WHEN 'Source Verified' THEN 'Source verified' WHEN 'Not Verified' THEN 'Not verified' END
  AS verification_label FROM lt"""),
    "p11_cast_double": with_cleaned("""
SELECT id, TRY_CAST(inq_last_6mths AS DOUBLE) AS inq_last_6mths, TRY_CAST(emp_length AS DOUBLE) AS emp_length
FROM lt"""),
    "p12_numeric_text": with_cleaned("""
SELECT id, TRY_CAST(regexp_replace(trim(annual_inc), '[%$, ]', '', 'g') AS DOUBLE) AS annual_inc,
  TRY_CAST(regexp_replace(trim(revol_util), '[%$, ]', '', 'g') AS DOUBLE) AS revol_util FROM lt"""),
    "p13_coerce_int": with_cleaned("SELECT id, TRY_CAST(inq_last_6mths AS INTEGER) AS inq_last_6mths FROM lt"),
    "p14_credit_age_months": with_cleaned("""
SELECT id, CAST(datediff('month', try_strptime(earliest_cr_line, '%b-%Y'), try_strptime(issue_d, '%b-%Y'))
  AS INTEGER) AS credit_age_months FROM lt"""),
    "p15_range_nulling": with_cleaned("""
SELECT id, CASE WHEN dti < 0 OR dti > 100 THEN NULL ELSE dti END AS dti,
  CASE WHEN tot_hi_cred_lim > 4000000 THEN NULL ELSE tot_hi_cred_lim END AS tot_hi_cred_lim FROM lt"""),
    "p21_display_text": with_cleaned("""
SELECT id, format('{:,.2f}', tot_hi_cred_lim) AS credit_limit_text, format('{:,.0f}', total_bc_limit) AS bc_limit_text FROM lt"""),
    "p16_dropna": with_curated("SELECT id, \"default\" FROM curated WHERE "
                               + " AND ".join(f"{c} IS NOT NULL" for c in NUMERIC_FEATURES)),
    "p17_fillna_zero": with_curated("""
SELECT id, COALESCE(dti, 0) AS dti, COALESCE(avg_cur_bal, 0) AS avg_cur_bal,
  COALESCE(bc_open_to_buy, 0) AS bc_open_to_buy, COALESCE(inq_last_6mths, 0) AS inq_last_6mths FROM curated"""),
    "p18_class_filter": with_curated("SELECT id, int_rate FROM curated WHERE \"default\" = 1"),
    "p19_level_share": with_curated(
        "SELECT purpose, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM curated) * 100, 6) AS pct "
        "FROM curated GROUP BY purpose"),

    "a1_class_distribution": with_cleaned(
        "SELECT \"default\", COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM lt) * 100, 6) AS pct "
        "FROM lt GROUP BY \"default\""),
    "a2_null_report": with_cleaned(_missing("lt", LT_COLUMNS, "{c} IS NULL", True)),
    "a3_string_missing": with_cleaned(
        _missing("lt", LT_STRINGS, "{c} IS NULL OR {c} = '' OR {c} = 'NaN'", False)),
    "a4_numeric_missing": with_cleaned(
        _missing("cleaned", [c for c in CLEANED_NUMERIC if c not in CLEANED_DOUBLES], "{c} IS NULL", False)
        + " UNION ALL "
        + _missing("cleaned", [c for c in CLEANED_NUMERIC if c in CLEANED_DOUBLES],
                   "{c} IS NULL OR isnan({c})", False)),
    "a6_cardinality": with_cleaned(
        "SELECT variable, n_distinct, ROUND(n_distinct / n_all * 100, 6) AS cr_pct FROM ("
        + per_column(["id", "emp_title", "title"],
                     "SELECT '{name}' AS variable, COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) AS n_all FROM lt")
        + ")"),
    "a7_top_emp_title": with_cleaned(_top("emp_title", 20)),
    "a7_top_inq_last_6mths": with_cleaned(_top("inq_last_6mths", 20)),
    "a7_top_initial_list_status": with_cleaned(_top("initial_list_status", 5)),
    "a7_top_emp_length": with_cleaned(_top("emp_length", 12)),
    "a7_home_ownership_levels": with_cleaned(_top("home_ownership", None, "cleaned")),
    "a8_modal_concentration": with_cleaned(f""", p AS (SELECT *, {TITLE_CASE} AS title_grouped FROM lt
), u AS ({unpivot('p', CONCENTRATION, 'VARCHAR')}
), vc AS (SELECT variable, value, COUNT(*) AS n FROM u GROUP BY variable, value
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY n DESC, value ASC NULLS FIRST) AS rn,
         COUNT(value) OVER (PARTITION BY variable) AS n_classes, SUM(n) OVER (PARTITION BY variable) AS n_rows
  FROM vc)
SELECT variable, n_classes, value AS dominant_class, n AS max_count, ROUND(n / n_rows * 100, 6) AS max_pct
FROM ranked WHERE rn = 1"""),
    "a9_categorical_audit": with_cleaned(
        "SELECT * FROM ("
        + per_column(list(AUDIT), "SELECT '{name}' AS variable, "
                     "CAST(COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_levels, "
                     "ROUND(COUNT_IF({c} IS NULL OR {c} = '') / COUNT(*) * 100, 6) AS null_pct FROM cleaned")
        + ") a JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in AUDIT.items())
        + ") d(variable, description) USING (variable)"),
    "a10_crosstab_grade_sub_grade": with_cleaned(
        "SELECT grade, sub_grade, COUNT(*) AS n FROM lt GROUP BY grade, sub_grade"),
    "a10_crosstab_verification_wide": with_curated(
        "SELECT verification_status, COUNT_IF(\"default\" = 0) AS n_0, COUNT_IF(\"default\" = 1) AS n_1 "
        "FROM curated GROUP BY verification_status"),
    "a11_row_percent_verification": with_curated("""
SELECT verification_status, "default", COUNT(*) AS n,
  ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY verification_status) * 100, 6) AS row_pct
FROM curated GROUP BY verification_status, "default\""""),
    "a12_default_rate_by_sub_grade": with_curated("""
SELECT sub_grade, COUNT(*) AS n, ROUND(AVG(CAST("default" AS DOUBLE)), 6) AS default_rate
FROM curated GROUP BY sub_grade"""),
    "a15_confusion_scorecard": with_curated("""
, p AS (SELECT "default" AS y, CASE WHEN int_rate >= 12.0 THEN 1 ELSE 0 END AS pr FROM curated)
SELECT COUNT_IF(y = 0 AND pr = 0) AS tn, COUNT_IF(y = 0 AND pr = 1) AS fp,
       COUNT_IF(y = 1 AND pr = 0) AS fn, COUNT_IF(y = 1 AND pr = 1) AS tp FROM p"""),
    "a15_confusion_long": with_curated("""
SELECT "default", CASE WHEN int_rate >= 12.0 THEN 1 ELSE 0 END AS prediction, COUNT(*) AS n
FROM curated GROUP BY ALL"""),
    "a16_class_weights": with_curated("""
SELECT "default", COUNT(*) AS n,
  ROUND(CAST((SELECT COUNT(*) FROM curated) AS DOUBLE) / (COUNT(*) * 2.0), 6) AS weight
FROM curated GROUP BY "default\""""),

    "t9_numeric_ranking": with_cleaned(numeric_vc("cleaned", RANKED) + SEPARATION + """
, r AS (SELECT variable, ROUND(rho, 6) AS spearman_rho, ROUND(tau, 6) AS kendall_tau, ROUND(ks, 6) AS ks_stat
        FROM sep)
SELECT *, ROW_NUMBER() OVER (ORDER BY ABS(kendall_tau) DESC, variable) AS rank
FROM r ORDER BY ABS(kendall_tau) DESC, variable LIMIT 20"""),
}


# ---------------------------------------------------------------------------
# association, distribution, rank statistics
# ---------------------------------------------------------------------------

CATS = FEATURES[:6]
HAMPEL = ["int_rate", "dti", "avg_cur_bal", "tot_hi_cred_lim", "total_bc_limit"]
BOX = ["int_rate", "dti", "fico_range_high", "avg_cur_bal"]
SHAPE = ["policy_code", "int_rate", "fico_range_high", "fico_range_low", "dti", "acc_open_past_24mths", "avg_cur_bal",
         "tot_hi_cred_lim", "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m", "percent_bc_gt_75",
         "total_bc_limit", "num_actv_rev_tl", "num_rev_tl_bal_gt_0", "inq_last_6mths"]
PATTERN = ["dti", "avg_cur_bal", "bc_open_to_buy", "emp_length", "title", "home_ownership",
           "mths_since_last_record"]
HAMPEL_HALF = repr(3.0 * 1.4826)


def _chi_ctes(table: str, cols: list[str], drop_nulls: bool, min_levels: int) -> str:
    where = "WHERE value IS NOT NULL" if drop_nulls else ""
    return f""", u AS ({unpivot(table, cols, 'VARCHAR', '"default" AS y')}
), tc AS (SELECT variable, value, COUNT(*) AS n, SUM(y) AS n1 FROM u {where} GROUP BY variable, value
), tot AS (SELECT variable, SUM(n) AS tn, SUM(n1) AS tn1, COUNT(*) AS lv FROM tc GROUP BY variable
), cells AS (
  SELECT tc.*, tn, tn1, lv,
    (CASE WHEN tn1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn > tn1 THEN 1 ELSE 0 END) AS nc,
    n * tn1 / tn AS e1, n * (tn - tn1) / tn AS e0
  FROM tc JOIN tot USING (variable) WHERE lv >= {min_levels}
), terms AS (
  SELECT variable, tn, lv, nc,
    CASE WHEN e1 > 0 THEN POWER(CASE WHEN lv = 2 AND nc = 2 THEN GREATEST(ABS(n1 - e1) - 0.5, 0)
                                     ELSE ABS(n1 - e1) END, 2) / e1 ELSE 0 END
    + CASE WHEN e0 > 0 THEN POWER(CASE WHEN lv = 2 AND nc = 2 THEN GREATEST(ABS(n - n1 - e0) - 0.5, 0)
                                       ELSE ABS(n - n1 - e0) END, 2) / e0 ELSE 0 END AS t
  FROM cells
), s AS (SELECT variable, ANY_VALUE(tn) AS tn, ANY_VALUE(lv) AS lv, ANY_VALUE(nc) AS nc, SUM(t) AS chi2
         FROM terms GROUP BY variable)"""


def _chi_square(table: str, cols: list[str], drop_nulls: bool, min_levels: int) -> str:
    return _chi_ctes(table, cols, drop_nulls, min_levels) + """
SELECT variable, CAST(tn AS BIGINT) AS n, CAST(lv AS BIGINT) AS n_levels, CAST((lv - 1) * (nc - 1) AS BIGINT) AS dof,
  ROUND(chi2, 6) AS chi2,
  ROUND(CASE WHEN LEAST(lv, nc) > 1 THEN SQRT(chi2 / (tn * (LEAST(lv, nc) - 1))) ELSE 0 END, 6) AS cramers_v
FROM s"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _pair(table_sql: str, a: str, b: str) -> str:
    """Cell by cell over the full table, also the cells that never occur."""
    return f""", pr AS (SELECT {a} AS a, {b} AS b FROM {table_sql} WHERE {a} IS NOT NULL AND {b} IS NOT NULL
), cells AS (SELECT a, b, COUNT(*) AS o FROM pr GROUP BY a, b
), ra AS (SELECT a, SUM(o) AS ra FROM cells GROUP BY a
), cb AS (SELECT b, SUM(o) AS cb, COUNT(*) AS a_per_b FROM cells GROUP BY b
), sz AS (SELECT (SELECT COUNT(*) FROM pr) AS n, (SELECT COUNT(*) FROM ra) AS r, (SELECT COUNT(*) FROM cb) AS c
), dev AS (SELECT ABS(COALESCE(o, 0) - CAST(ra AS DOUBLE) * cb / n) AS d, CAST(ra AS DOUBLE) * cb / n AS e, n, r, c
           FROM ra CROSS JOIN cb CROSS JOIN sz LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b
), ag AS (SELECT ANY_VALUE(n) AS n, ANY_VALUE(r) AS r, ANY_VALUE(c) AS c,
    SUM(POWER(CASE WHEN r = 2 AND c = 2 THEN GREATEST(d - 0.5, 0) ELSE d END, 2) / e) AS chi2 FROM dev
), v AS (SELECT *, (r - 1) * (c - 1) AS dof, (SELECT MAX(a_per_b) = 1 FROM cb) AS nested,
         CASE WHEN LEAST(r, c) > 1 THEN SQRT(chi2 / (n * (LEAST(r, c) - 1))) ELSE 0 END AS cv FROM ag
) {G.critical_values('v')}
SELECT '{a} x {b}' AS variable, CAST(n AS BIGINT) AS n, ROUND(chi2, 6) AS chi2, CAST(v.dof AS BIGINT) AS dof,
  ROUND(crit.cv, 4) AS critical_value, ROUND(v.cv, 6) AS cramers_v, {G.effect('v.cv')} AS effect, nested,
  CASE WHEN v.cv >= 0.86 THEN 'redundant' ELSE 'distinct' END AS conclusion
FROM v LEFT JOIN crit ON crit.dof = v.dof"""


def _outliers(col: str) -> str:
    return f""", x AS (SELECT {col} AS v FROM lt WHERE {col} IS NOT NULL AND NOT isnan({col})
), m AS (SELECT quantile_cont(v, 0.5) AS med FROM x
), d AS (SELECT quantile_cont(ABS(v - med), 0.5) AS mad FROM x, m
), s AS (SELECT v, ROUND(0.6745 * (v - med) / mad, 6) AS mz FROM x, m, d WHERE mad > 0)
SELECT v AS {col}, mz AS modified_z, COUNT(*) AS frequency FROM s WHERE ABS(mz) > 3.5
GROUP BY v, mz ORDER BY ABS(mz) DESC, v LIMIT 10"""


def _erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * ABS({x})))"
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = repr(coef[-1])
    for c in reversed(coef[:-1]):
        poly = f"({poly} * {t} + {c!r})"
    ans = f"({t} * EXP(-ABS({x}) * ABS({x}) + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


SHAPE_CTES = f""", u AS ({unpivot('cleaned', SHAPE, 'DOUBLE')}
), x AS (SELECT * FROM u WHERE value IS NOT NULL AND NOT isnan(value)
), m AS (SELECT variable, COUNT(*) AS n, AVG(value) AS mu, NULLIF(STDDEV_SAMP(value), 0) AS sd FROM x GROUP BY variable
), c AS (SELECT variable, ANY_VALUE(n) AS n, NULLIF(AVG(POWER(value - mu, 2)), 0) AS m2, AVG(POWER(value - mu, 3)) AS m3,
                AVG(POWER(value - mu, 4)) AS m4 FROM x JOIN m USING (variable) GROUP BY variable
), k AS (SELECT variable, n, m3 / POWER(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM c
), sh AS (SELECT variable, n, ROUND(sk, 6) AS skewness, ROUND(ku, 6) AS kurtosis,
    ROUND(n / 6.0 * (sk * sk + ku * ku / 4), 3) AS jarque_bera,
    ROUND(EXP(-(n / 6.0 * (sk * sk + ku * ku / 4)) / 2), 6) AS jb_p FROM k
), vc AS (SELECT variable, value, COUNT(*) AS n FROM x GROUP BY variable, value
), cum AS (SELECT vc.*, m.n AS bn, mu, sd,
    SUM(vc.n) OVER (PARTITION BY variable ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
  FROM vc JOIN m USING (variable)
), ph AS (SELECT *, -((value - mu) / sd) / SQRT(2.0) AS xx FROM cum
), ph2 AS (SELECT *, 0.5 * {_erfc_sql('xx')} AS phi FROM ph
), kn AS (SELECT variable, ANY_VALUE(bn) AS n,
    MAX(CASE WHEN phi IS NOT NULL THEN GREATEST(cn / bn - phi, phi - (cn - n) / bn) END) AS ks FROM ph2 GROUP BY variable
), kl AS (SELECT variable, ks, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * ks AS lam FROM kn
), kp AS (SELECT variable, ks, CASE WHEN ks IS NULL THEN NULL WHEN lam < 0.2 THEN 1.0 ELSE GREATEST(0, LEAST(1,
    list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2 * j * j * lam * lam))))) END
    AS ks_p FROM kl)"""

SF_CTES = f"""
, sa AS (SELECT variable, value - mu AS v, n, bn, sd, bn + 0.25 AS den, (cn - n + 1 - 0.375) / (bn + 0.25) AS pm,
    (cn - n + 1 - 0.875) / (bn + 0.25) AS p1, (cn + 0.125) / (bn + 0.25) AS p2 FROM cum
), sb AS (SELECT *, {G.normal_quantile('pm')} AS q, {G.normal_quantile('p1')} AS z1, {G.normal_quantile('p2')} AS z2 FROM sa
), sc AS (SELECT *, exp(-z1 * z1 / 2) / sqrt(2 * pi()) AS f1, exp(-z2 * z2 / 2) / sqrt(2 * pi()) AS f2 FROM sb
), sg AS (SELECT variable, v, n, bn, CASE WHEN n = 1 THEN q ELSE den * (f1 - f2) END AS s1,
    CASE WHEN n = 1 THEN q * q ELSE den * ((p2 - z2 * f2) - (p1 - z1 * f1)) END AS s2, sd FROM sc
), se AS (SELECT variable, ANY_VALUE(bn) AS bn, ANY_VALUE(sd) AS sd, SUM(v * s1) - SUM(n * v) * SUM(s1) / ANY_VALUE(bn) AS cov,
    SUM(n * v * v) - SUM(n * v) * SUM(n * v) / ANY_VALUE(bn) AS vx, SUM(s2) - SUM(s1) * SUM(s1) / ANY_VALUE(bn) AS vm
  FROM sg GROUP BY variable
), sf AS (SELECT variable, bn, CASE WHEN sd IS NOT NULL THEN cov * cov / (vx * vm) END AS w FROM se)"""

CONTRAST = numeric_vc("curated", NUMERIC_FEATURES) + SEPARATION + """
, cv AS (SELECT variable, y AS cls, value FROM u WHERE value IS NOT NULL AND NOT isnan(value)
), cq AS (SELECT variable, cls, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                 quantile_cont(value, 0.75) AS q3 FROM cv GROUP BY variable, cls
), z AS (SELECT cv.variable, cv.cls, ABS(value - med) AS z FROM cv JOIN cq USING (variable, cls)
), per AS (SELECT variable, cls, COUNT(*) AS nc, SUM(z) AS sz, SUM(z * z) AS szz FROM z GROUP BY variable, cls
), gr AS (SELECT variable, SUM(nc) AS bn, SUM(sz) / SUM(nc) AS zbar, COUNT(*) AS k FROM per GROUP BY variable
), bf AS (SELECT variable,
    (ANY_VALUE(bn) - ANY_VALUE(k)) * SUM(nc * POWER(sz / nc - zbar, 2))
      / ((ANY_VALUE(k) - 1) * SUM(szz - sz * sz / nc)) AS bf_f,
    ANY_VALUE(k) - 1 AS bf_df1, ANY_VALUE(bn) - ANY_VALUE(k) AS bf_df2
  FROM per JOIN gr USING (variable) GROUP BY variable
), w AS (SELECT variable,
    MAX(CASE WHEN cls = 0 THEN med END) AS med0, MAX(CASE WHEN cls = 0 THEN q3 - q1 END) AS iqr0,
    MAX(CASE WHEN cls = 1 THEN med END) AS med1, MAX(CASE WHEN cls = 1 THEN q3 - q1 END) AS iqr1
  FROM cq GROUP BY variable)"""

SQL.update({
    "t1_chi_square": with_curated(_chi_square("curated", CATS, True, 2)),
    "t1b_chi_square_null_level": with_cleaned(_chi_square("lt", LT_STRINGS, False, 1)),
    "t3_pair_grade_sub_grade": _recursive(with_cleaned(_pair("lt", "grade", "sub_grade"))),
    "t3_pair_purpose_title": _recursive(with_cleaned(_pair(
        f"(SELECT purpose, {TITLE_CASE} AS title_grouped FROM lt)", "purpose", "title_grouped"))),
    "t3_pair_list_status_plan": _recursive(with_cleaned(_pair(
        "(SELECT CASE lower(trim(initial_list_status)) WHEN 'w' THEN 'Whole' WHEN 'f' THEN 'Fractional' END "
        "AS initial_list_status, pymnt_plan FROM lt)", "initial_list_status", "pymnt_plan"))),
    "t17_categorical_report": _recursive(with_curated(_chi_ctes("curated", CATS, True, 2) + """
, res AS (SELECT variable, CAST(tn AS BIGINT) AS n, (lv - 1) * (nc - 1) AS dof, chi2,
    CASE WHEN LEAST(lv, nc) > 1 THEN SQRT(chi2 / (tn * (LEAST(lv, nc) - 1))) ELSE 0 END AS v FROM s)"""
        + G.critical_values("res") + f"""
, pv AS (SELECT res.*, cv, {G.chi2_sf('chi2', 'res.dof')} AS p FROM res LEFT JOIN crit ON crit.dof = res.dof)"""
        + G.holm("pv") + f"""
SELECT variable, n, CAST(dof AS BIGINT) AS dof, ROUND(chi2, 6) AS chi2, ROUND(cv, 4) AS critical_value,
  ROUND(p, 6) AS p_value, ROUND(ph, 6) AS p_holm, {G.P_TEXT} AS p_text, {G.STARS} AS significance,
  ROUND(v, 6) AS cramers_v, {G.effect('v')} AS effect FROM adj""")),
    "a14_numeric_audit": with_curated(per_column(NUMERIC_FEATURES, """SELECT '{name}' AS variable,
  ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS sd, ROUND(MIN({c}), 6) AS min, ROUND(MAX({c}), 6) AS max,
  ROUND(quantile_cont({c}, 0.25), 6) AS q1, ROUND(quantile_cont({c}, 0.5), 6) AS median,
  ROUND(quantile_cont({c}, 0.75), 6) AS q3,
  ROUND(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr,
  ROUND(COUNT_IF({c} IS NULL) / COUNT(*) * 100, 6) AS null_pct FROM curated""")),
    "o1_outliers_dti": with_cleaned(_outliers("dti")),
    "o1_outliers_credit_limit": with_cleaned(_outliers("tot_hi_cred_lim")),
    "o2_hampel_bands": with_cleaned(per_column(HAMPEL, """SELECT '{name}' AS variable, ROUND(med, 6) AS median,
  ROUND(mad, 6) AS mad, ROUND(med - """ + HAMPEL_HALF + """ * mad, 6) AS lower,
  ROUND(med + """ + HAMPEL_HALF + """ * mad, 6) AS upper
FROM (SELECT med, quantile_cont(ABS(x - med), 0.5) AS mad
      FROM (SELECT {c} AS x FROM lt WHERE {c} IS NOT NULL AND NOT isnan({c})),
           (SELECT quantile_cont({c}, 0.5) AS med FROM lt WHERE NOT isnan({c})) GROUP BY med)""")),
    "t16_contrast_stats": with_curated(CONTRAST + """
SELECT variable, CAST(big_n0 AS BIGINT) AS n0, CAST(big_n1 AS BIGINT) AS n1,
  ROUND(med0, 6) AS median_0, ROUND(iqr0, 6) AS iqr_0, ROUND(med1, 6) AS median_1, ROUND(iqr1, 6) AS iqr_1,
  ROUND(bf_f, 6) AS bf_f, CAST(bf_df1 AS BIGINT) AS bf_df1, CAST(bf_df2 AS BIGINT) AS bf_df2,
  ROUND(u0, 6) AS u_stat,
  ROUND(ABS((u0 - big_n0 * big_n1 / 2.0) / SQRT(big_n0 * big_n1 * (big_n + 1) / 12.0)) / SQRT(big_n), 6)
    AS rosenthal_r
FROM sep JOIN bf USING (variable) JOIN w USING (variable) WHERE big_n1 >= 2 AND big_n0 >= 2"""),
    "t16_robust_contrast": with_curated(CONTRAST + f"""
, k AS (SELECT variable, ROUND(med0, 6) AS m0, ROUND(iqr0, 6) AS i0, ROUND(med1, 6) AS m1, ROUND(iqr1, 6) AS i1,
    ROUND(ABS((u0 - big_n0 * big_n1 / 2.0) / SQRT(big_n0 * big_n1 * (big_n + 1) / 12.0)) / SQRT(big_n), 6) AS r,
    {G.t_two_sided('sqrt(bf_f)', 'bf_df2')} AS bf_p, {G.two_sided(G.Z_MWU)} AS p
  FROM sep JOIN bf USING (variable) JOIN w USING (variable) WHERE big_n1 >= 2 AND big_n0 >= 2)""" + G.holm("k") + f"""
SELECT variable, format('{{:,.2f}} ({{:,.2f}})', m0, i0) AS median_iqr_0, format('{{:,.2f}} ({{:,.2f}})', m1, i1) AS median_iqr_1,
  CASE WHEN bf_p > 0.05 THEN 'yes' ELSE 'no' END AS homoscedastic, ROUND(p, 6) AS p_value, ROUND(ph, 6) AS p_holm,
  {G.P_TEXT} AS p_text, r AS rosenthal_r, {G.effect('r')} AS effect FROM adj"""),
    "t14_mann_whitney": with_curated(numeric_vc("curated", NUMERIC_FEATURES) + SEPARATION + """
SELECT variable, CAST(big_n AS BIGINT) AS "N", CAST(big_n1 AS BIGINT) AS "N1", ROUND(u0, 6) AS u_stat,
  ROUND(u1 / (big_n1 * big_n0), 6) AS auc,
  ROUND((u0 - big_n0 * big_n1 / 2.0) / SQRT(big_n0 * big_n1 * (big_n + 1) / 12.0), 6) AS z,
  ROUND(ABS((u0 - big_n0 * big_n1 / 2.0) / SQRT(big_n0 * big_n1 * (big_n + 1) / 12.0)) / SQRT(big_n), 6)
    AS rosenthal_r,
  ROUND(""" + G.two_sided(G.Z_MWU) + """, 6) AS p_value
FROM sep"""),
    "h2_box_stats": with_curated(f""", u AS ({unpivot('curated', BOX, 'DOUBLE', '"default" AS y')}
), cv AS (SELECT variable, y, value FROM u WHERE value IS NOT NULL AND NOT isnan(value)
), cq AS (SELECT variable, y, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                 quantile_cont(value, 0.75) AS q3 FROM cv GROUP BY variable, y)
SELECT variable, y AS "default", ROUND(ANY_VALUE(q1), 6) AS q1, ROUND(ANY_VALUE(med), 6) AS median,
  ROUND(ANY_VALUE(q3), 6) AS q3,
  ROUND(MIN(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) AS whisker_lo,
  ROUND(MAX(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_hi,
  COUNT_IF(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outside
FROM cv JOIN cq USING (variable, y) GROUP BY variable, y"""),
    "t7_shape": with_cleaned(SHAPE_CTES + """
SELECT variable, n, skewness, kurtosis, jarque_bera, jb_p FROM sh"""),
    "t10_ks_normal": with_cleaned(SHAPE_CTES + """
SELECT variable, n AS "N", ROUND(ks, 6) AS ks_normal FROM kn"""),
    "t12_normality_report": with_cleaned(SHAPE_CTES + """
SELECT variable, n, skewness, kurtosis, jarque_bera, jb_p, ROUND(ks, 6) AS ks_normal, ROUND(ks_p, 6) AS ks_p,
  CASE WHEN jb_p > 0.05 AND ks_p > 0.05 THEN 'yes' ELSE 'no' END AS normal FROM sh JOIN kp USING (variable)"""),
    "t11_shapiro_francia": with_cleaned(SHAPE_CTES + SF_CTES + """
SELECT variable, CAST(bn AS BIGINT) AS n_obs, ROUND(w, 6) AS sf_w FROM sf"""),
    "t12_normality_full": with_cleaned(SHAPE_CTES + SF_CTES + f"""
, sp AS (SELECT variable, ROUND(w, 6) AS sf_w, bn > 5000 AS sf_p_extrapolated,
    (ln(1 - w) - (-1.2725 + 1.0521 * (ln(ln(bn)) - ln(bn)))) / (1.0308 - 0.26758 * (ln(ln(bn)) + 2 / ln(bn))) AS z
  FROM sf)
SELECT variable, n, skewness, kurtosis, jarque_bera, jb_p, ROUND(ks, 6) AS ks_normal, ROUND(ks_p, 6) AS ks_p,
  CASE WHEN jb_p > 0.05 AND ks_p > 0.05 THEN 'yes' ELSE 'no' END AS normal,
  sf_w, ROUND({G.erfc('(z / sqrt(2.0))')} / 2, 6) AS sf_p, sf_p_extrapolated
FROM sh JOIN kp USING (variable) JOIN sp USING (variable)"""),
    "h1_histogram_int_rate": with_curated(""", x AS (SELECT int_rate AS v FROM curated WHERE int_rate IS NOT NULL
), mo AS (SELECT COUNT(*) AS bn, AVG(v) AS mu, STDDEV_SAMP(v) AS sd, MIN(v) AS mn, MAX(v) AS mx FROM x
), b AS (SELECT LEAST(CAST(FLOOR((v - mn) / ((mx - mn) / 30)) AS INTEGER) + 1, 30) AS bin, bn, mu, sd, mn, mx
         FROM x, mo
), h AS (SELECT bin, COUNT(*) AS n, ANY_VALUE(bn) AS bn, ANY_VALUE(mu) AS mu, ANY_VALUE(sd) AS sd,
                ANY_VALUE(mn) AS mn, ANY_VALUE(mx) AS mx FROM b GROUP BY bin)
SELECT bin, ROUND(mn + (bin - 1) * ((mx - mn) / 30), 6) AS bin_lo,
  ROUND(mn + (bin - 1) * ((mx - mn) / 30) + (mx - mn) / 30, 6) AS bin_hi, n,
  ROUND(n / (bn * ((mx - mn) / 30)), 6) AS density,
  ROUND(EXP(-0.5 * POWER((mn + (bin - 1) * ((mx - mn) / 30) + ((mx - mn) / 30) / 2 - mu) / sd, 2))
        / (sd * SQRT(2 * PI())), 6) AS normal_density
FROM h"""),
    "h3_missing_patterns": with_cleaned(
        "SELECT CONCAT(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in PATTERN)
        + ") AS pattern, COUNT(*) AS n FROM lt GROUP BY pattern"),
    "h4_ols_fico": with_cleaned("""
SELECT ROUND(regr_slope(fico_range_high, fico_range_low), 6) AS slope,
  ROUND(regr_intercept(fico_range_high, fico_range_low), 6) AS intercept,
  ROUND(corr(fico_range_low, fico_range_high), 6) AS pearson_r,
  CAST(regr_count(fico_range_high, fico_range_low) AS BIGINT) AS n FROM cleaned"""),
    "h4_ols_balances": with_cleaned("""
SELECT ROUND(regr_slope(avg_cur_bal, tot_hi_cred_lim), 6) AS slope,
  ROUND(regr_intercept(avg_cur_bal, tot_hi_cred_lim), 6) AS intercept,
  ROUND(corr(tot_hi_cred_lim, avg_cur_bal), 6) AS pearson_r,
  CAST(regr_count(avg_cur_bal, tot_hi_cred_lim) AS BIGINT) AS n FROM cleaned"""),
    "h4_binned_scatter": with_cleaned("""
SELECT FLOOR(fico_range_low / 20.0) * 20.0 AS fico_range_low_bin, FLOOR(int_rate / 1.0) * 1.0 AS int_rate_bin,
  COUNT(*) AS n FROM cleaned WHERE fico_range_low IS NOT NULL AND int_rate IS NOT NULL
GROUP BY fico_range_low_bin, int_rate_bin"""),
    "t18_roc_int_rate": with_curated(numeric_vc("curated", ["int_rate"]) + """
SELECT value AS threshold, ROUND(((tn - tn1) - (cn - cn1) + (n - n1)) / (tn - tn1), 6) AS fpr,
  ROUND((tn1 - cn1 + n1) / tn1, 6) AS tpr FROM cum"""),
    "e3_auc_int_rate": with_curated(numeric_vc("curated", ["int_rate"]) + SEPARATION + """
SELECT ROUND(u1 / (big_n1 * big_n0), 6) AS auc, CAST(big_n AS BIGINT) AS "N", CAST(big_n1 AS BIGINT) AS "N1"
FROM sep"""),
})


# ---------------------------------------------------------------------------
# sampling, features, evaluation, correlation
# ---------------------------------------------------------------------------

def _u(seed) -> str:
    return (f"(CAST(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|{seed}'), 1, 15)) AS BIGINT) AS DOUBLE)"
            f" / CAST(1152921504606846976 AS DOUBLE))")


def _h(seed) -> str:
    return f"CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|{seed}'), 1, 15)) AS BIGINT)"


SPLIT = f"CASE WHEN {_u(42)} < 0.8 THEN 'train' ELSE 'test' END"
TRAIN = f"(SELECT * FROM curated WHERE {_u(42)} < 0.8)"


def _ordinal(train: str) -> str:
    return f""", lab AS (
  SELECT sub_grade, CAST(ROW_NUMBER() OVER (ORDER BY sub_grade) - 1 AS DOUBLE) AS idx
  FROM (SELECT DISTINCT sub_grade FROM {train} WHERE sub_grade IS NOT NULL)
), nl AS (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM lab)"""


def _freq_index(col: str) -> str:
    return f"""lab_{col} AS (
  SELECT {col}, CAST(ROW_NUMBER() OVER (ORDER BY cnt DESC, {col} ASC) - 1 AS DOUBLE) AS idx
  FROM (SELECT {col}, COUNT(*) AS cnt FROM {TRAIN} WHERE {col} IS NOT NULL GROUP BY {col}))"""


def _confusion_metrics(pred: str) -> str:
    return f"""(SELECT tn, fp, fn, tp,
    ROUND(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0 END, 6) AS accuracy,
    ROUND(pr, 6) AS precision, ROUND(re, 6) AS recall,
    ROUND(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1_score
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, tn + fp + fn + tp AS n
        FROM (SELECT COUNT_IF(y = 0 AND pr = 0) AS tn, COUNT_IF(y = 0 AND pr = 1) AS fp,
                     COUNT_IF(y = 1 AND pr = 0) AS fn, COUNT_IF(y = 1 AND pr = 1) AS tp
              FROM (SELECT "default" AS y, CASE WHEN {pred} THEN 1 ELSE 0 END AS pr FROM curated))))"""


def _spearman_ctes(cols: list[str]) -> str:
    fill = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0) AS {c}" for c in cols)
    ranks = ", ".join(f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                      for c in cols)
    pairs = "\n  UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, ROUND(corr({a}, {b}), 6) AS rho FROM rk"
                                  for i, a in enumerate(cols) for b in cols[i + 1:])
    return f""", fz AS (SELECT {fill} FROM cleaned
), rk AS (SELECT {ranks} FROM fz
), sp AS ({pairs})"""


RANKING14 = ["int_rate", "fico_range_high", "fico_range_low", "dti", "acc_open_past_24mths", "avg_cur_bal",
             "tot_hi_cred_lim", "bc_open_to_buy", "mort_acc", "num_tl_op_past_12m", "percent_bc_gt_75",
             "total_bc_limit", "num_actv_rev_tl", "num_rev_tl_bal_gt_0"]
IMPUTED = ["dti", "avg_cur_bal", "bc_open_to_buy", "inq_last_6mths"]

SQL.update({
    "r1_sample_fraction": with_cleaned(f"SELECT id, \"default\" FROM lt WHERE {_u(42)} < 0.005"),
    "r2_sample_size": with_cleaned(f"SELECT id, int_rate FROM lt ORDER BY {_u(42)} LIMIT 500"),
    "r3_stratified_split": with_curated(f"SELECT id, \"default\", {SPLIT} AS split FROM curated"),
    "r3_exact_split": with_curated(f"""
SELECT id, "default", CASE WHEN rn <= ROUND(cnt * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT id, "default", ROW_NUMBER() OVER (PARTITION BY "default" ORDER BY {_h(42)}) AS rn,
             COUNT(*) OVER (PARTITION BY "default") AS cnt FROM curated)"""),
    "r4_folds": with_curated(f"SELECT id, \"default\", CAST(FLOOR({_u('42|fold')} * 5) AS INTEGER) AS fold FROM curated"),
    "r4_stratified_folds": with_curated(f"""
SELECT id, "default", CAST((ROW_NUMBER() OVER (PARTITION BY "default" ORDER BY {_h('42|fold')}, id) - 1) % 5 AS INTEGER) AS fold
FROM curated"""),
    "u1_class_wise_union": with_curated(f"SELECT id, \"default\", {SPLIT} AS split FROM curated"),
    "a13_split_audit": with_curated(f"""
SELECT COALESCE(split, 'all') AS split, COUNT(*) AS n, ROUND(AVG(CAST("default" AS DOUBLE)), 6) AS default_rate
FROM (SELECT *, {SPLIT} AS split FROM curated) GROUP BY ROLLUP (split)"""),
    "f1_ordinal_index": with_curated(_ordinal(TRAIN) + """
SELECT id, sub_grade, COALESCE(idx, (SELECT c FROM nl)) AS sub_grade_idx FROM curated LEFT JOIN lab USING (sub_grade)"""),
    "f1b_ordinal_unseen_minus_one": with_curated(
        _ordinal(f"(SELECT * FROM {TRAIN} WHERE sub_grade <> 'A1')") + """
SELECT id, sub_grade, COALESCE(idx, -1.0) AS sub_grade_idx FROM curated LEFT JOIN lab USING (sub_grade)"""),
    "f2_nominal_index": with_curated(f""", {_freq_index('purpose')}, {_freq_index('addr_state')},
nlp AS (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM lab_purpose),
nla AS (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM lab_addr_state)
SELECT id, COALESCE(lab_purpose.idx, (SELECT c FROM nlp)) AS purpose_idx,
  COALESCE(lab_addr_state.idx, (SELECT c FROM nla)) AS addr_state_idx
FROM curated LEFT JOIN lab_purpose USING (purpose) LEFT JOIN lab_addr_state USING (addr_state)"""),
    "f6_median_impute": with_curated(
        ", med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in IMPUTED) + f" FROM {TRAIN})\n"
        "SELECT id, " + ", ".join(f"ROUND(COALESCE(CAST({c} AS DOUBLE), m_{c}), 6) AS {c}" for c in IMPUTED)
        + " FROM curated, med"),
    "e1_metrics_scorecard": with_curated("SELECT * FROM " + _confusion_metrics("int_rate >= 12.0")),
    "e2_weighted_metrics_scorecard": with_curated("""
, c AS (SELECT COUNT_IF(y = 0 AND pr = 0) AS tn, COUNT_IF(y = 0 AND pr = 1) AS fp,
               COUNT_IF(y = 1 AND pr = 0) AS fn, COUNT_IF(y = 1 AND pr = 1) AS tp
        FROM (SELECT "default" AS y, CASE WHEN int_rate >= 12.0 THEN 1 ELSE 0 END AS pr FROM curated)
), p AS (SELECT *, tn + fp + fn + tp AS n, tn + fp AS s0, fn + tp AS s1,
    CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1,
    CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1
  FROM c
), f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
                   CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1 FROM p)
SELECT ROUND((tp + tn) / n, 6) AS accuracy, ROUND((s0 * p0 + s1 * p1) / n, 6) AS weighted_precision,
  ROUND((s0 * r0 + s1 * r1) / n, 6) AS weighted_recall, ROUND((s0 * f0 + s1 * f1) / n, 6) AS weighted_f1 FROM f"""),
    "e4_run_comparison": with_curated(numeric_vc("curated", ["int_rate", "fico_range_high"]) + SEPARATION + f"""
, a AS (SELECT * FROM {_confusion_metrics('int_rate >= 12.0')}),
b AS (SELECT * FROM {_confusion_metrics('fico_range_high <= 700')})
SELECT 'accuracy' AS metric, a.accuracy AS rate_cutoff, b.accuracy AS fico_cutoff FROM a, b
UNION ALL SELECT 'precision', a.precision, b.precision FROM a, b
UNION ALL SELECT 'recall', a.recall, b.recall FROM a, b
UNION ALL SELECT 'f1_score', a.f1_score, b.f1_score FROM a, b
UNION ALL SELECT 'auc', ROUND(MAX(CASE WHEN variable = 'int_rate' THEN u1 / (big_n1 * big_n0) END), 6),
  ROUND(1 - MAX(CASE WHEN variable = 'fico_range_high' THEN u1 / (big_n1 * big_n0) END), 6) FROM sep"""),
    "e5_case_selection": with_curated("""
SELECT case_type, MIN(id) AS id FROM (
  SELECT id, CASE WHEN "default" = 1 AND pr = 0 THEN 'false_negative'
                  WHEN "default" = 0 AND pr = 0 THEN 'true_negative' END AS case_type
  FROM (SELECT *, CASE WHEN int_rate >= 12.0 THEN 1 ELSE 0 END AS pr FROM curated))
WHERE case_type IS NOT NULL GROUP BY case_type"""),
    "t5_spearman_matrix": with_cleaned(_spearman_ctes(RANKING14) + "\nSELECT * FROM sp"),
    "t6_prune_correlated": with_cleaned(_spearman_ctes(RANKING14) + numeric_vc("cleaned", RANKING14) + SEPARATION
                                        + """
, k AS (SELECT variable, ROUND(ks, 6) AS ks FROM sep)
SELECT var_a, var_b, rho, ka.ks AS ks_a, kb.ks AS ks_b,
  CASE WHEN ka.ks < kb.ks THEN var_a ELSE var_b END AS "drop"
FROM sp JOIN k ka ON ka.variable = var_a JOIN k kb ON kb.variable = var_b WHERE ABS(rho) > 0.85"""),
})


SQL.update({
    "t4_holm_mann_whitney": with_curated(numeric_vc("curated", NUMERIC_FEATURES) + SEPARATION + f"""
, zz AS (SELECT variable, {G.Z_MWU} AS z,
    ABS((u0 - big_n0 * big_n1 / 2.0) / SQRT(big_n0 * big_n1 * (big_n + 1) / 12.0)) / SQRT(big_n) AS r FROM sep
), pv AS (SELECT variable, r, {G.two_sided('z')} AS p FROM zz)""" + G.holm("pv") + f"""
SELECT variable, ROUND(p, 6) AS p_value, ROUND(ph, 6) AS p_holm,
  CASE WHEN p > 0 THEN ROUND(-log10(p), 3) END AS neg_log10_p,
  {G.STARS} AS significance, {G.P_TEXT} AS p_text, ROUND(r, 6) AS rosenthal_r, {G.effect('r')} AS effect
FROM adj"""),
})


def _levels(col: str) -> str:
    """Number of training levels of a nominal column."""
    return f"(SELECT COUNT(*) FROM lab_{col})"


def _one_hot_text(col: str) -> str:
    slot = f"COALESCE(lab_{col}.idx, {_levels(col)})"
    return (f"CONCAT('(', CAST({_levels(col)} + 2 AS VARCHAR), ',[', CAST(CAST({slot} AS BIGINT) AS VARCHAR), '],[1.0])')"
            f" AS {col}_ohe")


NOMINAL = ["addr_state", "purpose", "home_ownership", "verification_status"]


def _feature_rows() -> str:
    """Slots in the order of the assembler: numeric columns, ordinal indices,
    then a block of levels + 2 per nominal column."""
    parts, offset = [], str(len(NUMERIC_FEATURES) + 2)
    for i, c in enumerate(NUMERIC_FEATURES):
        parts.append(f"SELECT id, {i} AS slot, COALESCE(CAST({c} AS DOUBLE), m_{c}) AS value FROM te, med")
    for i, (c, lab) in enumerate([("sub_grade", "lab"), ("initial_list_status", "lst")]):
        parts.append(f"SELECT id, {len(NUMERIC_FEATURES) + i}, COALESCE(idx, (SELECT COUNT(*) FROM {lab})) FROM te LEFT JOIN {lab} USING ({c})")
    for c in NOMINAL:
        parts.append(f"SELECT id, {offset} + COALESCE(CAST(idx AS BIGINT), {_levels(c)}), 1.0 FROM te LEFT JOIN lab_{c} USING ({c})")
        offset += f" + {_levels(c)} + 2"
    return "\n  UNION ALL ".join(parts)


_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN ROUND(2.0 * tp / (2 * tp + fp + fn), 6) ELSE 0 END"
_CELLS = f""", cells AS (SELECT r, c, {_F1} AS f1 FROM (
  SELECT r, c, COUNT_IF(y = 1 AND p) AS tp, COUNT_IF(y = 0 AND p) AS fp, COUNT_IF(y = 1 AND NOT p) AS fn
  FROM (SELECT r, c, "default" AS y, int_rate >= r OR fico_range_high <= c AS p
        FROM curated, (SELECT UNNEST([8.0, 10.0, 12.0, 14.0, 16.0])::DOUBLE AS r), (SELECT UNNEST([665.0, 700.0, 735.0])::DOUBLE AS c))
  GROUP BY r, c))"""

SQL.update({
    "f3_one_hot": with_curated(f""", {_freq_index('home_ownership')}, {_freq_index('verification_status')}
SELECT id, {_one_hot_text('home_ownership')}, {_one_hot_text('verification_status')}
FROM curated LEFT JOIN lab_home_ownership USING (home_ownership) LEFT JOIN lab_verification_status USING (verification_status)"""),
    "f5_feature_rows": with_curated(_ordinal(TRAIN) + f""", {', '.join(_freq_index(c) for c in NOMINAL)},
lst AS (SELECT initial_list_status, CAST(ROW_NUMBER() OVER (ORDER BY initial_list_status) - 1 AS DOUBLE) AS idx
        FROM (SELECT DISTINCT initial_list_status FROM {TRAIN} WHERE initial_list_status IS NOT NULL)),
med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in NUMERIC_FEATURES)} FROM {TRAIN}),
te AS (SELECT * FROM (SELECT *, {SPLIT} AS split FROM curated) WHERE split = 'test'),
v AS ({_feature_rows()})
SELECT id, CAST(slot AS INTEGER) AS slot, ROUND(CAST(value AS DOUBLE), 6) AS value FROM v WHERE value <> 0"""),
    "a18_cutoff_pivot": with_curated(_CELLS + """
SELECT r AS int_rate, MAX(CASE WHEN c = 665 THEN f1 END) AS "665.0", MAX(CASE WHEN c = 700 THEN f1 END) AS "700.0",
  MAX(CASE WHEN c = 735 THEN f1 END) AS "735.0" FROM cells GROUP BY r"""),
    "a18_cutoff_best": with_curated(_CELLS + """
SELECT r AS int_rate, c AS fico_range_high, f1 AS f1_score FROM cells ORDER BY f1 DESC, r, c LIMIT 1"""),
})
