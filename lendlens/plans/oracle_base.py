"""DuckDB SQL for the derived tables the oracle queries start from.

``LOANS`` mirrors :func:`lendlens.sources.loans.raw_loans`, ``CURATED``
mirrors :func:`lendlens.plans.study.curated_loans`.  They are written as plain
SQL, so a query that agrees with its oracle agrees on the data preparation as
well.
"""

LOANS = """
li AS (
  SELECT l_orderkey, COUNT(*) AS n_items FROM lineitem GROUP BY l_orderkey
), lb AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderdate, o_orderpriority, o_totalprice,
         c_mktsegment, c_acctbal, n_name, COALESCE(n_items, 0) AS n_items,
         CASE WHEN o_orderstatus = 'O' THEN 'Current'
              WHEN o_orderstatus = 'P' AND o_orderkey % 5 < 2 THEN 'Charged Off'
              ELSE 'Fully Paid' END AS loan_status,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 < 2 THEN 1 ELSE 0 END AS bad
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN li ON o_orderkey = l_orderkey
), lg AS (
  SELECT *, (k * 1103515245 + 12345) % 2147483647 AS u,
    CAST(((k * 1103515245 + 12345) % 2147483647 * 16807) % 2147483647 % 28 + 7 * bad AS INTEGER) AS g FROM lb
), loans AS (
SELECT k AS id, loan_status, n_name AS addr_state,
  SUBSTR('ABCDEFG', CAST(FLOOR(g / 5) AS INTEGER) + 1, 1) AS grade,
  CONCAT(SUBSTR('ABCDEFG', CAST(FLOOR(g / 5) AS INTEGER) + 1, 1), CAST(g % 5 + 1 AS VARCHAR)) AS sub_grade,
  CAST(600 + g * 55 + (k % 4) * 10 AS DOUBLE) / 100 AS int_rate,
  CAST(660 + 5 * ((k * 31 + c) % 38) - 15 * bad AS DOUBLE) AS fico_range_low,
  CAST(665 + 5 * ((k * 31 + c) % 38) - 15 * bad AS DOUBLE) AS fico_range_high,
  CASE WHEN k % 503 = 0 THEN CAST(999 AS DOUBLE) WHEN k % 19 = 0 THEN NULL
       ELSE CAST((k * 13) % 4000 + 300 * bad AS DOUBLE) / 100 END AS dti,
  CASE WHEN k % 701 = 0 THEN CAST(9999999 AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END AS tot_hi_cred_lim,
  CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) / (8 + k % 5) END AS avg_cur_bal,
  CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) END AS bc_open_to_buy,
  CAST(c % 9 AS DOUBLE) AS mort_acc,
  CAST(n_items AS DOUBLE) AS num_tl_op_past_12m,
  CAST(n_items + u % 4 AS DOUBLE) AS acc_open_past_24mths,
  CAST((u % 5) * 25 AS DOUBLE) AS percent_bc_gt_75,
  CAST((k * 97) % 60000 AS DOUBLE) AS total_bc_limit,
  CAST(k % 23 AS DOUBLE) AS num_actv_rev_tl,
  CAST(k % 23 + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS num_rev_tl_bal_gt_0,
  CASE WHEN k % 401 = 0 THEN 'Feb-1999' WHEN k % 397 = 0 THEN '690' ELSE CAST(k % 7 AS VARCHAR) END AS inq_last_6mths,
  CASE WHEN k % 97 = 0 THEN '72' WHEN k % 3 = 0 THEN ' F ' ELSE 'w' END AS initial_list_status,
  CASE k % 13 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 10 THEN '10+ years' WHEN 11 THEN NULL
       WHEN 12 THEN '10+ years' ELSE CONCAT(CAST(k % 13 AS VARCHAR), ' years') END AS emp_length,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'MORTGAGE' WHEN 'AUTOMOBILE' THEN 'RENT' WHEN 'FURNITURE' THEN 'OWN'
       WHEN 'MACHINERY' THEN 'ANY' ELSE NULL END AS home_ownership,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Verified'
       WHEN o_orderpriority = '5-LOW' THEN 'Not Verified' ELSE 'Source Verified' END AS verification_status,
  CONCAT('purpose_', CAST(k % 14 AS VARCHAR)) AS purpose,
  CASE WHEN k % 14 < 6 THEN 'Debt Consolidation' WHEN k % 14 < 9 THEN 'Credit card refinancing'
       WHEN k % 14 = 13 THEN NULL ELSE CONCAT('note ', CAST(k AS VARCHAR)) END AS title,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'NaN' ELSE CONCAT('job ', CAST(k % 300 AS VARCHAR)) END AS emp_title,
  CONCAT('$', CAST(30 + k % 90 AS VARCHAR), ',', CAST(100 + k % 800 AS VARCHAR)) AS annual_inc,
  CONCAT(CAST(k % 100 AS VARCHAR), '.5%') AS revol_util,
  strftime(o_orderdate, '%b-%Y') AS issue_d,
  CASE WHEN k % 211 = 0 THEN 'f'
       ELSE CONCAT(SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((c % 12) * 3 + 1 AS INTEGER), 3),
                   '-', CAST(1975 + c % 19 AS VARCHAR)) END AS earliest_cr_line,
  CASE WHEN k % 5 = 0 THEN CAST(k % 120 AS DOUBLE) ELSE NULL END AS mths_since_last_record,
  CASE WHEN k % 100 = 0 THEN 'y' ELSE 'n' END AS pymnt_plan,
  1 AS policy_code,
  CAST(bad * (k % 1000) AS DOUBLE) AS recoveries
FROM lg
)"""

# Target derivation + the study's cleaning steps, as the oracle writes them.
CLEANED = LOANS + """, lt AS (
  SELECT * EXCLUDE (loan_status), CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS "default"
  FROM loans WHERE loan_status IN ('Fully Paid', 'Charged Off')
), cleaned AS (
  SELECT id, addr_state, grade, sub_grade, int_rate, fico_range_low, fico_range_high,
    CASE WHEN dti < 0 OR dti > 100 THEN NULL ELSE dti END AS dti,
    CASE WHEN tot_hi_cred_lim > 4000000 THEN NULL ELSE tot_hi_cred_lim END AS tot_hi_cred_lim,
    avg_cur_bal, bc_open_to_buy, mort_acc, num_tl_op_past_12m, acc_open_past_24mths,
    percent_bc_gt_75, total_bc_limit, num_actv_rev_tl, num_rev_tl_bal_gt_0,
    TRY_CAST(inq_last_6mths AS INTEGER) AS inq_last_6mths,
    CASE lower(trim(initial_list_status)) WHEN 'w' THEN 'Whole' WHEN 'f' THEN 'Fractional' END
      AS initial_list_status,
    CASE WHEN home_ownership IN ('MORTGAGE', 'RENT', 'OWN') THEN home_ownership ELSE 'OTHER' END
      AS home_ownership,
    verification_status, purpose, emp_title,
    TRY_CAST(regexp_replace(trim(annual_inc), '[%$, ]', '', 'g') AS DOUBLE) AS annual_inc,
    TRY_CAST(regexp_replace(trim(revol_util), '[%$, ]', '', 'g') AS DOUBLE) AS revol_util,
    mths_since_last_record, pymnt_plan, policy_code, "default",
    CASE WHEN lower(title) LIKE '%debt consolidation%' THEN 'Debt Consolidation'
         WHEN lower(title) LIKE '%credit card%' THEN 'Credit Card Refinancing' ELSE 'Other' END
      AS title_grouped,
    CAST(datediff('month', try_strptime(earliest_cr_line, '%b-%Y'), try_strptime(issue_d, '%b-%Y'))
         AS INTEGER) AS credit_age_months,
    CASE emp_length WHEN '10+ years' THEN 10 WHEN '9 years' THEN 9 WHEN '8 years' THEN 8
         WHEN '7 years' THEN 7 WHEN '6 years' THEN 6 WHEN '5 years' THEN 5 WHEN '4 years' THEN 4
         WHEN '3 years' THEN 3 WHEN '2 years' THEN 2 WHEN '1 year' THEN 1 WHEN '< 1 year' THEN 0
    END AS emp_length_int
  FROM lt
  WHERE lower(trim(initial_list_status)) IN ('w', 'f')
)"""

CURATED = CLEANED + """, curated AS (
  SELECT addr_state, sub_grade, purpose, home_ownership, verification_status, initial_list_status,
    int_rate, fico_range_high, dti, acc_open_past_24mths, avg_cur_bal, bc_open_to_buy, mort_acc,
    num_tl_op_past_12m, percent_bc_gt_75, total_bc_limit, num_actv_rev_tl, inq_last_6mths,
    "default", id
  FROM cleaned
)"""


def with_loans(select_sql: str) -> str:
    return "WITH " + LOANS + "\n" + select_sql


def with_cleaned(select_sql: str) -> str:
    return "WITH " + CLEANED + "\n" + select_sql


def with_curated(select_sql: str) -> str:
    return "WITH " + CURATED + "\n" + select_sql
