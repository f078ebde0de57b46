"""The ``loans`` table derived from the TPC-H-style driver tables.

The study works on a loan book (one row per loan, a raw status, text
fields that should be numeric, noisy codes, sparse columns, outlier caps,
a nested grade/sub-grade pair and two redundant numeric pairs).  The
driver tables have no such columns, so we derive them, one row per order,
with integer arithmetic only so that Spark and the SQL oracle agree bit
for bit.  The work grows with ``orders``/``lineitem``.

Plan shape: ``lineitem`` is pre-aggregated to one row per order before
the join (partial aggregation on the map side, one shuffle on
``l_orderkey``), ``orders`` joins ``customer`` on the customer key and the
25-row ``nation`` table is broadcast (its size is fixed by the schema).

With ``salted``, customers that hold more than one in ``HOT_SHARE`` of the
orders are found first (one pass over one column; at most ``HOT_SHARE`` of
them, whatever the data), their orders are dealt over ``SALTS`` keys and only
their customer rows are repeated, so one customer's orders are not one task's
work even where adaptive execution does not split the join.  The joined rows
of more than ``TASK_ORDERS`` orders per task slot are then dealt over so many
tasks that each holds that many at most, whatever the session's shuffle width, so
the sorts of one task do not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the fixture (must equal the oracle SQL).
GRADE_LETTERS = ["A", "B", "C", "D", "E", "F", "G"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


HOT_SHARE, SALTS = 1000, 32
TASK_ORDERS = 200_000


def _s(c: Column) -> Column:
    return c.cast("string")


def _d(c: Column) -> Column:
    return c.cast("double")


def hot_customers(orders: DataFrame) -> DataFrame:
    """(hot): customers with more than one in ``HOT_SHARE`` of the orders."""
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    total = orders.select(F.count("o_custkey")).scalar()
    return counts.where(F.col("n") * HOT_SHARE > total).select(F.col("o_custkey").alias("hot"))


def with_customers(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders with their customers' columns, hot customers' orders dealt."""
    # bounded: no more than HOT_SHARE keys can each hold that share
    hot = F.broadcast(hot_customers(orders))
    deal = lambda n: F.when(F.col("hot").isNotNull(), n).otherwise(0)
    left = orders.join(hot, F.col("o_custkey") == F.col("hot"), "left") \
        .withColumn("__salt", deal(F.pmod(F.xxhash64("o_orderkey"), F.lit(SALTS)).cast("int"))).drop("hot")
    right = customer.join(hot, F.col("c_custkey") == F.col("hot"), "left") \
        .withColumn("__slot", F.explode(F.sequence(F.lit(0), deal(F.lit(SALTS - 1))))).drop("hot")
    return left.join(right, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("__salt") == F.col("__slot"))) \
        .drop("__salt", "__slot")


def dealt(spark: SparkSession, rows: int) -> int:
    """Tasks of ``TASK_ORDERS`` rows at most, in full rounds of the cluster."""
    slots = spark.sparkContext.defaultParallelism
    return slots * max(1, -(-rows // (TASK_ORDERS * slots)))


def raw_loans(spark: SparkSession, sf_dir: str, salted: bool = False) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    items = (read_table(spark, sf_dir, "lineitem", ["l_orderkey"])
             .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items")))

    if salted:
        n = dealt(spark, orders.count())
        held = with_customers(orders, customer)
        # one round: left as it is, since forests draw by partition
        if n > spark.sparkContext.defaultParallelism:
            held, items = held.repartition(n, "o_orderkey"), items.repartition(n, "l_orderkey")
    else:
        held = orders.join(customer, orders.o_custkey == customer.c_custkey)
    base = (held.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left"))

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    charged = (F.col("o_orderstatus") == "P") & (k % 5 < 2)
    bad = F.when(charged, 1).otherwise(0)
    n_items = F.coalesce(F.col("n_items"), F.lit(0))
    b = base.select(
        k.alias("k"), c.alias("c"), "o_orderdate", "o_orderpriority", "o_totalprice",
        "c_mktsegment", "c_acctbal", "n_name", n_items.alias("n_items"),
        F.when(F.col("o_orderstatus") == "O", "Current")
         .when(charged, "Charged Off").otherwise("Fully Paid").alias("loan_status"),
        bad.alias("bad"),
    )
    # two congruential steps of the key: noise that no other column reveals, so
    # the grade carries the target's signal but does not give it away
    b = b.withColumn("u", (F.col("k") * 1103515245 + 12345) % 2147483647)
    b = b.withColumn("g", ((F.col("u") * 16807) % 2147483647 % 28 + 7 * F.col("bad")).cast("int"))

    k, c, g, bad, u = F.col("k"), F.col("c"), F.col("g"), F.col("bad"), F.col("u")
    grade = F.element_at(F.array(*[F.lit(x) for x in GRADE_LETTERS]), F.floor(g / 5).cast("int") + 1)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (c % 12).cast("int") + 1)
    score = (k * 31 + c) % 38
    emp_len = k % 13
    return b.select(
        k.alias("id"),
        "loan_status",
        F.col("n_name").alias("addr_state"),
        grade.alias("grade"),
        F.concat(grade, _s(g % 5 + 1)).alias("sub_grade"),
        (_d(600 + g * 55 + (k % 4) * 10) / 100).alias("int_rate"),
        _d(660 + 5 * score - 15 * bad).alias("fico_range_low"),
        _d(665 + 5 * score - 15 * bad).alias("fico_range_high"),
        F.when(k % 503 == 0, F.lit(999.0)).when(k % 19 == 0, F.lit(None).cast("double"))
         .otherwise(_d((k * 13) % 4000 + 300 * bad) / 100).alias("dti"),
        F.when(k % 701 == 0, F.lit(9999999.0)).otherwise(_d(F.col("o_totalprice"))).alias("tot_hi_cred_lim"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
         .otherwise(_d(F.col("o_totalprice")) / (8 + k % 5)).alias("avg_cur_bal"),
        F.when(k % 8 == 0, F.lit(None).cast("double")).otherwise(_d(F.col("c_acctbal"))).alias("bc_open_to_buy"),
        _d(c % 9).alias("mort_acc"),
        _d(F.col("n_items")).alias("num_tl_op_past_12m"),
        _d(F.col("n_items") + u % 4).alias("acc_open_past_24mths"),
        _d((u % 5) * 25).alias("percent_bc_gt_75"),
        _d((k * 97) % 60000).alias("total_bc_limit"),
        _d(k % 23).alias("num_actv_rev_tl"),
        _d(k % 23 + F.when(k % 29 == 0, 1).otherwise(0)).alias("num_rev_tl_bal_gt_0"),
        F.when(k % 401 == 0, "Feb-1999").when(k % 397 == 0, "690")
         .otherwise(_s(k % 7)).alias("inq_last_6mths"),
        F.when(k % 97 == 0, "72").when(k % 3 == 0, " F ").otherwise("w").alias("initial_list_status"),
        F.when(emp_len == 0, "< 1 year").when(emp_len == 1, "1 year")
         .when(emp_len.isin(10, 12), "10+ years").when(emp_len == 11, F.lit(None).cast("string"))
         .otherwise(F.concat(_s(emp_len), F.lit(" years"))).alias("emp_length"),
        F.when(F.col("c_mktsegment") == "BUILDING", "MORTGAGE")
         .when(F.col("c_mktsegment") == "AUTOMOBILE", "RENT")
         .when(F.col("c_mktsegment") == "FURNITURE", "OWN")
         .when(F.col("c_mktsegment") == "MACHINERY", "ANY").alias("home_ownership"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Verified")
         .when(F.col("o_orderpriority") == "5-LOW", "Not Verified")
         .otherwise("Source Verified").alias("verification_status"),
        F.concat(F.lit("purpose_"), _s(k % 14)).alias("purpose"),
        F.when(k % 14 < 6, "Debt Consolidation").when(k % 14 < 9, "Credit card refinancing")
         .when(k % 14 == 13, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("note "), _s(k))).alias("title"),
        F.when(k % 11 == 0, "").when(k % 13 == 0, "NaN")
         .otherwise(F.concat(F.lit("job "), _s(k % 300))).alias("emp_title"),
        F.concat(F.lit("$"), _s(30 + k % 90), F.lit(","), _s(100 + k % 800)).alias("annual_inc"),
        F.concat(_s(k % 100), F.lit(".5%")).alias("revol_util"),
        F.date_format("o_orderdate", "MMM-yyyy").alias("issue_d"),
        F.when(k % 211 == 0, "f")
         .otherwise(F.concat(month, F.lit("-"), _s(1975 + c % 19))).alias("earliest_cr_line"),
        F.when(k % 5 == 0, _d(k % 120)).alias("mths_since_last_record"),
        F.when(k % 100 == 0, "y").otherwise("n").alias("pymnt_plan"),
        F.lit(1).alias("policy_code"),
        _d(bad * (k % 1000)).alias("recoveries"),
    )
