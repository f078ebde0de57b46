"""Shared tables: written once per source state, read by later reports, removed on release."""
import os
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lendlens.plans import study as S
from lendlens.sources import loans as L
from lendlens.sources.shared import SHARED
from lendlens.sources.tables import intermediates, materialize


@pytest.fixture
def copied(sf_small, tmp_path):
    for t in S.SOURCES:
        shutil.copy(f"{sf_small}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def _local(path):
    return path.removeprefix("file:")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_second_report_reads_the_shared_table(spark, copied):
    assert SHARED.peek(spark, copied, "loans", S.SOURCES) is None
    lazy = E.queries()["a12_default_rate_by_sub_grade"](spark, copied)
    assert any("orders.parquet" in f for f in lazy.inputFiles()) and SHARED.peek(spark, copied, "loans", S.SOURCES) is None
    first = E.queries()["t17_categorical_report"](spark, copied)
    paths = SHARED.paths(spark)
    assert first.count() and len([p for p in paths if "shared-loans" in p or "shared-recoded" in p]) >= 2
    for name in ("t17_categorical_report", "a12_default_rate_by_sub_grade", "a9_categorical_audit", "f2_nominal_index"):
        again = E.queries()[name](spark, copied)
        assert not any(f"{t}.parquet" in f for f in again.inputFiles() for t in S.SOURCES), name
    # only the needed columns are read
    assert "ReadSchema: struct<sub_grade:string,default:int>" in _plan(E.queries()["a12_default_rate_by_sub_grade"](spark, copied))
    assert SHARED.paths(spark) == paths
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, E.queries()["a12_default_rate_by_sub_grade"](spark, copied).collect()))
    SHARED.release(spark, copied)


def test_changed_files_rebuild_and_release_leaves_nothing(spark, copied):
    before = {p for p in SHARED.paths(spark)}
    n = S.shared_recoded(spark, copied).count()
    old = set(SHARED.paths(spark)) - before
    assert old and all(os.path.exists(_local(p)) for p in old)
    orders = spark.read.parquet(f"{copied}/orders.parquet")
    orders.union(orders.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)).write.parquet(f"{copied}/more")
    shutil.rmtree(f"{copied}/orders.parquet", ignore_errors=True)
    if os.path.isfile(f"{copied}/orders.parquet"):
        os.remove(f"{copied}/orders.parquet")
    shutil.move(f"{copied}/more", f"{copied}/orders.parquet")
    assert S.shared_recoded(spark, copied).count() > n
    new = set(SHARED.paths(spark)) - before
    assert not new & old and not any(os.path.exists(_local(p)) for p in old) and all(os.path.exists(_local(p)) for p in new)
    assert SHARED.release(spark, copied) == len(new)
    assert not any(os.path.exists(_local(p)) for p in new) and set(SHARED.paths(spark)) == before


def test_shared_and_lazy_tables_hold_the_same_rows(spark, sf_small):
    a, b = S.curated(S.shared_recoded(spark, sf_small)), S.curated_loans(spark, sf_small)
    assert a.schema.simpleString() == b.schema.simpleString()
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_one_customer_on_half_the_orders_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        orders = spark.range(20000).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 2 == 0, 7).otherwise(
            F.col("id") % 9000).cast("bigint").alias("o_custkey"))
        customer = spark.range(9000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = L.with_customers(orders, customer)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) < 3 * 20000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert joined.columns == ["o_orderkey", "o_custkey", "c_custkey", "c_nationkey"]
        plain = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        assert joined.exceptAll(plain).count() == plain.exceptAll(joined).count() == 0
        assert L.hot_customers(orders).collect()[0]["hot"] == 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_intermediates_are_removed(spark):
    with intermediates(spark) as made:
        a = materialize(spark.range(5), "short-lived")
        with intermediates(spark) as inner:
            materialize(a, "shorter-lived")
        assert len(made) == 1 and not os.path.exists(_local(inner[0])) and os.path.exists(_local(made[0]))
        assert a.count() == 5
    assert not os.path.exists(_local(made[0]))


def test_shared_loans_are_dealt_by_rows(spark, copied, monkeypatch):
    monkeypatch.setattr(L, "TASK_ORDERS", 25)
    orders = spark.read.parquet(f"{copied}/orders.parquet").count()
    sizes = [r["count"] for r in L.raw_loans(spark, copied, salted=True).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == orders and max(sizes) <= 3 * 25


def test_encoders_write_their_columns_alone(spark, copied):
    SHARED.release(spark, copied)
    before = set(SHARED.paths(spark))
    names = ("f1b_ordinal_unseen_minus_one", "f1_ordinal_index", "f2_nominal_index", "f3_one_hot")
    alone = {n: sorted(map(tuple, E.queries()[n](spark, copied).collect())) for n in names}
    made = set(SHARED.paths(spark)) - before
    assert made and not [p for p in made if "shared-loans" in p or "shared-recoded" in p]
    S.shared_recoded(spark, copied)
    assert alone == {n: sorted(map(tuple, E.queries()[n](spark, copied).collect())) for n in names}
    SHARED.release(spark, copied)
