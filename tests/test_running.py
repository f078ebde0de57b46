"""Running sums over range partitions: exact, spread, nothing that grows on a row."""
import random

from pyspark.sql import functions as F

from lendlens.operators import rankstats as RK
from lendlens.operators.running import running_sums


def test_running_sums_of_a_hot_key_lie_in_many_partitions(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i, rng.randrange(100) if i % 7 else None) for i in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    got = running_sums(df, ["k"], ["o"], {"s": F.col("v"), "nth": F.lit(1)}, before=True, partitions=11)
    assert set(got.columns) == {"k", "o", "v", "s", "nth", "s_before", "nth_before"}
    want, so_far = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[:2]):
        s, n = so_far.get(k, (0, 0))
        so_far[k] = (s + (v or 0), n + 1)
        want[k, o] = (*so_far[k], s, n)
    assert {(r["k"], r["o"]): (r["s"], r["nth"], r["s_before"], r["nth_before"]) for r in got.collect()} == want


def test_running_sums_wrap_and_null_orders_come_first(spark):
    big = (1 << 62) + 5
    df = spark.createDataFrame([(1, None, big), (1, 1, big), (1, 2, big), (2, 1, 7)], "k bigint, o int, v bigint")
    for n in (1, 4):
        got = {(r["k"], r["o"]): r["s"] for r in running_sums(df, ["k"], ["o"], {"s": F.col("v")}, partitions=n).collect()}
        wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
        assert got == {(1, None): big, (1, 1): wrap(2 * big), (1, 2): wrap(3 * big), (2, 1): 7}
    assert running_sums(df.limit(0), ["k"], ["o"], {"s": F.col("v")}).count() == 0


def test_running_counts_carry_no_arrays(spark):
    df = spark.createDataFrame([(float(i % 900), i % 2) for i in range(3000)], "x double, default int")
    vc = RK.value_counts(df, ["x"], "default")
    for plan in (RK.cum_counts(vc), RK.quantiles(vc, ["variable"], {"m": 0.5})):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "approx" not in text and "filter(" not in text and "array" not in text
    assert "Window" not in RK.cum_counts(vc)._jdf.queryExecution().optimizedPlan().toString()
