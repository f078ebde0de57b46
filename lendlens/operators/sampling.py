"""Sampling, stratified splits and folds.

Default assignments use the keyed hash (R5): no shuffle, no window, no
dependence on partitioning, identical in SQL.  Stratification is then "in
expectation" (each class is cut at the same hash threshold), which is what
the per-class ``randomSplit`` of the study gives.  The exact variant cuts
each class at its own exact hash quantile: totals of equal hash ranges say
which range holds the cut, that range is cut into ranges again, and so on
until what is left of it can be sorted within ``SORT_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, keyed_hash, keyed_uniform
from ..sources.tables import materialize as _materialize
from .running import running_sums

TRAIN, TEST = "train", "test"
LEVEL_BITS = 14  # hash ranges that one step of the descent tells apart, per class
#: Hashes of one class that one task sorts; a row of the sort is about 24 bytes.
SORT_BYTES, SORT_ROW = 96 << 20, 24


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Bernoulli sample without replacement.  With ``key`` the sample is
    reproducible across partitionings (keyed hash below ``fraction``)."""
    if key is None:
        return df.sample(False, fraction, seed)
    return df.filter(keyed_uniform(key, seed) < fraction)


def sample_size(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """R2: a simple random sample of exactly min(n, count) rows: the ``n``
    rows with the smallest keyed hash.  ``orderBy().limit()`` runs as a
    top-n (each task keeps n rows), so no global sort happens; the limit is
    the operator's purpose (plots need a bounded sample)."""
    return df.orderBy(keyed_uniform(key, seed)).limit(n)


def stratified_split(df: DataFrame, target: str = "default", train_frac: float = 0.8, seed: int = 42,
                     key: str = "id", out: str = "split", exact: bool = False) -> DataFrame:
    """Label every row ``train``/``test``.

    ``exact=False``: keyed hash below ``train_frac`` (stratified in
    expectation, no shuffle).  ``exact=True``: per class, the rows whose hash
    is at or below the class's exact ``train_frac`` quantile of the hash.
    """
    h = keyed_hash(key, seed)
    if not exact:
        return df.withColumn(out, F.when(keyed_uniform(key, seed) < train_frac, TRAIN).otherwise(TEST))
    cls = F.col(target).cast("string")
    cuts = _cuts(df.where(cls.isNotNull()).select(cls.alias("__cls"), h.alias("__h")), train_frac)
    j = df.join(F.broadcast(cuts), cls == F.col("__cls"), "left")
    part = F.when(cls.isNull(), None).when(h <= F.col("__cut"), TRAIN).otherwise(TEST)
    return j.withColumn(out, part).drop("__cls", "__cut")


def _cuts(hashed: DataFrame, train_frac: float, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """``(__cls, __cut)``: the largest hash of each class's first ``train_frac``
    rows in hash order, null if there is none.  Every step reads the hashes and
    keeps, per class, totals of 2^LEVEL_BITS ranges at most."""
    classes = hashed.groupBy("__cls").agg(F.count(F.lit(1)).alias("__n"))
    at = _materialize(classes.select("__cls", F.lit(0).cast("bigint").alias("__at"), "__n",
                                     F.round(F.col("__n") * train_frac).cast("bigint").alias("__want")), "split-cut")
    shift = HASH_BITS
    while shift > 0 and (at.agg(F.max("__n")).first()[0] or 0) * SORT_ROW > sort_bytes:
        up, shift = shift, max(0, shift - LEVEL_BITS)
        near = hashed.join(F.broadcast(at), "__cls").where(F.shiftright("__h", up) == F.col("__at"))
        totals = near.groupBy("__cls", "__want", F.shiftright("__h", shift).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy("__cls", "__want").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        ranges = totals.select("*", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
        # ranges are ordered like their hashes: the last one that begins within the wanted count
        found = ranges.where((F.col("__off") < F.col("__want")) | (F.col("__off") == 0)).groupBy("__cls").agg(F.max(F.struct(
            "__b", "__n", (F.col("__want") - F.col("__off")).alias("__want"))).alias("m"))
        at = _materialize(found.select("__cls", F.col("m.__b").alias("__at"), "m.__n", "m.__want"), "split-cut")
    near = hashed.join(F.broadcast(at), "__cls").where(F.shiftright("__h", shift) == F.col("__at"))
    counts = near.groupBy("__cls", "__at", "__want", "__h").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy("__cls", "__at").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)
    kept = counts.withColumn("__run", F.sum("__n").over(over)).where(F.col("__run") <= F.col("__want"))
    cut = kept.groupBy("__cls").agg(F.max("__h").alias("__cut"))
    # no hash of the last range belongs to it: all that came before does
    below = F.shiftleft(F.col("__at"), shift) - 1
    return at.join(cut, "__cls", "left").select("__cls", F.coalesce("__cut", below).alias("__cut"))


def split_frames(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    labelled = stratified_split(df, **kw)
    out = kw.get("out", "split")
    return (labelled.filter(F.col(out) == TRAIN).drop(out),
            labelled.filter(F.col(out) == TEST).drop(out))


def class_wise_union(df: DataFrame, target: str = "default", **kw) -> DataFrame:
    """Split each class separately, then union the class-wise parts (the
    study's construction); the result has exactly the input rows."""
    parts = []
    for cls in (0, 1):
        part = stratified_split(df.filter(F.col(target) == cls), target=target, **kw)
        parts.append(part)
    return parts[0].unionByName(parts[1])


def assign_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "id", out: str = "fold",
                 stratify: str | None = None) -> DataFrame:
    """Fold number in [0, k) from a keyed hash (seed distinct from the
    split's), stratified in expectation.

    With ``stratify`` the folds of each class differ by one row at most: rows
    are numbered by hash within their class, over range partitions, and dealt
    round the folds; rows without a class are a class of their own.
    """
    if stratify is None:
        return df.withColumn(out, F.floor(keyed_uniform(key, f"{seed}|fold") * k).cast("int"))
    named = F.coalesce(F.concat(F.lit("="), F.col(stratify).cast("string")), F.lit(""))
    hashed = df.withColumns({"__cls": named, "__h": keyed_hash(key, f"{seed}|fold")})
    numbered = running_sums(hashed, ["__cls"], ["__h", key], {"__i": F.lit(1)}, "folds")
    return numbered.withColumn(out, ((F.col("__i") - 1) % k).cast("int")).select(*df.columns, out)


def split_audit(labelled: DataFrame, target: str = "default", split: str = "split") -> DataFrame:
    """Size and target rate of each split and of the whole (rollup)."""
    return (labelled.rollup(split)
                    .agg(F.count(F.lit(1)).alias("n"),
                         F.round(F.avg(F.col(target).cast("double")), 6).alias("default_rate"))
                    .withColumn(split, F.coalesce(F.col(split), F.lit("all"))))
