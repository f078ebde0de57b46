"""Connected components of an edge table, by alternating star steps.

The large step hangs every larger neighbour of a node on the smallest node
around it, the small step does so with the smaller ones; both keep the
components and flatten them to stars in a number of rounds that grows with
the logarithm of their size.  Each step's minima are written to the shared
folder before the edges meet them, so a hub's edges can be split over tasks
by adaptive execution, and no round carries the lineage of the ones before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.sources.tables import materialize


def _step(edges: DataFrame, name: str) -> DataFrame:
    """For edges (u, v): hang each v that is larger than u, and u itself, on
    the smallest of u and its v."""
    least = materialize(
        edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return edges.join(least, "u").select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has
    an edge to another.  ``edges`` has columns (u, v) in any direction, with
    repeats and loops."""
    flat = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = flat.union(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _step(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialize(large.distinct(), "large-star")
        small = _step(down, "small")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        flat = materialize(hung.where("u <> v").distinct(), "small-star")
        if _stars(flat):
            return flat.select(F.col("u").alias("node"), F.col("v").alias("component")) \
                .union(flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every u hangs on one v that hangs on nothing: the components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not per.where("hangs > 1 or (hangs > 0 and holds > 0)").limit(1).count()
