"""Keyed hashing (R5): a reproducible per-row random number.

``rand(seed)`` depends on how rows are partitioned, so a split or fold
assignment made with it changes when the cluster, the file layout or AQE
changes.  A hash of the row key and a seed does not: the same row always
lands in the same split, on any cluster and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_SPAN = float(2 ** HASH_BITS)


def keyed_hash(key, seed) -> Column:
    """60-bit integer from md5(key || '|' || seed)."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit("|"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def keyed_uniform(key, seed) -> Column:
    """Uniform number in [0, 1) from :func:`keyed_hash`."""
    return keyed_hash(key, seed).cast("double") / F.lit(HASH_SPAN)
