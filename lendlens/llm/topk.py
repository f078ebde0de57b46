"""Exact top-k by inner product with Fagin's threshold algorithm (operator 7).

The vectors lie in blocks of bounded size; each block has one list per
dimension, sorted by that component.  For a query the lists are read from
their good end (large components where the query's is positive, small ones
where it is negative), at doubling depth; every vector met is scored whole.
No vector that has not been met can score more than the sum, over the lists,
of the query's component times the last one read.  The block is done as soon
as that bound is below the kth score found, or no vector is left.

The queries are a set of rows that meets all rows in blocks: each pair of a
block of vectors and a block of queries is one bounded group.  The blocks'
best k are ranked per query at the end.

Vectors that are null or hold null or non-finite components take no part.
Vectors of different length are compared as if the shorter one went on with
zeros.  Equal scores go to the smaller id.  A repeated candidate row counts as
a candidate of its own; a repeated query row is one query.  Empty tables give
an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8192
QUERIES = 512
FIRST_DEPTH = 16


def quantized(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    col = column.combine_chunks()
    size = np.asarray(col.value_lengths())
    flat = np.asarray(col.flatten()).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class SortedLists:
    """A block of vectors with its lists, one per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()  # (dimensions, vectors), ascending
        self.value = np.take_along_axis(x, self.order.T, axis=0).T.copy()

    def best(self, query_id, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors of the block, other than the query's own."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        met = np.zeros(n, bool)
        best_ids, best_scores = self.ids[:0], np.zeros(0, q.dtype)
        start, depth = 0, FIRST_DEPTH
        while True:
            stop = min(depth, n)
            fresh = np.zeros(n, bool)
            fresh[self.order[up, n - stop:n - start].ravel()] = True
            fresh[self.order[down, start:stop].ravel()] = True
            if stop == n:
                fresh[:] = True  # also a query without any list to read
            rows = np.flatnonzero(fresh & ~met)
            met[rows] = True
            ids = np.concatenate([best_ids, self.ids[rows]])
            scores = np.concatenate([best_scores, self.x[rows] @ q])
            other = ids != query_id
            ids, scores = ids[other], scores[other]
            order = np.lexsort((ids, -scores))[:k]
            best_ids, best_scores = ids[order], scores[order]
            if stop == n:
                return best_ids, best_scores
            bound = q[up] @ self.value[up, n - 1 - stop] + q[down] @ self.value[down, stop]
            if len(best_ids) == k and bound < best_scores[-1]:
                return best_ids, best_scores
            start, depth = stop, 2 * depth


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, rank, id, score): the k best of ``vectors`` for each row of
    ``queries``; both hold integer vectors."""
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    ask = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).dropDuplicates(["id", "v"])
    n, width = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    m = ask.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    width = width or 0
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = base.select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"), every(chunks).alias("chunk"))
    right = ask.select("*", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks)).cast("int").alias("chunk"), every(blocks).alias("blk"))

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "q": [], "id": [], "score": []}
        if block.num_rows and asked.num_rows:
            x, q = _matrix(block.column("v"), width), _matrix(asked.column("v"), width)
            if width * np.abs(x).max(initial=0).astype(float) * np.abs(q).max(initial=0) < 2.0 ** 53:
                x, q = x.astype(np.float64), q.astype(np.float64)  # exact, and fast to multiply
            lists = SortedLists(np.asarray(block.column("id")), x)
            for i, name in enumerate(asked.column("id").to_pylist()):
                ids, scores = lists.best(name, q[i], k)
                out["query_id"] += [name] * len(ids)
                out["q"] += [xxhash.xxh3_64_intdigest(q[i].astype(np.int64).tobytes()) >> 1] * len(ids)
                out["id"] += ids.tolist()
                out["score"] += [int(s) for s in scores]
        return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    found = left.groupBy("blk", "chunk").cogroup(right.groupBy("blk", "chunk")).applyInArrow(
        run, "query_id bigint, q bigint, id bigint, score bigint")
    # one query per (id, vector); q tells the vectors of one id apart
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
