"""Running sums along the rows of a key, over range partitions.

Rows are dealt by ranges of (keys, order) and sorted inside each partition,
so a key that a third of all rows share is spread over many tasks.  Each task
adds up along its own rows; the only thing that is missing there is what
earlier partitions hold of the key that a partition begins with.  Those totals
are taken from the written table, at most two rows per partition, and put on
when it is read.  No row carries anything that grows with the data.

Sums are 64-bit and wrap around, so they also serve as prefix digests.  Keys
must not be null; nulls in the order come first; a null summand counts as 0.
Equal (keys, order) rows are summed in any order.  An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

_PID, _NTH = "__pid", "__nth"


def _numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names])


def _with(batch: pa.RecordBatch, names: list[str], values: np.ndarray) -> pa.RecordBatch:
    """The batch with ``names`` replaced or added."""
    have = {c: batch.column(c) for c in batch.schema.names}
    have |= {c: pa.array(np.ascontiguousarray(values[:, i]).view(np.int64)) for i, c in enumerate(names)}
    return pa.RecordBatch.from_arrays([*have.values()], names=[*have])


def _breaks(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Where a row's key is not that of the row before it."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        col = batch.column(k)
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    new[0] = _key(batch, keys, 0) != last
    return new


def _key(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: Mapping[str, Column], name: str = "running",
                 before: bool = False, partitions: int | None = None) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows of the same
    keys up to and including this one; with ``before`` also, as
    ``<name>_before``, the sum without this one."""
    outs = list(sums)
    more = [*outs, *([f"{o}_before" for o in outs] if before else [])]
    summed = [*outs, _NTH]
    values = {o: F.coalesce(c.cast("bigint"), F.lit(0)) for o, c in sums.items()}
    deal = [partitions] if partitions else []
    ranged = df.withColumns(values).repartitionByRange(*deal, *keys, *order).sortWithinPartitions(*keys, *order) \
        .withColumn(_NTH, F.lit(1).cast("bigint")).withColumn(_PID, F.spark_partition_id())
    fields = [(f.name, f.dataType.simpleString()) for f in ranged.schema.fields]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields + [(c, "bigint") for c in more if c not in outs])

    def add_up(batches):
        last, carry = None, np.zeros(len(summed), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _breaks(batch, keys, last)
            each = _numbers(batch, summed)
            total = np.cumsum(each, axis=0, dtype=np.uint64)
            base = np.concatenate([(np.uint64(0) - carry)[None], (total - each)[new]])
            total -= base[np.cumsum(new)]
            last, carry = _key(batch, keys, -1), total[-1]
            if before:
                yield _with(batch, [*summed, *more[len(outs):]], np.column_stack([total, (total - each)[:, :len(outs)]]))
            else:
                yield _with(batch, summed, total)

    written = materialize(ranged.mapInArrow(add_up, schema), name)
    carried = _carried(written, keys, outs)
    if not carried:
        return written.drop(_PID, _NTH)
    shared = df.sparkSession.sparkContext.broadcast(carried)

    def put_on(batches):
        for batch in batches:
            plus = np.zeros((batch.num_rows, len(outs)), np.uint64)
            pids = batch.column(_PID).to_numpy(zero_copy_only=False)
            for pid in set(np.unique(pids).tolist()) & shared.value.keys():
                key, sums_ = shared.value[pid]
                mine = pids == pid
                for k, v in zip(keys, key, strict=True):
                    mine &= pc.equal(batch.column(k), pa.scalar(v, batch.schema.field(k).type)).to_numpy(zero_copy_only=False)
                plus[mine] = np.array(sums_, np.uint64)
            names = more if before else outs
            yield _with(batch, names, _numbers(batch, names) + (np.tile(plus, 2) if before else plus))

    return written.mapInArrow(put_on, schema).drop(_PID, _NTH)


def _carried(written: DataFrame, keys: list[str], outs: list[str]) -> dict[int, tuple[tuple, list[int]]]:
    """Per partition that goes on with an earlier one's key: (key, sums so far).
    Reads one row per partition, then one per partition of the keys that lie
    in several."""
    key = F.struct(*keys)
    ends = written.groupBy(_PID).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    ends.sort(key=lambda r: r[_PID])
    parted = {tuple(b["lo"]) for a, b in zip(ends, ends[1:], strict=False) if a["hi"] == b["lo"]}
    if not parted:
        return {}
    types = [f"`{k}` {written.schema[k].dataType.simpleString()}" for k in keys]
    few = written.sparkSession.createDataFrame(sorted(parted), ", ".join(types))
    tails = written.join(F.broadcast(few), keys, "left_semi").groupBy(*keys, _PID).agg(
        F.max_by(F.struct(*outs), F.col(_NTH)).alias("sums")).collect()
    carried: dict[int, tuple[tuple, list[int]]] = {}
    so_far: dict[tuple, list[int]] = {}
    for r in sorted(tails, key=lambda r: r[_PID]):
        k = tuple(r[c] for c in keys)
        if k in so_far:
            carried[r[_PID]] = (k, so_far[k])
        so_far[k] = [(a + b) % (1 << 64) for a, b in zip(so_far.get(k, [0] * len(outs)), r["sums"], strict=True)]
    return carried
