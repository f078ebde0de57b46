"""Parquet table access (S3) and lineage cuts.

Every reader projects the columns it needs right at the scan so the
Parquet reader only decodes those column chunks (``ReadSchema`` in the
plan) and Catalyst can push filters into row-group statistics.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """S3: scan one Parquet table, optionally pruned to ``columns``."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without that setting, a session on one machine (tests) gets a folder under
    the SQL warehouse; on a cluster there is no folder that would be right, so
    the session has to name one.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir
    sc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if sc_dir.isDefined():
        return sc_dir.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    spark.sparkContext.setCheckpointDir(warehouse.rstrip("/") + "/_lendlens_checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str, spread: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    This cuts lineage the fault-tolerant way: the table lives on shared
    storage, so losing an executor only re-runs the tasks of the read,
    never the whole upstream plan (unlike ``cache``/``localCheckpoint``).

    With ``spread``, a table that reads as fewer splits than the cluster has
    task slots is dealt round-robin when read, so later narrow stages (model
    fitting, scoring, perturbation) use every core.  Counting the splits of a
    written table runs nothing.  ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    for made in _MADE[-1:]:
        made.append(path)
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    slots = spark.sparkContext.defaultParallelism
    return out.repartition(slots) if spread and out.rdd.getNumPartitions() < slots else out


#: Paths written inside the open :func:`intermediates` blocks, innermost last.
_MADE: list[list[str]] = []


def remove_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at the end of the block, every table that :func:`materialize`
    wrote inside it.  The block has to write its result elsewhere: a frame that
    reads such a table can't be run afterwards."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        for path in _MADE.pop():
            remove_path(spark, path)


def source_stamp(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    """Length and last change of tables, to tell whether something learned
    from them is still about the same files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        fs = path.getFileSystem(conf)
        files = [path] if fs.getFileStatus(path).isFile() else [f.getPath() for f in fs.listStatus(path)]
        stats = [fs.getFileStatus(f) for f in files]
        out.append((name, sum(x.getLen() for x in stats), max((x.getModificationTime() for x in stats), default=0)))
    return tuple(out)
