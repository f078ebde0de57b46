"""Tables that several reports share, written once per state of their sources.

A report that needs more than one pass asks :meth:`SharedTables.get` for its
table.  The first one writes it under the checkpoint folder; later ones over
the same files read it (only the columns and row groups they need).  When the
source files change, the next request writes a new table and removes the old
one; :meth:`SharedTables.release` removes what is left.  A report of one pass
uses :meth:`SharedTables.peek`, which never writes, and stays lazy.

Frames that were read from a table before it was removed can no longer be run.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .tables import checkpoint_dir, remove_path, source_stamp


@dataclass
class _Written:
    stamp: tuple
    path: str
    schema: StructType


class SharedTables:
    def __init__(self) -> None:
        self._written: dict[tuple[str, str, str], _Written] = {}
        self._lock = threading.RLock()

    @staticmethod
    def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, str]:
        return spark.sparkContext.applicationId, os.path.normpath(sf_dir) if "://" not in sf_dir else sf_dir, name

    def peek(self, spark: SparkSession, sf_dir: str, name: str, sources: list[str]) -> DataFrame | None:
        """The table, if it is written and still about the same files."""
        found = self._written.get(self._key(spark, sf_dir, name))
        if found and found.stamp == source_stamp(spark, sf_dir, sources):
            return spark.read.schema(found.schema).parquet(found.path)
        return None

    def get(self, spark: SparkSession, sf_dir: str, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The table; written now if it is not there or its sources changed."""
        with self._lock:
            have = self.peek(spark, sf_dir, name, sources)
            if have is not None:
                return have
            key = self._key(spark, sf_dir, name)
            # taken before the sources are read: a change meanwhile leads to one more rebuild
            stamp = source_stamp(spark, sf_dir, sources)
            df = build()
            path = os.path.join(checkpoint_dir(spark), f"shared-{name}-{uuid.uuid4().hex[:12]}")
            df.write.parquet(path)
            old = self._written.get(key)
            self._written[key] = _Written(stamp, path, df.schema)
            if old:
                remove_path(spark, old.path)
            return spark.read.schema(df.schema).parquet(path)

    def release(self, spark: SparkSession, sf_dir: str | None = None) -> int:
        """Remove this session's tables (of one source folder); how many."""
        app = spark.sparkContext.applicationId
        with self._lock:
            gone = [k for k in self._written if k[0] == app and (sf_dir is None or k[1] == self._key(spark, sf_dir, "")[1])]
            for k in gone:
                remove_path(spark, self._written.pop(k).path)
        return len(gone)

    def paths(self, spark: SparkSession) -> list[str]:
        return [w.path for k, w in self._written.items() if k[0] == spark.sparkContext.applicationId]


SHARED = SharedTables()
