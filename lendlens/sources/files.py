"""CSV scan (S2), curated Parquet sink (S4) and row preview."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .tables import checkpoint_dir

CORRUPT = "_corrupt_record"
# NULL marker distinct from the empty string, so "" and NULL survive a round trip.
NULL_MARKER = "\\N"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, keep_corrupt: bool = False,
             partitions: int | None = None, null_value: str = NULL_MARKER) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass).

    Bad lines are kept as NULL fields (``PERMISSIVE``); with
    ``keep_corrupt`` the raw line is kept in ``_corrupt_record``.  A gzip
    file is one split (gzip is not splittable), so ``partitions`` spreads
    the rows once after the scan; convert such inputs to Parquet early.
    """
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE")
                  .option("nullValue", null_value)
                  .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if keep_corrupt:
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = schema.add(CORRUPT, "string")
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.schema(schema).csv(path)
    return df.repartition(partitions) if partitions else df


def write_csv(df: DataFrame, path: str, compression: str = "gzip", null_value: str = NULL_MARKER) -> str:
    """Executors write the CSV parts; nothing is collected."""
    (df.write.mode("overwrite").option("header", True).option("compression", compression)
       .option("nullValue", null_value)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_curated(df: DataFrame, path: str, features: list[str], target: str = "default",
                  extra: list[str] = ()) -> str:
    """Overwrite the curated table (features + target) as Parquet."""
    df.select(*features, target, *extra).write.mode("overwrite").parquet(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def preview(df: DataFrame, cols: list[str], n: int = 12, order: str = "id") -> DataFrame:
    """A deterministic head of a few columns (top-n, no full sort)."""
    return df.select(*cols).orderBy(order).limit(n)
