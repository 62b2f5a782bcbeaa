"""Writing results so that a re-run replaces its own rows and leaves all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write the rows; only partitions of keys that df has are replaced, in one committed job."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("append").partitionBy(*keys).parquet(path)


def as_json_text(df: DataFrame) -> DataFrame:
    """The same rows with arrays, maps and structs as JSON text, for sinks of plain columns."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in df.dtypes])
