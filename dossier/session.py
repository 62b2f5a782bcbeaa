"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that settle() has written in this session.
_SETTLED: list[str] = []
#: Broadcast hints are only given to tables whose row count is checked against this bound first.
SMALL_ROWS = 10_000


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a folder of our own, on a local master only: executors
    on other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return os.path.dirname(context.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that later jobs neither recompute them nor lose them with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def own_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which release() deletes."""
    _SETTLED.append(f"{shared_folder(spark)}/dossier-{uuid.uuid4().hex}")
    return _SETTLED[-1]


def settle(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed columnar table: for intermediates of many rows, of which later steps read some columns."""
    spark = df.sparkSession
    path = own_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that settle() has written in this session, and say how many: to be called when all results built on them are
    written or no longer wanted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_SETTLED)
    while _SETTLED:
        path = jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows in as many tasks as there are cores, if the scan gives fewer: for work that costs far more than its shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether df has at most so many rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; without one, for a join by shuffle, beyond that."""
    return F.broadcast(df) if is_small(df, rows) else df
