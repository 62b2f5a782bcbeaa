"""Papers in a folder tree root/tender/bidder/*.pdf, as rows; file contents are read only where they are selected.

A tender without bidder folders whose papers lie directly in it is its own single bidder; papers beside bidder folders are left
out; folders named _output are never read. Tenders without any paper still have a row in tenders()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUT = "_output"


def papers(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(tender_id, bidder_name, source_file, path, length, modified) of every paper."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("/")[-1]
    parts = F.split(F.regexp_extract("path", f"/\\Q{base}\\E/(.*)$", 1), "/")
    placed = files.select("path", "length", F.col("modificationTime").alias("modified"), parts.alias("parts")).where(~F.array_contains("parts", OUTPUT))
    depth = F.size("parts")
    nested = placed.where(depth == 3).select(F.col("parts")[0].alias("tender_id"), F.col("parts")[1].alias("bidder_name"), F.col("parts")[2].alias("source_file"), "path", "length", "modified")
    flat = placed.where(depth == 2).select(F.col("parts")[0].alias("tender_id"), F.col("parts")[0].alias("bidder_name"), F.col("parts")[1].alias("source_file"), "path", "length", "modified")
    return nested.unionByName(flat.join(nested.select("tender_id").distinct(), "tender_id", "left_anti"))


def tenders(spark: SparkSession, root: str) -> DataFrame:
    """(tender_id) of every folder directly under root, also those without papers: one listing of one folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(e.getPath().getName() for e in entries if e.isDirectory() and e.getPath().getName() != OUTPUT)
    return spark.createDataFrame([(n,) for n in names], "tender_id string")


def folder_counts(spark: SparkSession, root: str) -> DataFrame:
    """(tender_id, papers, empty): papers of every tender, also of empty ones."""
    counts = papers(spark, root).groupBy("tender_id").agg(F.count("*").alias("papers"))
    return tenders(spark, root).join(counts, "tender_id", "left").select("tender_id", F.coalesce("papers", F.lit(0)).alias("papers"), F.col("papers").isNull().alias("empty"))
