"""Pages as they arrive: the incremental forms of the page reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import own_path

#: A page read again within this time of its first reading is the same reading.
LATE = "30 days"


def arriving(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """The pages of a folder of Parquet files as a stream; new files are new pages."""
    schema = spark.read.parquet(path).schema
    if path.endswith(".parquet"):  # a table may be one file; as a pattern it may be either
        path = path.removesuffix(".parquet") + "[.]parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_readings(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Each page once, by its place; state is dropped as the watermark passes."""
    return stream.withColumn("read_at", F.col("read_at").cast("timestamp")).withWatermark("read_at", late).dropDuplicatesWithinWatermark(["tender_id", "bidder_name", "source_file", "page_number"])


def hourly(stream: DataFrame) -> DataFrame:
    """(hour, source, pages): tumbling counts."""
    at = F.window(F.col("read_at").cast("timestamp"), "1 hour")
    return stream.groupBy(at.alias("w"), F.coalesce("source", F.lit("unread")).alias("source")).agg(F.count("*").alias("pages")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "source", "pages")


def settled(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run the stream over all that is there and return its result table, in the shared folder."""
    spark = stream.sparkSession
    path = own_path(spark)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
