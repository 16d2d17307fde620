"""New files found as a stream; event counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, base: str, accepted: tuple[str, ...] = ("pdf", "docx", "pptx", "xlsx")) -> DataFrame:
    """A stream of the files that appear below base, without their contents. Changed and deleted files need the catalog's diff."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(base)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.select("path", F.col("length").alias("file_size"), "modificationTime", kind.alias("filetype")).withColumn("supported", F.col("filetype").isin(*accepted))


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of a stream by window and type; what comes later than `late` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
