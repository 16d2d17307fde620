"""Metrics of stages appended from a stream, each record once however often a batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def append_stages(records: DataFrame, root: str, checkpoint: str, log: str = "stages") -> StreamingQuery:
    """A stream that appends records to the log at root.

    A batch is a folder named by its number and is written anew when it's replayed, so a stream that is killed between a batch's data and its commit repeats the batch and adds nothing.
    The numbers belong to the checkpoint: a stream with another checkpoint needs a log of another name.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log={log}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stages_of(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All records of all logs at root, with the log and batch they came in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = T.StructType([*schema.fields, T.StructField("log", T.StringType()), T.StructField("batch", T.LongType())])
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(root)


def first_of_each(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One record for each key: senders repeat records too, in batches of their own. The first in `order` stays."""
    kept = records.groupBy(*keys).agg(F.min_by(F.struct(*records.columns), F.struct(order, "batch")).alias("r"))
    return kept.select("r.*")
