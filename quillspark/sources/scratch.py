"""Tables written between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


#: Unless this is false, Spark shuffles both sides of a join that are already dealt alike by some of its keys.
SUBSET = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lost executors cost no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def written_by(df: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """df as a bucketed table in the shared folder, read again: rows that are alike in `by` lie in one bucket, so groups, windows and joins by those columns and others shuffle nothing."""
    spark = df.sparkSession
    if spark.conf.get(SUBSET, "true") == "true":
        spark.conf.set(SUBSET, "false")
    table, buckets = f"scratch_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *by)  # Spark drops it where df is dealt like this
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, *by).saveAsTable(table)
    found = spark.table(table)
    found.scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() or written_by() that nothing reads any more: what was made from them is written itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
