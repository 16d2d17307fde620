"""Snapshots of the document tables: Parquet folders with a manifest, and CSV files for exchange."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "\\N"
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": NULL, "maxCharsPerColumn": "-1"}


def as_text(name: str, kind: T.DataType) -> Column:
    """A column as a CSV cell: true and false, JSON for nested values, no NUL characters."""
    column = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        text = F.when(column, "true").when(~column, "false")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        text = F.when(F.size(column) > 0, F.concat(F.lit("["), F.array_join(column.cast("array<string>"), ","), F.lit("]")))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.regexp_replace(text, "\\x00", "").alias(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*[as_text(f.name, f.dataType) for f in df.schema.fields]).write.mode("overwrite").options(**CSV).csv(path)


def replace_csv(df: DataFrame, path: str) -> None:
    """A CSV folder written beside the one at path, which it then replaces by renaming; the old one stays if anything fails."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    target = hadoop(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        write_csv(df, staged)
        moved = not fs.exists(target) or fs.rename(target, hadoop(old))
        if not moved or not fs.rename(hadoop(staged), target):
            if moved and fs.exists(hadoop(old)):
                fs.rename(hadoop(old), target)
            raise OSError(f"{path} could not be replaced")
        fs.delete(hadoop(old), True)
    finally:
        fs.delete(hadoop(staged), True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cells back to their types; an empty cell of a text column is an empty text, the null marker is null."""
    names = [f.name for f in schema.fields]
    texts = spark.read.options(**CSV).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    cells = []
    for field in schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            cell = F.from_json(cell, field.dataType)
        elif not isinstance(field.dataType, T.StringType):
            cell = cell.try_cast(field.dataType)
        elif not field.nullable:
            cell = F.coalesce(cell, F.lit(""))
        cells.append(cell.alias(field.name))
    return texts.select(*cells)


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, version: str) -> None:
    """All tables as one new snapshot; the manifest with their row counts is written last, and only then do readers see the snapshot."""
    counts = []
    for name, df in tables.items():
        path = f"{root}/snapshot={version}/{name}"
        df.write.mode("overwrite").parquet(path)
        counts.append((version, name, spark.read.parquet(path).count()))
    spark.createDataFrame(counts, "version string, table_name string, row_count long").coalesce(1).write.mode("append").json(f"{root}/manifest")


def current_version(spark: SparkSession, root: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    # versions are compared by their numbers, so 10 comes after 9; then as text
    parts = F.transform(F.regexp_extract_all("version", F.lit(r"\d+"), 0), lambda n: n.cast("decimal(38,0)"))
    return spark.read.schema("version string").json(f"{root}/manifest").agg(F.max(F.struct(parts.alias("parts"), "version")).alias("newest")).select("newest.version").first()[0]


def read_current(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of the newest published snapshot; empty if there is none."""
    version = current_version(spark, root)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{root}/snapshot={version}/{name}")


def manifest_text(counts: Mapping[str, int]) -> str:
    return json.dumps(dict(sorted(counts.items())))
