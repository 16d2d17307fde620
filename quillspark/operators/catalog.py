"""The file catalog: differences between snapshots, merging of snapshots, deterministic ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import stable_id
from quillspark.sources.results import file_system

FILE = ("file_path", "file_size", "date_last_modified", "file_hash")


def scan_files(spark: SparkSession, base: str, content: bool = True) -> DataFrame:
    """One row per file below base, with the folders as dimensions; hidden files and files directly in base are left out.

    The hash is computed in the scan's tasks; with content=False only names, sizes and times are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^file:/+", "/")
    prefix = full.replace("file:", "", 1) if full.startswith("file:") else full
    prefix = "/" + prefix.lstrip("/") if full.startswith("file:") else prefix
    relative = F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))
    hashed = F.sha2("content", 256) if content else F.lit(None).cast("string")
    rows = files.select(
        plain.alias("file_path"), relative.alias("relative_path"), F.col("length").alias("file_size"),
        (F.unix_micros("modificationTime") / 1e6).alias("date_last_modified"), hashed.alias("file_hash"),
    )
    return path_dimensions(rows).filter(~F.col("relative_path").rlike(r"(^|/)\.") & F.col("relative_path").contains("/"))


def hashed_files(files: DataFrame, portion: int = 8 << 20, task_bytes: int = 1 << 30) -> DataFrame:
    """file_path and file_hash (SHA-256) of files (file_path, file_size), read in portions inside the tasks, so memory is bounded and a file may have any size; null for a file that is gone.

    Files are dealt to tasks by a hash of their paths, as many as the bytes need. Give it only files whose hash isn't known (with_known_hashes).
    """
    total = files.agg(F.sum("file_size")).first()[0] or 0
    tasks = max(1, min(-(-total // task_bytes), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file_path").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([file_hash(path, portion)], pa.string())], names=["file_path", "file_hash"])

    return files.select("file_path", "file_size").repartition(tasks, F.xxhash64("file_path")).mapInArrow(run, "file_path string, file_hash string")


def file_hash(path: str, portion: int) -> str | None:
    store, name = file_system(path)
    digest = hashlib.sha256()
    try:
        with store.open_input_stream(name) as stream:
            while data := stream.read(portion):
                digest.update(data)
    except FileNotFoundError:
        return None
    return digest.hexdigest()


def path_dimensions(files: DataFrame, relative: str = "relative_path") -> DataFrame:
    """files with data_source, filter_1 to filter_3 (deeper folders joined into the third), filename and filetype."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    name = F.element_at(parts, -1)
    level = lambda i: F.coalesce(F.get(folders, F.lit(i)), F.lit(""))
    rest = F.when(F.size(folders) > 3, F.array_join(F.slice(folders, 4, F.greatest(F.size(folders) - 3, F.lit(1))), "/")).otherwise("")
    return files.withColumns({"data_source": level(0), "filter_1": level(1), "filter_2": level(2), "filter_3": rest, "filename": name, "filetype": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})


def diff(discovered: DataFrame, cataloged: DataFrame) -> DataFrame:
    """file_path and change (new, deleted, modified, unchanged) for every path of either snapshot.

    A file is modified if its size differs, or its time and its hash do; equal size and time are taken as unchanged without a look at the hash.
    """
    old, new = (df.select("file_path", F.struct(*FILE[1:]).alias(name)) for df, name in ((cataloged, "old"), (discovered, "new")))
    both = old.join(new, "file_path", "full_outer")
    resized = F.col("old.file_size") != F.col("new.file_size")
    touched = (F.col("old.date_last_modified") != F.col("new.date_last_modified")) & ~F.col("old.file_hash").eqNullSafe(F.col("new.file_hash"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(resized | touched, "modified").otherwise("unchanged")
    return both.select("file_path", change.alias("change"))


def with_known_hashes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current with the hash of the previous snapshot where size and time are the same, so that only other files need hashing (reused says which)."""
    old = previous.select("file_path", F.col("file_size").alias("old_size"), F.col("date_last_modified").alias("old_time"), F.col("file_hash").alias("old_hash"))
    same = (F.col("file_size") == F.col("old_size")) & (F.abs(F.col("date_last_modified") - F.col("old_time")) < 1e-9)
    joined = current.join(old, "file_path", "left").withColumn("reused", F.coalesce(same, F.lit(False)))
    return joined.withColumn("file_hash", F.when(F.col("reused"), F.col("old_hash")).otherwise(F.col("file_hash"))).drop("old_size", "old_time", "old_hash")


def merge_snapshot(existing: DataFrame, replacement: DataFrame, current_paths: DataFrame, key: str = "file_path") -> DataFrame:
    """The next snapshot of a table: rows of current paths that aren't replaced, and the replacements."""
    kept = existing.join(current_paths.select(key), key, "left_semi").join(replacement.select(key), key, "left_anti")
    return kept.unionByName(replacement)


def newest(candidates: Sequence[DataFrame], key: str = "file_path") -> DataFrame:
    """One row per key from several versions of a table, the later ones in the list first."""
    ranked = [df.withColumn("version", F.lit(i)) for i, df in enumerate(candidates)]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df)
    best = Window.partitionBy(key).orderBy(F.desc("version"))
    return union.withColumn("at", F.row_number().over(best)).filter("at = 1").drop("at", "version")


def missing(current: DataFrame, *having: DataFrame, key: str = "file_path") -> DataFrame:
    """Paths of current that none of the others has."""
    rest = current.select(key)
    for other in having:
        rest = rest.join(other.select(key), key, "left_anti")
    return rest


def with_document_id(df: DataFrame, path: str = "file_path") -> DataFrame:
    return df.withColumn("document_id", stable_id(F.lit("document"), F.col(path)))


def without_paths(rows: DataFrame, paths: DataFrame, key: str = "file_path") -> DataFrame:
    """rows but for those of the paths to delete."""
    return rows.join(paths.select(key).distinct(), key, "left_anti")


def restored(archives: DataFrame, wanted: DataFrame, run: str = "run_id", key: str = "file_path") -> DataFrame:
    """For each wanted path its row of the newest archived run that has it."""
    best = Window.partitionBy(key).orderBy(F.desc(run))
    rows = archives.join(wanted.select(key).distinct(), key, "left_semi")
    return rows.withColumn("at", F.row_number().over(best)).filter("at = 1").drop("at")
