"""Results of stages as files: one JSON file for each document, written by a data source with commit and abort, and read back with what is malformed set aside.

A write makes a run: every task writes its documents' files `<stem>_<12 digits of the path's SHA-256>.json` into a folder of its own attempt, and the commit
writes one small file that names the folders of the attempts that counted. Only then does the run exist for readers: a killed task or job leaves folders
that no run names, and no half file is ever read. Of several results for one path the newest run's counts.

Files are written and read with pyarrow's file systems (local, HDFS, S3, GCS), in tasks: Spark's text source takes a hundred times as long to open a file, has a task for
every 32 of them, keeps the names of all on the driver, and leaves out names that begin with _ or a dot.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: The folder of the files that say which runs are whole.
RUNS = "_runs"
RUN = "run string, replaces boolean, folders array<string>, files long"
#: Files read by one task, about; bytes of texts and number of rows in a batch.
PORTION, BATCH, LISTED = 5_000, 2_000_000, 1_000
#: Fields of a file record; a record in a discovery file has them all and no others, but for `supported`.
RECORD = T.StructType([T.StructField(n, T.LongType() if n == "file_size" else T.DoubleType() if n == "date_last_modified" else T.StringType()) for n in "data_source filter_1 filter_2 filter_3 filename filetype file_size date_last_modified file_hash file_path".split()])


def file_system(uri: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def result_name(file_path: str) -> str:
    stem = file_path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{stem}_{hashlib.sha256(file_path.encode()).hexdigest()[:12]}.json"


def result_name_of(path: Column) -> Column:
    """The name of a result's file, by the path of its document."""
    last = F.element_at(F.split(path, "/"), -1)
    stem = F.when(last.contains("."), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(path, 256), 1, 12), F.lit(".json"))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class StageResults(DataSource):
    """Sink `stage_results`: rows of (file_path, result) to one file each. Options: path; an overwriting write replaces all earlier runs."""

    @classmethod
    def name(cls) -> str:
        return "stage_results"

    def schema(self) -> str:
        return "file_path string, result string"

    def writer(self, schema: T.StructType, overwrite: bool) -> ResultWriter:
        return ResultWriter(self.options["path"], overwrite)


class ResultWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        folder = f"run={self.run}/part-{task.partitionId()}-{task.taskAttemptId()}"
        store, root = file_system(self.root)
        store.create_dir(f"{root}/{folder}", recursive=True)
        files = 0
        for batch in batches:
            for path, result in zip(batch.column("file_path").to_pylist(), batch.column("result").to_pylist()):
                if path is None:
                    raise ValueError("a result without file_path has no file")
                with store.open_output_stream(f"{root}/{folder}/{result_name(path)}") as out:
                    out.write((result or "\n").encode())  # files of no bytes are left out by Spark's own readers
                files += 1
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        found = [m for m in messages if m is not None]
        store, root = file_system(self.root)
        store.create_dir(f"{root}/{RUNS}", recursive=True)
        text = json.dumps({"run": self.run, "replaces": self.overwrite, "folders": [m.folder for m in found if m.files], "files": sum(m.files for m in found)})
        with store.open_output_stream(f"{root}/{RUNS}/.{self.run}") as out:
            out.write(text.encode())
        store.move(f"{root}/{RUNS}/.{self.run}", f"{root}/{RUNS}/{self.run}.json")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = file_system(self.root)
        if store.get_file_info(f"{root}/run={self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/run={self.run}")


def write_results(results: DataFrame, root: str, key: str = "file_path", replace: bool = False) -> None:
    """One file for each row: the row as JSON. Without replace, results of other paths stay."""
    write_texts(results.select(F.col(key).alias("file_path"), F.to_json(F.struct("*")).alias("result")), root, replace)


def write_texts(texts: DataFrame, root: str, replace: bool = False) -> None:
    """One file for each row of (file_path, result)."""
    texts.sparkSession.dataSource.register(StageResults)
    texts.write.format("stage_results").mode("overwrite" if replace else "append").save(root)


def run_folders(spark: SparkSession, root: str) -> list[str]:
    """The folders of all whole runs that none replaces, one for each task that wrote files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{RUNS}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return []
    runs = spark.read.schema(RUN).json(f"{root}/{RUNS}").withColumn("last", F.max(F.when(F.col("replaces"), F.col("run"))).over(Window.partitionBy()))  # one row a run
    return [r.folder for r in runs.filter("last is null or run >= last").select(F.explode("folders").alias("folder")).collect()]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """folder and file_name of the files of all whole runs; tasks list the folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = file_system(root.rstrip("/"))
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                names = [i.base_name for i in store.get_file_info(fs.FileSelector(f"{path}/{folder}")) if i.type == fs.FileType.File]
                for at in range(0, len(names), LISTED):
                    part = names[at : at + LISTED]
                    yield pa.RecordBatch.from_arrays([pa.array([folder] * len(part), pa.string()), pa.array(part, pa.string())], ["folder", "file_name"])

    return spark.createDataFrame([(f,) for f in run_folders(spark, root)], "folder string").mapInArrow(run, "folder string, file_name string")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """run, file_name and text of the files of all whole runs. Files are dealt to tasks by their names, about PORTION to one, and their texts handed over BATCH bytes at a time."""
    names = listed(spark, root)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-names.count() // PORTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(root.rstrip("/"))
        rows, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], ["run", "file_name", "bytes"])
        for batch in batches:
            for folder, name in zip(batch.column("folder").to_pylist(), batch.column("file_name").to_pylist()):
                with store.open_input_stream(f"{path}/{folder}/{name}", compression=None) as file:
                    rows.append((folder.split("/")[0].removeprefix("run="), name, file.readall()))
                size += len(rows[-1][-1])
                if size >= BATCH or len(rows) >= LISTED:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    texts = names.repartition(tasks, "file_name").mapInArrow(run, "run string, file_name string, bytes binary")
    return texts.select("run", "file_name", F.col("bytes").cast("string").alias("text"))


def parsed(files: DataFrame, schema: T.StructType, key: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Files (run, file_name, text) to results and malformed files.

    Results: the fields of schema, the newest run's (then the last file name's) for each value of key. Malformed files: run, file_name, reason and text.
    """
    kind = F.schema_of_variant(F.try_parse_json("text"))
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    result = lambda text: F.from_json(text, corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = files.withColumn("kind", kind).withColumn("result", result("text"))
    reason = (
        F.when(F.col("kind").isNull(), "no JSON").when(~F.col("kind").startswith("OBJECT"), "no object").when(F.col("result._corrupt").isNotNull(), "fields of other types")
        .when(F.trim(F.coalesce(F.col(f"result.{key}").cast("string"), F.lit(""))) == "", f"no {key}")
    )
    read = read.withColumn("reason", reason)
    newest = read.filter("reason is null").groupBy(F.col(f"result.{key}")).agg(F.max(F.struct("run", "file_name", "text")).alias("newest"))  # texts move once, without what is read from them
    good = newest.select(result("newest.text").alias("result"))
    return good.select(*[F.col(f"result.`{f.name}`") for f in schema.fields]), read.filter("reason is not null").select("run", "file_name", "reason", "text")


def read_results(spark: SparkSession, root: str, schema: T.StructType, key: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """The results in root, and its malformed files."""
    return parsed(read_files(spark, root), schema, key)


def remove_unfinished(root: str, older_than_s: float = 86_400.0) -> list[str]:
    """Removes the folders of runs that no commit has named and that are older than older_than_s (a run's name begins with its time): what failed jobs left; their names."""
    from pyarrow import fs

    store, path = file_system(root.rstrip("/"))
    names = lambda folder: {i.base_name for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))}
    whole = {n.removesuffix(".json") for n in names(f"{path}/{RUNS}")}
    found = [n for n in sorted(names(path)) if n.startswith("run=") and n.removeprefix("run=") not in whole]
    old = [n for n in found if time.time_ns() - int(n[4:].split("-")[0]) >= older_than_s * 1e9]
    for name in old:
        store.delete_dir(f"{path}/{name}")
    return old


def with_counts(results: DataFrame, counts: dict[str, str]) -> DataFrame:
    """results with the sizes of lists: name of the count to name of the list; a list that is null has none."""
    return results.withColumns({name: F.coalesce(F.size(F.when(F.col(items).isNotNull(), F.col(items))), F.lit(0)).cast("long") for name, items in counts.items()})


def discovered(texts: DataFrame, accepted: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Files to process, and rejected records, of discovery results (JSON objects with the lists new and modified).

    A record that isn't an object, or has not exactly the fields of a file record, is rejected, and so is a category that is no list; records of other file types are left out.
    Files: category and the fields of RECORD. Rejected: category, at (its place, null for a whole category) and reason.
    """
    whole = texts.select(F.try_parse_json(text).alias("v"))
    category = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.try_variant_get("v", f"$.{c}", "variant").alias("items")) for c in ("new", "modified")])).alias("c")
    lists = whole.select(category).select("c.category", "c.items", F.schema_of_variant("c.items").startswith("ARRAY").alias("listed")).filter("items is not null")
    items = lists.filter("listed").select("category", F.posexplode(F.try_variant_get("items", "$", "array<variant>")).alias("at", "item"))
    fields = F.array_sort(F.array_except(F.map_keys(F.try_variant_get("item", "$", "map<string,variant>")), F.array(F.lit("supported"))))
    reason = F.when(~F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)), "no object").when(fields != F.array(*map(F.lit, sorted(RECORD.names))), "fields")
    read = items.withColumn("reason", reason)
    files = read.filter("reason is null").select("category", *[F.try_variant_get("item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in RECORD.fields])
    bad = read.filter("reason is not null").select("category", F.col("at").cast("long").alias("at"), "reason")
    rejected = bad.unionByName(lists.filter("not listed").select("category", F.lit(None).cast("long").alias("at"), F.lit("no list").alias("reason")))
    return files.filter(F.col("filetype").isin(*accepted)), rejected
