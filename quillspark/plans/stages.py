"""Queries on results of stages and on snapshots: documents are written as results, one file each, or published as tables, and read again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import isolation
from quillspark.sources import results, snapshots
from quillspark.sources.scratch import shared_folder
from quillspark.sources.tables import table

RESULT = T.StructType().add("file_path", "string").add("content", "string").add("n_chars", "long").add("lines", T.ArrayType(T.StringType())).add("line_count", "long")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a file_path."""
    return table(spark, sf_dir, "documents").withColumn("file_path", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/v1."), F.col("doc_id").cast("string"), F.lit(".txt")))


def stage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a result; those with more than one line are written again by a second run, with a mark at its end. What readers find in the end."""
    root = folder(spark, "results")
    rows = results.with_counts(named(spark, sf_dir).select("file_path", F.col("text").alias("content"), "n_chars", F.split("text", "\n").alias("lines")), {"line_count": "lines"})
    results.write_results(rows, root)
    results.write_results(rows.filter("line_count > 1").withColumn("content", F.concat("content", F.lit("!"))), root)
    found, _ = results.read_results(spark, root, RESULT)
    return found.select("file_path", results.result_name_of(F.col("file_path")).alias("file_name"), "n_chars", "line_count", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def malformed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results put together without escaping: texts of several lines make no JSON. Spanish ones are lists, German ones have no path, French ones a text for a number."""
    root = folder(spark, "results")
    rows = named(spark, sf_dir)
    body = F.concat(F.lit('{"file_path": "'), F.when(F.col("lang") == "de", " ").otherwise(F.col("file_path")), F.lit('", "content": "'), "text", F.lit('", "n_chars": '), F.when(F.col("lang") == "fr", F.lit('"many"')).otherwise(F.col("n_chars").cast("string")), F.lit("}"))
    results.write_texts(rows.select("file_path", F.when(F.col("lang") == "es", F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("result")), root)
    good, bad = results.read_results(spark, root, RESULT)
    said = bad.select("file_name", "reason", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return said.unionByName(good.select(results.result_name_of(F.col("file_path")).alias("file_name"), F.lit("good").alias("reason"), F.md5(F.col("content").cast("binary")).alias("text_md5")))


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discovery text for each document: it is new, and modified. French records lack a hash, Spanish ones have a field more, German ones are text; of documents with several lines modified is no list."""
    rows = named(spark, sf_dir).withColumn("filetype", F.when(F.col("n_chars") % 3 == 0, "exe").when(F.col("n_chars") % 3 == 1, "pdf").otherwise("docx"))
    fields = [F.col("source").alias("data_source"), F.col("lang").alias("filter_1"), F.lit("").alias("filter_2"), F.lit("").alias("filter_3"), F.concat(F.lit("v1."), "doc_id").alias("filename"), "filetype", F.col("n_chars").alias("file_size"), (F.col("doc_id") / 4).alias("date_last_modified")]
    hashed = [F.md5(F.col("text").cast("binary")).alias("file_hash"), "file_path"]
    whole = F.to_json(F.struct(*fields, *hashed, F.lit(True).alias("supported")))
    second = F.when(F.col("lang") == "fr", F.to_json(F.struct(*fields, "file_path"))).when(F.col("lang") == "es", F.to_json(F.struct(*fields, *hashed, F.lit(1).alias("more")))).when(F.col("lang") == "de", F.to_json(F.struct("text"))).otherwise(whole)
    second = F.when(F.col("lang") == "de", F.regexp_extract(second, '(?s)^\\{"text":(.*)\\}$', 1)).otherwise(second)
    modified = F.when(F.col("text").contains("\n"), second).otherwise(F.concat(F.lit("["), second, F.lit("]")))
    return rows.select(F.concat(F.lit('{"new": ['), whole, F.lit('], "modified": '), modified, F.lit("}")).alias("text"))


def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.discovered(discoveries(spark, sf_dir), ["pdf", "docx", "xlsx"])[0]


def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.discovered(discoveries(spark, sf_dir), ["pdf", "docx", "xlsx"])[1].groupBy("category", "reason").agg(F.count("*").alias("n"), F.count("at").alias("n_placed"))


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a snapshot: all documents and labels, then documents without French ones; what readers of each version find, counted and as the manifest has it."""
    store = snapshots.Snapshots(spark, folder(spark, "snapshots"))
    docs = table(spark, sf_dir, "documents")
    first = store.publish({"documents": docs, "labels": table(spark, sf_dir, "labels")})
    second = store.publish({"documents": docs.filter("lang <> 'fr'")}, base=first)
    found = None
    for version in (first, second):
        counts = store.counts(version)
        for name, size in (("documents", F.sum("n_chars")), ("labels", F.sum("quality").cast("long"))):
            one = store.read(name, version).agg(F.count("*").alias("n"), size.alias("total")).select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("table_name"), "n", "total")
            found = one if found is None else found.unionByName(one)
        found = found if version == first else found.join(store.counts(first).unionByName(counts), ["version", "table_name"])
    return found.select("version", "table_name", "n", "total", "row_count")


def checked(row: dict) -> dict:
    """The number in an event's properties; values above 199.5 can't be dealt with."""
    if row["value"] is not None and row["value"] > 199.5:
        raise ValueError("too large")
    return {"event_id": row["event_id"], "k": json.loads(row["props"])["k"]}


def isolated_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user: users with an event that can't be dealt with have an error, the others their results."""
    kind = T.StructType().add("event_id", "long").add("k", "long")
    good, bad = isolation.isolated(table(spark, sf_dir, "events").select("user_id", "event_id", "value", "props"), "user_id", checked, kind)
    sums = good.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("k")).withColumn("error", F.lit(None).cast("string"))
    return sums.unionByName(bad.select("user_id", F.col("n_failed").alias("n"), F.lit(None).cast("long").alias("k"), "error"))


QUERIES = {f.__name__: f for f in (isolated_users, stage_results, malformed_results, discovered_files, rejected_records, snapshot_history)}

PATHS = """
paths AS (SELECT *, '/' || source || '/' || lang || '/v1.' || doc_id || '.txt' AS file_path FROM documents)"""

DISCOVERED = f"""{PATHS},
records AS (SELECT *, CASE n_chars % 3 WHEN 0 THEN 'exe' WHEN 1 THEN 'pdf' ELSE 'docx' END AS filetype FROM paths)"""

SQL = {
    "isolated_users": """
WITH e AS (SELECT user_id, value > 199.5 AS bad, json_extract(props, '$.k')::BIGINT AS k FROM events),
u AS (SELECT user_id, count(*) AS n, count(*) FILTER (bad) AS n_bad, sum(k)::BIGINT AS k FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN n_bad > 0 THEN n_bad ELSE n END AS n, CASE WHEN n_bad = 0 THEN k END AS k, CASE WHEN n_bad > 0 THEN 'ValueError: too large' END AS error FROM u""",
    "stage_results": f"""WITH {PATHS}
SELECT file_path, 'v1.' || doc_id || '_' || left(sha256(file_path), 12) || '.json' AS file_name, n_chars, len(string_split(text, chr(10)))::BIGINT AS line_count,
  md5(CASE WHEN contains(text, chr(10)) THEN text || '!' ELSE text END) AS content_md5 FROM paths""",
    "malformed_results": f"""WITH {PATHS},
bodies AS (
  SELECT *, '{{"file_path": "' || CASE lang WHEN 'de' THEN ' ' ELSE file_path END || '", "content": "' || text || '", "n_chars": ' || CASE lang WHEN 'fr' THEN '"many"' ELSE n_chars::TEXT END || '}}' AS body FROM paths),
files AS (SELECT *, CASE lang WHEN 'es' THEN '[' || body || ']' ELSE body END AS result FROM bodies),
told AS (
  SELECT *, CASE WHEN NOT json_valid(result) THEN 'no JSON' WHEN lang = 'es' THEN 'no object' WHEN lang = 'fr' THEN 'fields of other types' WHEN lang = 'de' THEN 'no file_path' ELSE 'good' END AS reason FROM files)
SELECT 'v1.' || doc_id || '_' || left(sha256(file_path), 12) || '.json' AS file_name, reason, md5(CASE reason WHEN 'good' THEN json_extract_string(result, '$.content') ELSE result END) AS text_md5 FROM told""",
    "discovered_files": f"""WITH {DISCOVERED}
SELECT category, source AS data_source, lang AS filter_1, '' AS filter_2, '' AS filter_3, 'v1.' || doc_id AS filename, filetype, n_chars AS file_size, doc_id / 4 AS date_last_modified, md5(text) AS file_hash, file_path
FROM records, (VALUES ('new'), ('modified')) c(category)
WHERE filetype <> 'exe' AND (category = 'new' OR (lang = 'en' AND NOT contains(text, chr(10))))""",
    "rejected_records": f"""WITH {DISCOVERED},
bad AS (
  SELECT CASE WHEN contains(text, chr(10)) THEN 'no list' WHEN lang = 'de' THEN 'no object' WHEN lang IN ('fr', 'es') THEN 'fields' END AS reason FROM records)
SELECT 'modified' AS category, reason, count(*) AS n, count(*) FILTER (reason <> 'no list') AS n_placed FROM bad WHERE reason IS NOT NULL GROUP BY reason""",
    "snapshot_history": """
SELECT version::BIGINT AS version, 'documents' AS table_name, count(*) AS n, sum(n_chars)::BIGINT AS total, count(*) AS row_count FROM documents, (VALUES (1), (2)) v(version) WHERE version = 1 OR lang <> 'fr' GROUP BY version
UNION ALL SELECT version, 'labels', count(*), sum(quality)::BIGINT, count(*) FROM labels, (VALUES (1), (2)) v(version) GROUP BY version""",
}
