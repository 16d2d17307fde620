"""Catalog queries; two snapshots are made from documents, with sizes, times and hashes that differ by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import stable_id
from quillspark.operators import catalog
from quillspark.sources.tables import table


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(previous, current)."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path")
    previous = docs.filter("doc_id % 7 <> 0").select(path, F.col("n_chars").alias("file_size"), (F.col("doc_id") % 100).cast("double").alias("date_last_modified"), F.md5(F.col("text").cast("binary")).alias("file_hash"))
    size = F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    time = (F.col("doc_id") % 100 + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("double")
    hashed = F.md5(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "x").otherwise("")).cast("binary"))
    current = docs.filter("doc_id % 11 <> 0").select(path, size.alias("file_size"), time.alias("date_last_modified"), hashed.alias("file_hash"))
    return previous, current


SNAPSHOTS = """
paths AS (SELECT *, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS file_path FROM documents),
previous AS (
  SELECT file_path, n_chars AS file_size, (doc_id % 100)::DOUBLE AS date_last_modified, md5(text) AS file_hash FROM paths WHERE doc_id % 7 <> 0),
cur AS (
  SELECT file_path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS file_size,
         (doc_id % 100 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS date_last_modified,
         md5(text || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END) AS file_hash FROM paths WHERE doc_id % 11 <> 0),
changes AS (
  SELECT coalesce(p.file_path, c.file_path) AS file_path,
    CASE WHEN p.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted'
         WHEN p.file_size <> c.file_size OR (p.date_last_modified <> c.date_last_modified AND p.file_hash <> c.file_hash) THEN 'modified'
         ELSE 'unchanged' END AS change
  FROM previous p FULL JOIN cur c ON p.file_path = c.file_path)"""


def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous, current = snapshots(spark, sf_dir)
    return catalog.diff(current, previous)


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous, current = snapshots(spark, sf_dir)
    return catalog.with_known_hashes(current, previous)


def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous, current = snapshots(spark, sf_dir)
    changed = catalog.diff(current, previous).filter("change in ('new', 'modified')")
    replacement = current.join(changed.select("file_path"), "file_path", "left_semi")
    return catalog.merge_snapshot(previous, replacement, current)


def archived_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous, current = snapshots(spark, sf_dir)
    return catalog.newest([previous, current])


def missing_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return catalog.missing(docs, labels.filter("toxic = 0"), key="doc_id")


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", stable_id(F.lit("document"), F.col("source"), F.col("lang"), F.col("doc_id")).alias("document_id"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = pages.select("page_id", F.regexp_replace("url", r"^https?://", "").alias("relative_path"))
    return catalog.path_dimensions(files).select("page_id", "data_source", "filter_1", "filter_2", "filter_3", "filename", "filetype")


QUERIES = {f.__name__: f for f in (catalog_diff, diff_counts, known_hashes, snapshot_merge, archived_versions, missing_snapshot, stable_ids, path_parts)}

SQL = {
    "catalog_diff": f"WITH {SNAPSHOTS} SELECT file_path, change FROM changes",
    "diff_counts": f"WITH {SNAPSHOTS} SELECT change, count(*) AS n FROM changes GROUP BY change",
    "known_hashes": f"""WITH {SNAPSHOTS}
SELECT c.file_path, c.file_size, c.date_last_modified,
  CASE WHEN p.file_size = c.file_size AND abs(p.date_last_modified - c.date_last_modified) < 1e-9 THEN p.file_hash ELSE c.file_hash END AS file_hash,
  coalesce(p.file_size = c.file_size AND abs(p.date_last_modified - c.date_last_modified) < 1e-9, false) AS reused
FROM cur c LEFT JOIN previous p USING (file_path)""",
    "snapshot_merge": f"""WITH {SNAPSHOTS}
SELECT p.* FROM previous p JOIN changes x USING (file_path) WHERE change = 'unchanged'
UNION ALL SELECT c.* FROM cur c JOIN changes x USING (file_path) WHERE change IN ('new', 'modified')""",
    "archived_versions": f"WITH {SNAPSHOTS} SELECT * FROM cur UNION ALL SELECT p.* FROM previous p ANTI JOIN cur c USING (file_path)",
    "missing_snapshot": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)",
    "stable_ids": "SELECT doc_id, sha256('document||' || source || '||' || lang || '||' || doc_id) AS document_id FROM documents",
    "path_parts": r"""
WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages),
f AS (SELECT page_id, parts[:len(parts) - 1] AS folders, parts[len(parts)] AS filename FROM p)
SELECT page_id, coalesce(folders[1], '') AS data_source, coalesce(folders[2], '') AS filter_1, coalesce(folders[3], '') AS filter_2,
  CASE WHEN len(folders) > 3 THEN array_to_string(folders[4:], '/') ELSE '' END AS filter_3, filename,
  lower(regexp_extract(filename, '\.([^.]*)$', 1)) AS filetype
FROM f""",
}
