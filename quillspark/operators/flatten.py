"""Nested results of a document to the rows of the document tables, with deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import stable_id, stripped

SUMMARY = "struct<overview:string,key_topics:array<string>,key_metrics:map<string,string>,key_findings:array<string>,notable_facts:array<string>,is_fallback:boolean>"
SUBSECTION = f"struct<subsection_number:int,title:string,page_start:int,page_end:int,summary:{SUMMARY}>"
SECTION = f"struct<section_number:int,title:string,page_start:int,page_end:int,page_count:int,summary:{SUMMARY},subsections:array<{SUBSECTION}>>"
CHUNK = "struct<chunk_number:int,page_number:int,content:string,primary_section_number:int,primary_section_name:string,subsection_number:int,subsection_name:string,hierarchy_path:string,embedding_prefix:string,embedding:array<float>>"
#: A finalized document.
DOCUMENT = (
    "file_path string, file_name string, filetype string, document_summary string, structure_type string, structure_confidence string, degradation_signals array<string>, "
    f"sections array<{SECTION}>, chunks array<{CHUNK}>, "
    "dense_tables array<struct<region_id:string,page_title:string,used_range:string,raw_rows:string>>, "
    "keywords array<struct<keyword:string,page_number:int,section:string,embedding:array<float>>>, "
    "metrics array<struct<metric_name:string,page_number:int,region_id:string,periods_available:array<string>,embedding:array<float>>>, "
    "sheet_summaries array<struct<sheet_index:int,sheet_name:string,handling_mode:string,summary:string>>, "
    "context_chains array<struct<sheet_index:int,sheet_name:string,context_sheet_indices:array<int>>>"
)


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def exploded(docs: DataFrame, field: str, kind: str, *keys: str) -> DataFrame:
    """One row per element of a field, with an id from the path and the element's keys; rows whose id repeats are one."""
    rows = docs.select("document_id", "file_path", F.explode(field).alias("item")).select("document_id", "file_path", "item.*")
    identity = stable_id(F.lit(kind), F.col("file_path"), *[F.col(k) for k in keys])
    return rows.withColumn(f"{kind}_id", identity).dropDuplicates([f"{kind}_id"])


def tables(docs: DataFrame) -> dict[str, DataFrame]:
    """All tables of finalized documents (DOCUMENT)."""
    docs = docs.withColumn("document_id", stable_id(F.lit("document"), F.col("file_path")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    sections = exploded(docs, "sections", "section", "section_number")
    subs = sections.select("document_id", "file_path", "section_id", "section_number", F.explode("subsections").alias("item")).select("document_id", "file_path", "section_id", "section_number", "item.*")
    subs = subs.withColumn("subsection_id", stable_id(F.lit("subsection"), F.col("file_path"), F.col("section_number"), F.col("subsection_number")))
    n_sub = F.aggregate(F.coalesce("sections", F.array()), F.lit(0), lambda n, s: n + F.coalesce(F.size(s["subsections"]), F.lit(0))) if "sections" in docs.columns else F.lit(0)
    documents = docs.select(
        "document_id", "file_path", text(F.col("file_name")).alias("file_name"), text(F.col("filetype")).alias("filetype"), text(F.col("document_summary")).alias("document_summary"),
        text(F.col("structure_type")).alias("structure_type"), text(F.col("structure_confidence")).alias("structure_confidence"), "degradation_signals",
        size("sections").alias("section_count"), n_sub.alias("subsection_count"), size("chunks").alias("chunk_count"), size("dense_tables").alias("dense_table_count"),
    )
    return {
        "documents": documents,
        "document_sections": sections.withColumn("is_fallback", F.coalesce("summary.is_fallback", F.lit(False))).drop("subsections"),
        "document_subsections": subs.dropDuplicates(["subsection_id"]),
        "document_chunks": exploded(docs, "chunks", "chunk", "chunk_number"),
        "document_dense_tables": exploded(docs, "dense_tables", "dense_table", "region_id", "used_range"),
        "document_keywords": exploded(docs, "keywords", "keyword", "keyword", "page_number"),
        "document_metrics": exploded(docs, "metrics", "metric", "metric_name", "page_number", "region_id"),
        "document_sheet_summaries": exploded(docs, "sheet_summaries", "sheet_summary", "sheet_index").withColumn("handling_mode", F.coalesce(F.nullif(stripped(F.col("handling_mode")), F.lit("")), F.lit("page_like"))),
        "document_sheet_context_chains": exploded(docs, "context_chains", "context_chain", "sheet_index"),
    }
