"""Queries on sources, filters, selections, groups of chunks and pages of tables; a registry made of nation, and choices made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import catalog, registry, retrieval, selection
from quillspark.plans.structure import STARTS, in_sections
from quillspark.sources.tables import table


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return nation.select(
        F.col("n_name").alias("data_source"), (key % 4 != 0).alias("enabled"), F.when(key % 2 == 0, "Year").alias("filter_1_label"), F.when(key % 3 == 0, "Bank").alias("filter_2_label"),
        F.lit(None).cast("string").alias("filter_3_label"), F.when(key % 5 == 0, F.array(F.lit("title"))).alias("metadata_context_fields"), F.lit(None).cast("array<string>").alias("sample_questions"), "n_nationkey",
    )


def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.enabled_sources(registered(spark, sf_dir))
    return found.select("data_source", "filter_1_label", "filter_2_label", "filter_3_label", F.array_join("metadata_context_fields", ",").alias("context"), F.size("sample_questions").alias("n_questions"))


def sources_to_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a filter that isn't given, and the filters that are in force once 2024 is found for filter_1."""
    given = registered(spark, sf_dir).filter("n_nationkey % 3 <> 1").select("data_source", F.create_map(F.lit("filter_1"), F.when(F.col("n_nationkey") % 6 == 0, "").otherwise("2023"), F.lit("filter_9"), F.lit("x")).alias("filters"))
    found = selection.needs_resolution(selection.enabled_sources(registered(spark, sf_dir)), given)
    merged = selection.merged_filters(F.col("given"), F.create_map(F.lit("filter_1"), F.lit("2024")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return found.select("data_source", F.array_join("levels", ",").alias("levels"), text.alias("filters"))


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.missing_fields(registered(spark, sf_dir), ["data_source", "filter_1_label", "filter_2_label"])
    return found.select("data_source", F.array_join("missing", ",").alias("missing"))


def known_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of source and segment, every third one of a source that isn't registered."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    combos = rows.select(F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")).alias("data_source"), "c_mktsegment").distinct()
    return selection.of_known_sources(combos, selection.enabled_sources(registered(spark, sf_dir)))


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices by index from batches of events, the first ten different files of each user."""
    events = table(spark, sf_dir, "events")
    choices = events.select("user_id", F.col("event_id").alias("at"), (F.floor("value") % 40 + 1).cast("long").alias("index"))
    offered = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))).alias("index")).withColumn("document_id", F.col("index") * 7 % 30)
    return selection.selected(selection.picked_by_index(choices, offered, ["user_id"]), ["user_id"], "document_id", ["at"], 10)


def research_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return registered(spark, sf_dir).select("data_source", selection.research_path(key % 2 == 0, key % 5 == 0, key % 3 == 0).alias("path"))


def combined_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from metadata (but for researched documents) and from files, with the document's name by its id."""
    from quillspark.operators import findings

    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    metadata = labels.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("finding"))
    files = labels.filter("quality = 1").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("finding"))
    every = selection.combined_findings([findings.without_superseded(metadata, files), files])
    return every.join(docs.select(F.col("doc_id").alias("document_id"), F.concat_ws("/", "source", "lang").alias("document_name")), "document_id")


def chunk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks: their section, and every third one without a subsection; some ids occur twice."""
    rows = in_sections(spark, sf_dir)
    sub = F.when(F.col("page") % 3 != 0, F.col("page") % 2)
    chunks = rows.select(
        "doc_id", F.when(F.col("page") % 7 == 0, "").otherwise(F.floor(F.col("page") / 2).cast("string")).alias("chunk_id"), "page", F.col("page").alias("chunk"), F.when(F.col("section") % 5 != 0, F.col("section")).alias("section"),
        F.col("section_title").alias("section_name"), sub.alias("subsection"), F.col("second").alias("subsection_name"), F.col("content").alias("path"),
    )
    return retrieval.chunk_groups(chunks, ["doc_id"]).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted ids of documents that aren't there."""
    wanted = table(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("doc_id"))
    return retrieval.documents_by_id(table(spark, sf_dir, "documents"), wanted, "doc_id")[1]


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"nation": table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "region": table(spark, sf_dir, "region").select("r_regionkey", "r_name")}
    found = registry.table_pages(tables, {"nation": ["n_nationkey"], "region": ["r_regionkey"]}, 4, 2)
    return found.select("table_name", "row_count", "columns", F.array_join("rows", ";").alias("rows"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"))
    return registry.usage_totals(calls, ["event_type"], 0.5, 1.5)


def custom_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    details = F.create_map(F.lit("status"), F.lit("ok"), F.lit("kind"), F.col("event_type"), F.lit("tokens"), F.lit("5"))
    answer = F.concat(F.lit(" "), F.when(F.col("event_id") % 3 == 0, "Yes").when(F.col("event_id") % 3 == 1, "TRUE ").otherwise("no"))
    return events.select("event_id", registry.custom_metadata(details, ["status", "tokens"]).alias("metadata"), registry.flag(answer).alias("flag"))


def deleted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), "n_chars")
    return catalog.without_paths(docs, docs.filter("n_chars % 3 = 0"))


def restored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted documents from the newest of the archived runs that have them."""
    events = table(spark, sf_dir, "events")
    archives = events.select((F.col("event_id") % 12).alias("run_id"), F.col("user_id").cast("string").alias("file_path"), "event_id").groupBy("run_id", "file_path").agg(F.max("event_id").alias("event_id"))
    return catalog.restored(archives, archives.filter("cast(file_path as long) % 2 = 0"))


QUERIES = {f.__name__: f for f in (enabled_sources, sources_to_resolve, missing_fields, known_combinations, selected_files, research_paths, combined_findings, chunk_groups, missing_documents, table_pages, usage_totals, custom_metadata, deleted_paths, restored_versions)}

SQL = {
    "enabled_sources": """
SELECT n_name AS data_source, CASE WHEN n_nationkey % 2 = 0 THEN 'Year' ELSE '' END AS filter_1_label, CASE WHEN n_nationkey % 3 = 0 THEN 'Bank' ELSE '' END AS filter_2_label, '' AS filter_3_label,
  CASE WHEN n_nationkey % 5 = 0 THEN 'title' ELSE 'document_summary' END AS context, 0 AS n_questions FROM nation WHERE n_nationkey % 4 <> 0""",
    "sources_to_resolve": """
WITH s AS (SELECT n_name, n_nationkey % 2 = 0 AS f1, n_nationkey % 3 = 0 AS f2, n_nationkey % 3 <> 1 AS has, n_nationkey % 6 = 0 AS blank FROM nation WHERE n_nationkey % 4 <> 0)
SELECT n_name AS data_source, concat_ws(',', CASE WHEN f1 THEN 'filter_1' END, CASE WHEN f2 THEN 'filter_2' END) AS levels, 'filter_1=2024' || CASE WHEN has THEN ',filter_9=x' ELSE '' END AS filters
FROM s WHERE f2 OR f1 AND (NOT has OR blank)""",
    "missing_fields": """
SELECT n_name AS data_source, concat_ws(',', CASE WHEN n_nationkey % 2 <> 0 THEN 'filter_1_label' END, CASE WHEN n_nationkey % 3 <> 0 THEN 'filter_2_label' END) AS missing FROM nation WHERE n_nationkey % 6 <> 0""",
    "known_combinations": "SELECT DISTINCT n_name AS data_source, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0 AND n_nationkey % 4 <> 0",
    "selected_files": """
WITH c AS (SELECT user_id, event_id, floor(value)::BIGINT % 40 + 1 AS i FROM events),
f AS (SELECT user_id, i * 7 % 30 AS document_id, min(event_id) AS first FROM c WHERE i <= 30 GROUP BY ALL)
SELECT user_id, document_id, row_number() OVER (PARTITION BY user_id ORDER BY first, document_id) AS rank FROM f QUALIFY rank <= 10""",
    "research_paths": """
SELECT n_name AS data_source, CASE WHEN n_nationkey % 5 = 0 THEN 'A' WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 THEN 'C' ELSE 'B' END AS path FROM nation""",
    "combined_findings": """
SELECT doc_id AS document_id, CASE WHEN quality = 1 THEN 'toxic ' || toxic ELSE 'quality ' || coalesce(quality::VARCHAR, '') END AS finding, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS part, concat_ws('/', source, lang) AS document_name
FROM labels JOIN documents USING (doc_id)""",
    "chunk_groups": f"""WITH {STARTS},
c AS (
  SELECT doc_id, CASE WHEN page % 7 <> 0 THEN (page // 2)::VARCHAR END AS id, page, CASE WHEN section % 5 <> 0 THEN section END AS section, nullif(section_title, '') AS name, CASE WHEN page % 3 <> 0 THEN page % 2 END AS sub,
    nullif(second, '') AS sub_name, nullif(content, '') AS path FROM placed),
names AS (SELECT doc_id, section, arg_min(name, page) FILTER (name IS NOT NULL) AS section_name, arg_min(path, page) FILTER (path IS NOT NULL) AS section_path FROM c GROUP BY ALL),
own AS (SELECT doc_id, section, sub, arg_min(sub_name, page) FILTER (sub_name IS NOT NULL) AS sub_name, arg_min(path, page) FILTER (path IS NOT NULL) AS own_path FROM c GROUP BY ALL),
once AS (SELECT doc_id, section, sub, id, min(page) AS page FROM c WHERE id IS NOT NULL GROUP BY ALL),
g AS (SELECT doc_id, section, sub, string_agg(id, ',' ORDER BY page) AS chunk_ids FROM once GROUP BY ALL)
SELECT g.doc_id, g.section, g.sub AS subsection, section_name, CASE WHEN g.sub IS NOT NULL THEN sub_name END AS subsection_name, CASE WHEN g.sub IS NULL THEN section_path ELSE own_path END AS path,
  CASE WHEN g.sub IS NULL THEN 'document_full' ELSE 'subsection' END AS level, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.section NULLS LAST, coalesce(g.sub, -1)) AS place, chunk_ids
FROM g JOIN own o ON o.doc_id = g.doc_id AND o.section IS NOT DISTINCT FROM g.section AND o.sub IS NOT DISTINCT FROM g.sub JOIN names n ON n.doc_id = g.doc_id AND n.section IS NOT DISTINCT FROM g.section""",
    "missing_documents": "SELECT DISTINCT doc_id * 3 AS doc_id FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)",
    "table_pages": """
SELECT 'nation' AS table_name, 25 AS row_count, 'n_nationkey,n_name' AS "columns", (SELECT string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ';' ORDER BY n_nationkey) FROM nation WHERE n_nationkey BETWEEN 2 AND 5) AS "rows"
UNION ALL SELECT 'region', 5, 'r_regionkey,r_name', (SELECT string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ';' ORDER BY r_regionkey) FROM region WHERE r_regionkey BETWEEN 2 AND 5)""",
    "usage_totals": """
SELECT event_type, sum(floor(value)::BIGINT)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS output_tokens, round(sum(floor(value) / 1000 * 0.5::DOUBLE + (event_id % 100) / 1000 * 1.5::DOUBLE), 6) AS cost FROM events GROUP BY 1""",
    "custom_metadata": """SELECT event_id, '{"kind":"' || event_type || '"}' AS metadata, event_id % 3 < 2 AS flag FROM events""",
    "deleted_paths": "SELECT concat_ws('/', source, doc_id) AS file_path, n_chars FROM documents WHERE n_chars % 3 <> 0 OR n_chars IS NULL",
    "restored_versions": """
WITH a AS (SELECT event_id % 12 AS run_id, user_id, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT run_id, user_id::VARCHAR AS file_path, event_id FROM a WHERE user_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run_id DESC) = 1""",
}
