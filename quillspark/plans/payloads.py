"""Queries on payloads, made of documents, events and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import findings, payloads
from quillspark.plans.structure import LINES, lines
from quillspark.sources.tables import table


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" "))).when(F.col("event_id") % 3 == 1, "x1").otherwise(F.lit(None))
    moment = F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return events.select("event_id", payloads.integer(odd, 7).alias("number"), payloads.listed(F.array(F.lit(" a "), "event_type", F.lit(" "), F.lit(None))).alias("listed"), payloads.cell_text(moment).alias("moment"), payloads.vector_literal(F.array(F.lit(0.5), F.col("value"))).alias("vector"))


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stored in two ways, and two malformed ones."""
    n = F.col("s_suppkey")
    row = F.format_string('[{"row_number":%d,"cells":[{"column_number":1,"value":"%s"}]}]', n, "s_name")
    text = F.when(n % 4 == 0, row).when(n % 4 == 1, F.concat(F.lit('{"rows":'), row, F.lit("}"))).when(n % 4 == 2, "[{broken").otherwise("text")
    found = table(spark, sf_dir, "supplier").select("s_suppkey", payloads.stored_rows(text).alias("rows"))
    return found.select("s_suppkey", F.size("rows").alias("n_rows"), F.try_element_at("rows", F.lit(1))["cells"][0]["value"].alias("value"))


def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound payload, one with parts left out, one with a text for a list, and one that is no JSON."""
    n = F.col("s_suppkey")
    sound = F.format_string('{"summary":"%s","keywords":["a","b"],"section_hierarchy":[{"level":1,"title":"T"}]}', "s_name")
    text = F.when(n % 4 == 0, sound).when(n % 4 == 1, '{"usage_description":"u"}').when(n % 4 == 2, '{"summary":"s","keywords":"a"}').otherwise("{")
    found = table(spark, sf_dir, "supplier").select("s_suppkey", payloads.enrichment(text).alias("e"))
    return found.select("s_suppkey", "e.summary", "e.usage_description", F.array_join("e.keywords", ",").alias("keywords"), F.get("e.section_hierarchy", F.lit(0))["title"].alias("heading"))


def classified_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    mode = F.when(n % 5 == 0, "page_like").when(n % 5 == 1, "other").when(n % 5 == 2, "")
    part = table(spark, sf_dir, "part").select("p_partkey", mode.alias("handling_mode"), F.when(n % 3 == 0, F.lit(True)).when(n % 3 == 1, F.lit(False)).alias("contains_dense_table"), F.when(n % 7 != 0, (n % 11) / 8.0).alias("confidence"), F.when(n % 13 == 0, "").otherwise("r").alias("rationale"))
    return payloads.classified(part).select("p_partkey", "mode", "error")


def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sheets; a phrase stands in some titles, and in some contents beyond what counts."""
    title = F.when(F.col("page") % 5 == 0, "Table (Continued)").otherwise("Table")
    content = F.when(F.col("page") % 7 == 0, F.concat(F.lit("see previous "), "content")).when(F.col("page") % 7 == 1, F.concat(F.repeat(F.lit("-"), 1200), F.lit("see previous"))).otherwise("plain")
    found = payloads.needs_prior_context(F.when(F.col("page") % 11 == 0, F.lit(True)), title, F.lit(None).cast("string"), content)
    return lines(spark, sf_dir).select("doc_id", "page", found.alias("needs"))


def dense_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    pages = table(spark, sf_dir, "part").select("p_partkey", F.when(n % 3 == 0, "page_like").otherwise("dense_table_candidate").alias("handling_mode"), F.when(n % 2 == 0, F.array("p_brand", "p_type")).alias("regions"), F.when(n % 5 != 0, F.col("p_name")).alias("region"))
    return payloads.dense_tables(pages).select("p_partkey", F.array_join("dense", ",").alias("dense"))


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.create_map(F.lit("contains_chart"), F.col("s_acctbal") > 5000, F.lit("unknown"), F.lit(True))
    flags = table(spark, sf_dir, "supplier").select("s_suppkey", payloads.page_flags(found).alias("flags"))
    return flags.select("s_suppkey", F.size("flags").alias("n_flags"), F.size(F.map_keys(F.map_filter("flags", lambda k, v: v))).alias("n_true"))


def chunk_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks of sections, some of which are boilerplate, nameless or unknown."""
    name = F.when(F.col("page") % 4 == 0, "References").when(F.col("page") % 4 == 1, "").otherwise("Body")
    chunks = lines(spark, sf_dir).select("doc_id", (F.col("page") - 1).alias("chunk"), (F.col("page") % 6).alias("section"), name.alias("section_name"), F.repeat("content", 30).alias("content"))
    sections = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(2), F.lit(5)).cast("array<long>")).alias("section"), F.concat(F.lit(" about "), "source").alias("overview"))
    found = payloads.chunk_payloads(chunks, sections, ["doc_id"])
    return found.select("doc_id", "chunk", "section_title", "section_overview", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def embedded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what stands for their vector, made once for each different line."""
    rows = lines(spark, sf_dir).select("doc_id", "page", F.col("content").alias("text"))
    vectors = payloads.distinct_texts(rows).withColumn("embedding", F.md5(F.col("text").cast("binary")))
    return payloads.with_embeddings(rows, vectors)


def sources_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 30).alias("index"))
    return payloads.by_index(choices, table(spark, sf_dir, "nation").select(F.col("n_name").alias("data_source")))


def text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers numbered in the order of their columns as texts."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return findings.numbered(rows, payloads.as_text_order(rows), "place")


QUERIES = {f.__name__: f for f in (text_values, stored_rows, enrichments, classified_sheets, prior_context, dense_candidates, page_flags, chunk_payloads, embedded_once, sources_by_index, text_order)}

SQL = {
    "text_values": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 7 END::INTEGER AS number, 'a; ' || event_type AS listed, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment,
  '[0.5,' || value || ']' AS vector FROM events""",
    "stored_rows": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN 1 ELSE 0 END AS n_rows, CASE WHEN s_suppkey % 4 < 2 THEN s_name END AS value FROM supplier",
    "enrichments": """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN '' END AS summary, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'u' END AS usage_description,
  CASE s_suppkey % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' END AS keywords, CASE s_suppkey % 4 WHEN 0 THEN 'T' END AS heading FROM supplier""",
    "classified_sheets": """
WITH m AS (SELECT p_partkey AS n, CASE p_partkey % 5 WHEN 0 THEN 'page_like' WHEN 1 THEN 'other' ELSE CASE p_partkey % 3 WHEN 0 THEN 'dense_table_candidate' WHEN 1 THEN 'page_like' END END AS mode FROM part),
e AS (SELECT n, mode, CASE WHEN mode IS NULL THEN 'no handling mode' WHEN mode = 'other' THEN 'invalid handling mode' WHEN n % 7 = 0 THEN 'no confidence' WHEN n % 11 > 8 THEN 'confidence out of range' WHEN n % 13 = 0 THEN 'no rationale' END AS error FROM m)
SELECT n AS p_partkey, CASE WHEN error IS NULL THEN mode END AS mode, error FROM e""",
    "prior_context": f"WITH {LINES} SELECT doc_id, page, page % 5 = 0 OR page % 7 = 0 OR page % 11 = 0 AS needs FROM lines",
    "dense_candidates": """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat_ws(',', p_brand, p_type) WHEN p_partkey % 5 <> 0 THEN p_name ELSE '' END AS dense FROM part WHERE p_partkey % 3 <> 0""",
    "page_flags": "SELECT s_suppkey, 10 AS n_flags, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS n_true FROM supplier",
    "chunk_payloads": f"""WITH {LINES},
c AS (SELECT doc_id, page, repeat(content, 30) AS content FROM lines WHERE page % 4 >= 2)
SELECT doc_id, page - 1 AS chunk, 'Body' AS section_title, CASE WHEN page % 6 IN (2, 5) THEN coalesce('about ' || source, '') ELSE '' END AS section_overview,
  md5(CASE WHEN length(content) > 4000 THEN rtrim(content[1:3997]) || '...' ELSE content END) AS content_md5 FROM c JOIN documents USING (doc_id)""",
    "embedded_once": f"WITH {LINES} SELECT doc_id, page, content AS text, md5(content) AS embedding FROM lines",
    "sources_by_index": """
WITH s AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation)
SELECT event_id, event_id % 30 AS "index", n_name AS data_source FROM events LEFT JOIN s ON i = event_id % 30""",
    "text_order": "SELECT c_nationkey, c_custkey, c_name, row_number() OVER (ORDER BY c_nationkey::VARCHAR NULLS FIRST, c_custkey::VARCHAR NULLS FIRST, c_name NULLS FIRST) AS place FROM customer",
}
