"""Vector retrieval queries; a vector's document is its label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine
from quillspark.operators import chunk_store, findings, retrieval
from quillspark.plans.structure import LINES, lines
from quillspark.sources.tables import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its cosine to the vector of vec_id 0 (one row, so broadcast is bounded)."""
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").select(F.col("embedding").alias("query_vector")).limit(1)
    score = F.round(cosine(F.col("embedding"), F.col("query_vector")), 6)
    return vectors.filter("embedding is not null").crossJoin(F.broadcast(query)).select("vec_id", "label", score.alias("score"))


def topk_global_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(scored(spark, sf_dir).filter(F.col("label").isin(1, 2, 3)), 5, "vec_id")


def topk_chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k_by(scored(spark, sf_dir), "label", 3, "vec_id").select("label", "rank", "vec_id", "score")


def rank_documents_with_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (labels) by their best chunk, with their number of chunks."""
    rows = scored(spark, sf_dir)
    per = rows.groupBy("label").agg(F.max("score").alias("best"), F.count("*").alias("n_chunks"))
    return findings.numbered(per, [F.desc("best"), "label"], "document_index")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    return scored(spark, sf_dir).withColumn("chunk", (F.row_number().over(order) - 1).cast("long"))


def neighbor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    hits = retrieval.top_k_by(rows, "label", 3, "vec_id")
    return retrieval.neighbours(rows, hits, ["label"], "chunk", 2).select("label", "chunk", "vec_id")


def event_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("user_id", (F.col("event_id") % 1000).alias("start"), (F.col("event_id") % 1000 + F.floor("value") % 20).alias("end"))


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.merged_ranges(event_ranges(spark, sf_dir), ["user_id"])


def page_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 500).alias("page"))
    return retrieval.gap_pages(pages, ["user_id"], "page", 2)


def placed(rows: DataFrame) -> DataFrame:
    """Lines as chunks: rows (document, page, ...) with chunk, section (of 8 lines), subsection (of 4), and the pages of both."""
    rows = rows.withColumns({"chunk": F.col("page") - 1, "section": F.floor((F.col("page") - 1) / 8) + 1, "subsection": F.floor((F.col("page") - 1) % 8 / 4)})
    per = F.count("*").over(Window.partitionBy("document", "section"))
    sub = F.count("*").over(Window.partitionBy("document", "section", "subsection"))
    return rows.withColumns({"section_pages": per, "subsection_pages": sub})


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, documents, seeds) of the lines of documents: sections of 8 lines, subsections of 4, a seed wherever the line has 13 letters modulo 17."""
    rows = lines(spark, sf_dir).select(F.col("doc_id").alias("document"), "page", F.length("content").alias("size"))
    chunks = placed(rows).select("document", "chunk", "page", "section", "subsection", "size", "section_pages", "subsection_pages")
    documents = rows.groupBy("document").agg(F.max("page").alias("page_count"))
    return chunks.drop("size"), documents, chunks.filter("size % 17 = 13").select("document", "chunk")


def hierarchical_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, documents, seeds = hierarchy(spark, sf_dir)
    return chunk_store.expanded(chunks, documents, seeds, full=3, section=6, subsection=3).select("document", "chunk", "page", "expansion_level")


def expansion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, documents, seeds = hierarchy(spark, sf_dir)
    return retrieval.expansion_metrics(chunk_store.expanded(chunks, documents, seeds, full=3, section=6, subsection=3), seeds)


SCORED = """
scored AS (
  SELECT e.vec_id, e.label, round(
    list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda p: p[1] * p[2]))
    / (sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x)))
       * sqrt(list_sum(list_transform(q.embedding::DOUBLE[], lambda x: x * x)))), 6) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk,
         row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scored)"""

EXPANDED = f"""
{LINES},
parts AS (
  SELECT doc_id AS document, page - 1 AS chunk, page, (page - 1) // 8 + 1 AS section, (page - 1) % 8 // 4 AS subsection, length(content) % 17 = 13 AS seed FROM lines),
chunks AS (
  SELECT *, count(*) OVER (PARTITION BY document, section) AS section_pages, count(*) OVER (PARTITION BY document, section, subsection) AS subsection_pages,
         count(*) OVER (PARTITION BY document) AS page_count, max(seed::INT) OVER (PARTITION BY document) = 1 AS asked FROM parts),
hits AS (
  SELECT *, CASE WHEN section_pages <= 6 THEN 2 WHEN subsection_pages <= 3 AND subsection > 0 THEN 3 ELSE 4 END AS way FROM chunks WHERE seed AND page_count > 3),
ways AS (
  SELECT document, chunk, page, section, 1 AS level FROM chunks WHERE page_count <= 3 AND asked
  UNION ALL SELECT c.document, c.chunk, c.page, c.section, 2 FROM chunks c SEMI JOIN (SELECT * FROM hits WHERE way = 2) h ON c.document = h.document AND c.section = h.section
  UNION ALL SELECT c.document, c.chunk, c.page, c.section, 3 FROM chunks c SEMI JOIN (SELECT * FROM hits WHERE way = 3) h ON c.document = h.document AND c.section = h.section AND c.subsection = h.subsection
  UNION ALL SELECT c.document, c.chunk, c.page, c.section, 4 FROM chunks c SEMI JOIN (SELECT * FROM hits WHERE way = 4) h ON c.document = h.document AND c.section = h.section AND c.chunk BETWEEN h.chunk - 2 AND h.chunk + 2),
found_pages AS (
  SELECT document, page, lead(page) OVER (PARTITION BY document ORDER BY page) AS following FROM (SELECT DISTINCT document, page FROM ways WHERE level > 1)),
expanded AS (
  SELECT document, chunk, page, section, min(level) AS level FROM (
    SELECT * FROM ways UNION ALL
    SELECT c.document, c.chunk, c.page, c.section, 5 FROM chunks c SEMI JOIN (SELECT * FROM found_pages WHERE following - page BETWEEN 2 AND 3) g
      ON c.document = g.document AND c.page > g.page AND c.page < g.following)
  GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (topk_global_cosine, topk_chunks_per_document, rank_documents_with_chunk_count, neighbor_expansion, merge_ranges, page_gap_fill, hierarchical_expansion, expansion_metrics)}

SQL = {
    "topk_global_cosine": f"WITH {SCORED} SELECT vec_id, label, score FROM scored WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 5",
    "topk_chunks_per_document": f"WITH {SCORED} SELECT label, rank, vec_id, score FROM numbered WHERE rank <= 3",
    "rank_documents_with_chunk_count": f"""WITH {SCORED}
SELECT *, row_number() OVER (ORDER BY best DESC, label) AS document_index FROM (SELECT label, max(score) AS best, count(*) AS n_chunks FROM scored GROUP BY label)""",
    "neighbor_expansion": f"""WITH {SCORED}
SELECT n.label, n.chunk, n.vec_id FROM numbered n SEMI JOIN (SELECT * FROM numbered WHERE rank <= 3) h ON n.label = h.label AND n.chunk BETWEEN h.chunk - 2 AND h.chunk + 2""",
    "merge_ranges": """
WITH r AS (SELECT user_id, event_id % 1000 AS "start", event_id % 1000 + floor(value)::BIGINT % 20 AS "end" FROM events),
m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r),
i AS (SELECT *, sum(CASE WHEN upto IS NULL OR "start" > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY user_id, island""",
    "page_gap_fill": """
WITH p AS (SELECT DISTINCT user_id, event_id % 500 AS page FROM events),
n AS (SELECT *, lead(page) OVER (PARTITION BY user_id ORDER BY page) AS following FROM p)
SELECT user_id, unnest(range(page + 1, following)) AS page FROM n WHERE following - page - 1 BETWEEN 1 AND 2""",
    "hierarchical_expansion": f"""WITH {EXPANDED}
SELECT document, chunk, page, (['full', 'primary', 'subsection', 'neighbor', 'gap'])[level] AS expansion_level FROM expanded""",
    "expansion_metrics": f"""WITH {EXPANDED}
SELECT e.document, count(DISTINCT e.chunk) AS n_chunks, count(DISTINCT e.page) AS n_pages, count(DISTINCT e.section) AS n_sections,
  any_value(s.n) AS n_seeds, round(count(DISTINCT e.chunk) / any_value(s.n), 2) AS ratio
FROM expanded e JOIN (SELECT document, count(*) AS n FROM chunks WHERE seed GROUP BY document) s USING (document) GROUP BY e.document""",
}
