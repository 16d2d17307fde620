"""Structure queries; the pages of a document are its lines, and a page's heading tells how many strings it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import structure
from quillspark.sources.tables import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pages_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with headings that tell their numbers of strings and of characters; some have none."""
    words, size = F.size(F.split("content", " ", -1)) % 4, F.length("content") % 3
    return lines(spark, sf_dir).withColumn("title", F.when(words == 0, "").otherwise(F.concat(F.lit("Part "), words.cast("string")))).withColumn("second", F.when(size == 0, "").otherwise(F.concat(F.lit("sub "), size.cast("string"))))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def primary_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_boundaries(titled(spark, sf_dir), ["doc_id"])


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = titled(spark, sf_dir)
    counts = pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    starts = structure.heading_boundaries(pages, ["doc_id"]).join(counts, "doc_id")
    return structure.intervals(starts, ["doc_id"], F.col("page_count"))


def section_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir)


def in_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.section_of_pages(titled(spark, sf_dir), sections(spark, sf_dir), ["doc_id"])


def expand_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of the sections that have a page of over 500 characters."""
    pages = in_sections(spark, sf_dir).select("doc_id", "page", "section", F.length("content").alias("size"))
    hits = pages.filter("size > 500").select("doc_id", "section").distinct()
    return pages.join(hits, ["doc_id", "section"], "left_semi").select("doc_id", "section", "page")


def subsection_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside each section: runs of pages with the same second heading."""
    pages = in_sections(spark, sf_dir)
    starts = structure.heading_boundaries(pages.select("doc_id", "section", "page", F.col("second").alias("title")), ["doc_id", "section"])
    ends = sections(spark, sf_dir).select("doc_id", F.col("number").alias("section"), "page_end")
    found = structure.intervals(starts.join(ends, ["doc_id", "section"]).withColumnRenamed("page_end", "section_end"), ["doc_id", "section"], F.col("section_end"))
    return found


def chunk_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = in_sections(spark, sf_dir)
    pages = pages.withColumn("subsection_title", F.when(F.col("page") % 2 == 0, F.col("second")).otherwise(""))
    return structure.chunks_of(pages, ["doc_id"]).select("doc_id", "chunk", "page", "section", "hierarchy_path", "embedding_prefix")


def normalized_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed starts (the length of each line, over 50) clamped to pages 2 to 9."""
    items = titled(spark, sf_dir).select("doc_id", "title", F.floor(F.length("content") / 50).alias("start"), F.col("page").alias("at"))
    return structure.normalised_boundaries(items, ["doc_id"], F.lit(2).cast("long"), F.lit(9).cast("long"))


def slide_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = lines(spark, sf_dir).withColumn("starts", F.length("content") < 60)
    return structure.slide_sections(slides, ["doc_id"], F.col("starts")).select("doc_id", "page", "section", "subsection")


def context_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = lines(spark, sf_dir).withColumn("needs_context", F.length("content") % 3 != 0)
    return structure.context_chains(sheets, ["doc_id"]).withColumn("chain", F.array_join(F.col("chain").cast("array<string>"), ","))


def previous_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.previous_page(lines(spark, sf_dir), ["doc_id"], most=50)
    return found.select("doc_id", "page", F.coalesce("previous", F.lit("")).alias("previous"))


def content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.paragraphs_within(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000)
    return found.select("doc_id", "part", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def degradation_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("page_count"), F.avg((F.length("content") < 40).cast("double")).alias("fallback_share"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(pages, "doc_id")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("lang")).alias("title"), "page_count", (F.col("n_chars") % 2 == 0).alias("default_structure"), F.col("quality").alias("summary_embedding"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("fallback_description"), "fallback_share")
    signals = structure.degradation_signals(rows)
    return rows.select("doc_id", F.array_join(signals, ",").alias("signals"), (F.size(signals) >= 3).alias("failed"))


LINES = """
lines AS (
  SELECT doc_id, page, content FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents))"""

STARTS = f"""
{LINES},
titled AS (
  SELECT *, CASE len(string_split(content, ' ')) % 4 WHEN 0 THEN '' ELSE 'Part ' || len(string_split(content, ' ')) % 4 END AS title, CASE length(content) % 3 WHEN 0 THEN '' ELSE 'sub ' || length(content) % 3 END AS second FROM lines),
heads AS (SELECT *, lag(lower(title)) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM titled WHERE page = 1 OR title <> ''),
starts AS (SELECT doc_id, page, title FROM heads WHERE page = 1 OR lower(title) <> before),
sections AS (
  SELECT s.doc_id, row_number() OVER w AS number, title, page AS page_start, coalesce(lead(page) OVER w - 1, page_count) AS page_end
  FROM starts s JOIN (SELECT doc_id, max(page) AS page_count FROM lines GROUP BY doc_id) USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
placed AS (
  SELECT t.*, s.number AS section, s.title AS section_title, s.page_end AS section_end FROM titled t JOIN sections s ON t.doc_id = s.doc_id AND t.page BETWEEN s.page_start AND s.page_end)"""

QUERIES = {f.__name__: f for f in (page_rows, primary_boundaries, section_intervals, expand_sections, subsection_intervals, chunk_breadcrumbs, normalized_boundaries, slide_sections, context_chains, previous_pages, content_parts, degradation_signals)}

SQL = {
    "page_rows": f"WITH {LINES} SELECT doc_id, page, length(content) AS n_chars, md5(content) AS content_md5 FROM lines",
    "primary_boundaries": f"WITH {STARTS} SELECT * FROM starts",
    "section_intervals": f"WITH {STARTS} SELECT * FROM sections",
    "expand_sections": f"WITH {STARTS} SELECT doc_id, section, page FROM placed SEMI JOIN (SELECT doc_id, section FROM placed WHERE length(content) > 500) USING (doc_id, section)",
    "subsection_intervals": f"""WITH {STARTS},
inner_heads AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY page) = 1 AS first FROM placed),
inner_named AS (SELECT *, lag(lower(second)) OVER (PARTITION BY doc_id, section ORDER BY page) AS before FROM inner_heads WHERE first OR second <> ''),
inner_starts AS (SELECT * FROM inner_named WHERE first OR lower(second) <> before)
SELECT doc_id, section, row_number() OVER w AS number, second AS title, page AS page_start, coalesce(lead(page) OVER w - 1, section_end) AS page_end
FROM inner_starts WINDOW w AS (PARTITION BY doc_id, section ORDER BY page)""",
    "chunk_breadcrumbs": f"""WITH {STARTS},
paths AS (SELECT *, CASE WHEN page % 2 = 0 THEN second ELSE '' END AS sub FROM placed),
crumbs AS (SELECT *, concat_ws(' > ', nullif(section_title, ''), nullif(sub, '')) AS hierarchy_path FROM paths)
SELECT doc_id, page - 1 AS chunk, page, section, hierarchy_path, CASE WHEN hierarchy_path <> '' THEN hierarchy_path || ': ' ELSE '' END AS embedding_prefix FROM crumbs""",
    "normalized_boundaries": f"""WITH {LINES},
c AS (SELECT doc_id, CASE len(string_split(content, ' ')) % 4 WHEN 0 THEN '' ELSE 'Part ' || len(string_split(content, ' ')) % 4 END AS title, greatest(least(length(content) // 50, 9), 2) AS page_start, page FROM lines),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page_start ORDER BY page) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_start) AS number FROM k)
SELECT doc_id, number, title, CASE WHEN number = 1 THEN 2 ELSE page_start END AS page_start FROM n""",
    "slide_sections": f"""WITH {LINES},
s AS (SELECT doc_id, page, sum(CASE WHEN page = 1 OR length(content) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS section FROM lines)
SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY page) AS subsection FROM s""",
    "context_chains": f"""WITH {LINES},
n AS (SELECT doc_id, page, length(content) % 3 <> 0 AS needs,
  max(CASE WHEN length(content) % 3 = 0 THEN page END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM lines)
SELECT doc_id, page, CASE WHEN needs AND page > 1 THEN array_to_string(range(greatest(page - 3, coalesce(stop, 1)), page), ',') ELSE '' END AS chain FROM n""",
    "previous_pages": f"WITH {LINES} SELECT doc_id, page, coalesce(right(lag(content) OVER (PARTITION BY doc_id ORDER BY page), 50), '') AS previous FROM lines",
    "content_parts": f"""WITH {LINES},
o AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000 AS cut FROM lines),
g AS (SELECT doc_id, cut, string_agg(content, chr(10) ORDER BY page) AS content FROM o GROUP BY doc_id, cut)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cut) - 1 AS part, md5(content) AS content_md5 FROM g""",
    "degradation_signals": f"""WITH {LINES},
p AS (SELECT doc_id, count(*) AS page_count, avg(CASE WHEN length(content) < 40 THEN 1.0 ELSE 0.0 END) AS share FROM lines GROUP BY doc_id),
s AS (SELECT d.doc_id, list_filter([
    CASE WHEN d.doc_id % 6 = 0 OR coalesce(trim(lang), '') = '' THEN 'empty metadata' END,
    CASE WHEN page_count > 5 AND n_chars % 2 = 0 THEN 'default structure classification' END,
    CASE WHEN quality IS NULL THEN 'missing summary embedding' END,
    CASE WHEN toxic = 1 THEN 'fallback document description' END,
    CASE WHEN share > 0.5 THEN 'empty section summaries' END], lambda x: x IS NOT NULL) AS signals
  FROM documents d LEFT JOIN labels USING (doc_id) JOIN p USING (doc_id))
SELECT doc_id, array_to_string(signals, ',') AS signals, len(signals) >= 3 AS failed FROM s""",
}
