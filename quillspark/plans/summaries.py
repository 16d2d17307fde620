"""Queries on titles, summaries and texts to embed, over lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import structure, summaries
from quillspark.plans.structure import LINES, lines
from quillspark.sources.tables import table

TITLES = ("1.2 References:", "II. Abstract", "Results", "appendix", "List of  Figures")


def titled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each line, titled by its number; the abstract is the document's language."""
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("page") % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("abstract"))
    return lines(spark, sf_dir).withColumn("title", title).join(docs, "doc_id")


def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.section_summaries(titled_sections(spark, sf_dir)).select("doc_id", "page", "overview", "needs_model")


def subsection_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sections' subsections of one or two pages, with the line's strings as keywords."""
    rows = titled_sections(spark, sf_dir).select("doc_id", "page", "abstract", F.col("title").alias("section_title"), F.lit("Sub").alias("title"), (F.col("page") % 2 + 1).alias("page_count"), F.col("content").alias("page_summary"), F.split("content", " ", -1).alias("keywords"))
    found = summaries.subsection_summaries(rows)
    return found.select("doc_id", "page", "overview", F.md5(F.array_join("topics", " ").cast("binary")).alias("topics_md5"), "needs_model")


def default_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings are lines, on two levels."""
    level = lambda n, t: F.struct(F.lit(n).alias("level"), t.alias("title"))
    hierarchy = F.array(level(2, F.lit("x")), level(1, F.lit(" ")), level(1, F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise("")))
    pages = lines(spark, sf_dir).select("doc_id", "page", hierarchy.alias("hierarchy"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("page_title"))
    return summaries.default_titles(pages, ["doc_id"])


def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    meta = docs.select("doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.array("lang", F.lit(" "), "lang", "source").alias("authors"), F.when(F.col("doc_id") % 2 == 0, "2024").alias("date"), F.lit("").alias("kind"), F.lit(3).cast("long").alias("page_count"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("abstract"))
    sections = docs.filter("doc_id % 4 <> 0").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("number"), "lang", "source")
    sections = sections.select("doc_id", "number", F.concat(F.lit("S"), F.col("number").cast("string")).alias("title"), F.col("number").alias("page_start"), (F.col("number") + F.col("number") % 2).alias("page_end"), F.col("lang").alias("overview"), F.array("source", "lang").alias("topics"), F.when(F.col("number") == 2, F.array(F.lit("f1"), F.lit("f2"))).alias("findings"))
    return summaries.document_lines(meta, sections, ["doc_id"])


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    odd = F.when(F.col("doc_id") % 2 == 1, F.col("source")).otherwise("")
    return docs.select("doc_id", summaries.keyword_text(odd, key, F.col("lang")).alias("keyword"), summaries.metric_text(F.col("lang"), key, odd, F.lit(None).cast("string")).alias("metric"), F.length(summaries.embedded(F.col("text"))).cast("long").alias("n_chars"), summaries.dense_title(F.lit("S"), odd, F.when(F.col("doc_id") % 4 == 0, key).otherwise(""), F.col("doc_id")).alias("dense_title"))


def formula_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a table's columns by a part's size; descriptions by its key."""
    n = F.col("p_size")
    names = F.array(F.when(n % 2 == 0, "Calc_1").otherwise("Revenue"), F.when(n % 3 == 0, "Formula 2").otherwise("formulas"), F.when(n % 5 == 0, "=ROUND(x)").otherwise("Cost"))
    rows = table(spark, sf_dir, "part").select("p_partkey", names.alias("names"), F.array(F.when(F.col("p_partkey") % 2 == 0, "A Template of it").otherwise("plain")).alias("descriptions"), F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("measures"))
    return rows.select("p_partkey", summaries.formula_tables(rows).alias("formula_only"))


def metric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    item = lambda name, platform: F.struct(name.alias("metric_name"), platform.alias("platform"), F.lit(None).cast("string").alias("sub_platform"))
    tables = part.select("p_partkey", F.array(item(F.concat(F.lit(" "), F.col("p_name")), F.col("p_brand")), item(F.lit(" "), F.lit("x")), item(F.lit("Offset 3"), F.lit("x"))).alias("metrics"))
    return summaries.metric_items(tables, ["p_partkey"])


def expanded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 3 == 0, "Annual Report").when(F.col("doc_id") % 3 == 1, "Report 2024").otherwise("A title of five words")
    level = lambda n, t: F.struct(F.lit(n).alias("level"), t.alias("title"))
    hierarchy = F.array(level(1, F.lit("Top")), level(2, F.lit("KPI Cards")), level(3, F.lit("Notes on it")), level(2, F.when(F.col("doc_id") % 2 == 0, "Table: Risk view").otherwise("report")))
    return docs.select("doc_id", summaries.expanded_title(title, F.when(F.col("doc_id") % 5 == 0, "pdf").otherwise("docx"), hierarchy).alias("title"))


def detection_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "pptx").when(F.col("doc_id") % 4 == 1, "xlsx").otherwise("pdf").alias("filetype"), (F.col("n_chars") % 200).alias("page_count"))
    return docs.select("doc_id", structure.detection_ways(docs).alias("way"))


def blank_line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of lines with a blank one after every third, in parts of 300 words at most."""
    spaced = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit("\n"))).otherwise(x)), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", spaced.alias("text"))
    found = structure.split_at_blank_lines(docs, "text", 300)
    return found.select("doc_id", "part", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


QUERIES = {f.__name__: f for f in (section_summaries, subsection_summaries, default_titles, document_summaries, embedding_texts, formula_tables, metric_items, expanded_titles, detection_ways, blank_line_parts)}

SECTIONS = f"""{LINES},
sections AS (
  SELECT l.*, ['1.2 References:', 'II. Abstract', 'Results', 'appendix', 'List of  Figures'][page % 5 + 1] AS title, CASE WHEN doc_id % 3 <> 0 THEN lang END AS abstract FROM lines l JOIN documents USING (doc_id)),
summed AS (
  SELECT *, CASE page % 5 WHEN 2 THEN NULL WHEN 1 THEN coalesce(nullif(trim(abstract), ''), 'Standard ' || title || ' section') ELSE 'Standard ' || title || ' section' END AS overview FROM sections)"""

SQL = {
    "section_summaries": f"WITH {SECTIONS} SELECT doc_id, page, overview, overview IS NULL AS needs_model FROM summed",
    "subsection_summaries": f"""WITH {SECTIONS},
k AS (SELECT doc_id, page, unnest(string_split(content, ' ')) AS w, unnest(range(len(string_split(content, ' ')))) AS i FROM lines),
f AS (SELECT doc_id, page, w, min(i) AS i FROM (SELECT doc_id, page, regexp_replace(w, '^\\s+|\\s+$', '', 'g') AS w, i FROM k) WHERE w <> '' GROUP BY ALL),
t AS (SELECT doc_id, page, string_agg(w, ' ' ORDER BY i) AS topics FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY i) <= 8) GROUP BY ALL),
s AS (SELECT doc_id, page, coalesce(overview, CASE WHEN page % 2 = 0 THEN coalesce(nullif(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), ''), 'Sub') END) AS overview, overview IS NULL AND page % 2 = 0 AS own FROM summed)
SELECT doc_id, page, overview, md5(CASE WHEN own THEN coalesce(topics, '') ELSE '' END) AS topics_md5, overview IS NULL AS needs_model FROM s LEFT JOIN t USING (doc_id, page)""",
    "default_titles": f"""WITH {LINES}
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(content, '^\\s+|\\s+$', '', 'g') ELSE '' END, ''), CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id ELSE 'Document' END) AS title FROM lines WHERE page = 1""",
    "document_summaries": """
WITH s AS (
  SELECT doc_id, string_agg(chr(10) || '## Section ' || n || ': S' || n || ' (' || CASE WHEN n % 2 = 0 THEN 'page ' || n ELSE 'pages ' || n || '-' || (n + 1) END || ')' || coalesce(chr(10) || '**Overview:** ' || nullif(lang, ''), '')
    || coalesce(chr(10) || '**Key Topics:** ' || nullif(CASE WHEN source = lang THEN source ELSE concat_ws(', ', source, lang) END, ''), '') || CASE WHEN n = 2 THEN chr(10) || '**Key Findings:** f1; f2' ELSE '' END, chr(10) ORDER BY n) AS body
  FROM documents, range(1, 4) r(n) WHERE doc_id % 4 <> 0 AND n <= doc_id % 3 + 1 GROUP BY doc_id)
SELECT doc_id, '# Document Metadata' || chr(10) || '- Title: T' || doc_id || coalesce(chr(10) || '- Authors: ' || nullif(concat_ws(', ', lang, source), ''), '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '- Date: 2024' ELSE '' END
  || chr(10) || '- Pages: 3' || CASE WHEN doc_id % 3 = 0 AND source <> '' THEN chr(10) || chr(10) || '## Abstract' || chr(10) || source ELSE '' END || coalesce(chr(10) || body, '') AS text FROM documents LEFT JOIN s USING (doc_id)""",
    "embedding_texts": """
WITH d AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN source ELSE '' END AS odd FROM documents)
SELECT doc_id, concat_ws(' | ', nullif(odd, ''), 'keyword: ' || doc_id, 'section: ' || nullif(lang, '')) AS keyword, concat_ws(' | ', nullif(lang, ''), 'metric: ' || doc_id, 'platform: ' || nullif(odd, '')) AS metric,
  least(length(text), 20000) AS n_chars, CASE WHEN odd <> '' THEN 'S [' || odd || ']' WHEN doc_id % 4 = 0 THEN 'S [' || doc_id || ']' ELSE 'S dense table ' || doc_id END AS dense_title FROM d""",
    "formula_tables": """
SELECT p_partkey, (p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT + (p_size % 5 = 0)::INT + (p_partkey % 2 = 0)::INT >= 2 AND p_partkey % 7 <> 0 AS formula_only FROM part""",
    "metric_items": "SELECT p_partkey, trim(p_name) AS metric_name, p_brand AS platform, '' AS sub_platform FROM part WHERE trim(p_name) <> ''",
    "expanded_titles": """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Annual Report' || CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN ' - Risk view' ELSE '' END WHEN 1 THEN 'Report 2024' ELSE 'A title of five words' END AS title FROM documents""",
    "detection_ways": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'slides' WHEN doc_id % 4 = 1 THEN 'sheets' WHEN n_chars % 200 <= 100 THEN 'model' ELSE 'headings' END AS way FROM documents",
}
