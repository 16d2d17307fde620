"""Queries on sheets as text, over lines of documents and the sheets made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import extraction, sheets
from quillspark.plans.structure import LINES, lines
from quillspark.plans.tables import CELLS, SCORES, region_scores, sheet_cells
from quillspark.sources.tables import dealt, table


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the sheets with their block as the region."""
    return sheet_cells(spark, sf_dir).withColumn("region", (F.floor((F.col("row") - 1) / 40) * 2 + F.floor((F.col("col") - 1) / 8)).cast("long"))



def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = blocks(spark, sf_dir).withColumn("value", F.when(F.col("col") % 8 == 4, F.concat("value", F.lit("|\n"))).otherwise(F.col("value")))
    return sheets.region_lines(cells, ["sheet"])


def sheet_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(sheets.preview(F.col("text")).cast("binary")).alias("preview_md5"))


def spliced_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of three regions, two of which are replaced, one by the document's text; one document in five has a region that isn't there. A replacement takes the line end after its block, so a marker behind it stays."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    key = F.col("doc_id").cast("string")
    content = F.concat(F.lit("top\n<!-- region:r1 start -->\n| Row | A |\n<!-- region:r1 end -->\n\n\n\nn"), key, F.lit("\n<!-- region:r2 start -->\nx\n<!-- region:r2 end -->\n<!-- region:r3 start -->\nstays\n<!-- region:r3 end -->"))
    last = F.when(F.col("doc_id") % 5 == 0, "r9").otherwise("r2")
    new = F.array(F.struct(F.lit("r1").alias("region_id"), F.concat(F.lit("\n# Table "), key, F.lit(" \n")).alias("replacement")), F.struct(last.alias("region_id"), F.concat("lang", F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("replacement")))
    return docs.select("doc_id", sheets.spliced(content, new).alias("content"))


def padded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page", F.md5(sheets.padded_line(F.split("content", " ", -1), 12).cast("binary")).alias("line_md5"))


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.sample_rows(lines(spark, sf_dir).select("doc_id", "page"), ["doc_id"], ["page"])


def used_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sheets with a header, a table of two rows, and a text behind it."""
    docs = table(spark, sf_dir, "documents")
    content = F.concat(F.lit("# Sheet\n- Used range:  A1:B"), F.col("doc_id").cast("string"), F.lit(" \n\n| Row | A |\n| 1 | x |\n\nend\n"))
    content = F.when(F.col("doc_id") % 4 == 0, "no table\n").otherwise(content)
    return docs.select("doc_id", sheets.used_range(content).alias("used_range"), sheets.framing(content).alias("framing"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = region_scores(spark, sf_dir).select("sheet", "region", "score")
    bounds = blocks(spark, sf_dir).groupBy("sheet", "region").agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    return bounds.join(scores, ["sheet", "region"]).withColumn("native", F.col("sheet") % 7 == 0)


def typed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and two visuals a sheet, anchored by the sheet's number."""
    anchor = F.struct(F.lit(1).alias("visual"), (F.col("sheet") % 75 + 1).alias("anchor_row"), (F.col("sheet") % 13 + 1).alias("anchor_col"))
    other = F.struct(F.lit(2).alias("visual"), (F.col("sheet") % 30 + 1).alias("anchor_row"), F.lit(2).cast("long").alias("anchor_col"))
    found = boxes(spark, sf_dir)
    visuals = found.select("sheet").distinct().select("sheet", F.explode(F.array(anchor, other)).alias("v")).select("sheet", "v.*")
    return sheets.typed_regions(found, visuals, ["sheet"]).select("sheet", "region", "visuals", "kind")


def uncovered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells outside of the first region of every second sheet."""
    tables = boxes(spark, sf_dir).filter("region = 0 and sheet % 2 = 0")
    return sheets.uncovered(sheet_cells(spark, sf_dir), tables, ["sheet"]).select("sheet", "row", "col")


def column_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as names of columns, their letters as positions; references by either, some to nothing."""
    part = table(spark, sf_dir, "part")
    columns = part.select("p_brand", F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("position"), F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("name"))
    key = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("n"), F.col("p_size").cast("string"))).otherwise("nothing")
    return sheets.resolved_columns(part.select("p_brand", "p_partkey", key.alias("key")), columns, ["p_brand"]).select("p_partkey", "key", "position")


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a supplier's number as the lengths of two series."""
    n = F.col("s_suppkey")
    series = table(spark, sf_dir, "supplier").select("s_suppkey", sheets.series_points(F.sequence(F.lit(1), (n % 15 + 1).cast("int")), F.sequence(F.lit(101), (n % 9 + 101).cast("int"))).alias("points"))
    return series.select("s_suppkey", F.posexplode("points").alias("at", "p")).select("s_suppkey", "at", "p.*")


def structured_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of regions whose header is in their second row, and of cards; what cards say replaces the regions'."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_orderkey").agg(F.min("o_custkey").alias("n"))
    value = F.concat(F.lit("$"), F.col("n").cast("string"))
    rows = [(1, "Note", "x"), (2, "Metrics", "Current Value"), (3, "Profit", value), (4, "Worksheet", value), (5, "Narrative note", value), (6, "Loss estimated", value)]
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    cell = [F.struct(F.lit(r).cast("long").alias("row"), F.lit(c).cast("long").alias("col"), text(v).alias("value")) for r, a, b in rows for c, v in ((1, a), (2, b))]
    pages = orders.select("o_orderkey", F.array(*cell).alias("cells"), F.when(F.col("n") % 2 == 0, F.format_string("- profit\n  - Value: %d%%", "n")).alias("text"))
    return extraction.pair_rows(pages, ["o_orderkey"], extraction.merged_pairs([extraction.region_pairs(F.col("cells")), extraction.bullet_pairs(F.col("text"))]))


def column_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a size, as columns of a table."""
    part = table(spark, sf_dir, "part")
    columns = part.select("p_size", F.col("p_partkey").alias("position"), F.concat("p_name", F.lit("|")).alias("name"), F.lit("text").alias("dtype"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("description"))
    return sheets.column_table(columns, ["p_size"])


def role_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 4
    role = F.when(n == 0, "filter").when(n == 1, "identifier").when(n == 2, "measure").otherwise("text_content")
    columns = part.select("p_size", F.col("p_partkey").alias("position"), F.col("p_name").alias("name"), role.alias("role"), F.when(F.col("p_partkey") % 8 == 2, "1").alias("low"), F.when(F.col("p_partkey") % 8 == 2, "9").alias("high"), F.when(F.col("p_partkey") % 8 == 4, F.col("p_type")).alias("values"))
    return sheets.role_section(columns, ["p_size"])


QUERIES = {f.__name__: f for f in (region_lines, sheet_previews, spliced_sheets, padded_lines, sample_rows, used_ranges, typed_regions, uncovered_cells, column_references, series_points, structured_metrics, column_tables, role_sections)}

BOXES = f"""{SCORES},
boxed AS (SELECT sheet, region, r0, r1, c0, c1, n_rows, n_cols, score, sheet % 7 = 0 AS native FROM scores)"""

SQL = {
    "region_lines": f"""WITH {CELLS},
c AS (SELECT sheet, ("row" - 1) // 40 * 2 + (col - 1) // 8 AS region, "row", col, CASE WHEN col % 8 = 4 THEN value || '\\| ' ELSE value END AS value FROM cells),
k AS (SELECT DISTINCT sheet, region, col FROM c),
r AS (SELECT DISTINCT sheet, region, "row" FROM c),
g AS (SELECT r.sheet, r.region, r."row", '| ' || r."row" || ' | ' || string_agg(coalesce(value, ''), ' | ' ORDER BY k.col) || ' |' AS line FROM r JOIN k USING (sheet, region) LEFT JOIN c USING (sheet, region, "row", col) GROUP BY r.sheet, r.region, r."row"),
h AS (SELECT sheet, region, string_agg(chr((64 + col)::INT), ' | ' ORDER BY col) AS letters, string_agg('---', ' | ') AS dashes FROM k GROUP BY ALL)
SELECT sheet, region, "row" AS place, line FROM g
UNION ALL SELECT sheet, region, -3, '<!-- region:' || region || ' start -->' FROM h UNION ALL SELECT sheet, region, -2, '| Row | ' || letters || ' |' FROM h UNION ALL SELECT sheet, region, -1, '| --- | ' || dashes || ' |' FROM h
UNION ALL SELECT sheet, region, max("row") + 1, '<!-- region:' || region || ' end -->' FROM r GROUP BY sheet, region""",
    "sheet_previews": """
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, list_transform(ls, lambda x: CASE WHEN length(x) > 300 THEN x[1:300] || ' ...' ELSE x END) AS ls FROM l)
SELECT doc_id, md5(array_to_string(CASE WHEN len(ls) <= 34 THEN ls ELSE list_concat(ls[1:24], ['... omitted sheet rows ...'], ls[-10:]) END, chr(10))) AS preview_md5 FROM s""",
    "spliced_sheets": """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '# Table ' || doc_id || chr(10) || chr(10) || line ELSE 'top' || chr(10) || '# Table ' || doc_id || chr(10) || chr(10) || 'n' || doc_id || chr(10) || line || '<!-- region:r3 start -->' || chr(10) || 'stays' END AS content
FROM (SELECT *, rtrim(lang || ': ' || replace(text, chr(10), ' ')) AS line FROM documents) WHERE text IS NOT NULL""",
    "padded_lines": f"""WITH {LINES},
w AS (SELECT doc_id, page, string_split(content, ' ') AS ws FROM lines)
SELECT doc_id, page, md5(array_to_string(list_transform(range(1, 13), lambda i: coalesce(ws[i], '')), ' | ')) AS line_md5 FROM w""",
    "sample_rows": f"WITH {LINES}, n AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS last FROM lines) SELECT doc_id, page FROM n WHERE page <= 5 OR page > last - 3",
    "used_ranges": """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'A1:B' || doc_id END AS used_range,
  CASE WHEN doc_id % 4 = 0 THEN 'no table' ELSE '# Sheet' || chr(10) || '- Used range:  A1:B' || doc_id || chr(10) || chr(10) || 'end' END AS framing FROM documents""",
    "typed_regions": f"""WITH {BOXES},
v AS (SELECT DISTINCT sheet, unnest([sheet % 75 + 1, sheet % 30 + 1]) AS ar, unnest([sheet % 13 + 1, 2]) AS ac, unnest([1, 2]) AS visual FROM boxed),
c AS (SELECT b.sheet, b.region, count(visual) AS visuals FROM boxed b LEFT JOIN v ON v.sheet = b.sheet AND ar BETWEEN r0 AND r1 AND ac BETWEEN c0 AND c1 GROUP BY ALL)
SELECT sheet, region, visuals, CASE WHEN visuals > 0 THEN 'mixed' WHEN native OR score >= 0.55 THEN 'dense_table' WHEN n_rows > 1 AND n_cols > 1 THEN 'small_table' ELSE 'framing' END AS kind FROM boxed JOIN c USING (sheet, region)""",
    "uncovered_cells": f"""WITH {CELLS} SELECT sheet, "row", col FROM cells WHERE NOT (sheet % 2 = 0 AND "row" <= 40 AND col <= 8)""",
    "column_references": """
WITH n AS (SELECT p_brand, p_size, min('c' || p_partkey) AS named FROM part GROUP BY ALL)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'c' || p_partkey WHEN 1 THEN 'n' || p_size ELSE 'nothing' END AS key, CASE p_partkey % 3 WHEN 0 THEN 'c' || p_partkey WHEN 1 THEN named END AS position FROM part JOIN n USING (p_brand, p_size)""",
    "series_points": """
SELECT s_suppkey, i AS "at", CASE WHEN i <= s_suppkey % 15 THEN i + 1 END AS category, CASE WHEN i <= s_suppkey % 9 THEN i + 101 END AS value
FROM supplier, range(0, 12) r(i) WHERE i <= greatest(s_suppkey % 15, s_suppkey % 9)""",
    "structured_metrics": """
WITH o AS (SELECT o_orderkey, min(o_custkey) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, 'Profit' AS label, CASE WHEN n % 2 = 0 THEN n || '%' ELSE '$' || n END AS value FROM o UNION ALL SELECT o_orderkey, 'Loss', '$' || n FROM o""",
    "column_tables": """
SELECT p_size, '| Column | Type | Description |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_name || '\\| | text | ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END || ' |', chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1""",
    "role_sections": """
WITH p AS (
  SELECT p_size, string_agg('- ' || p_name || CASE WHEN p_partkey % 8 = 4 THEN ': ' || p_type ELSE '' END, chr(10) ORDER BY p_partkey) FILTER (p_partkey % 4 = 0) AS f, string_agg(p_name, ', ' ORDER BY p_partkey) FILTER (p_partkey % 4 = 1) AS i,
    string_agg('- ' || p_name || CASE WHEN p_partkey % 8 = 2 THEN ': 1 to 9' ELSE '' END, chr(10) ORDER BY p_partkey) FILTER (p_partkey % 4 = 2) AS m, string_agg(p_name, ', ' ORDER BY p_partkey) FILTER (p_partkey % 4 = 3) AS t FROM part GROUP BY 1)
SELECT p_size, concat_ws(chr(10) || chr(10), '### Filter Columns' || chr(10) || f, '### Identifiers' || chr(10) || '- ' || i, '### Measures' || chr(10) || m, '### Text Content' || chr(10) || '- ' || t) AS text FROM p""",
}
