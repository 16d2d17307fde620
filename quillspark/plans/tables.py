"""Queries on tables and cells, over part, orders, lineitem and cells made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import char_tokens, value_shape, value_type, word_tokens
from quillspark.operators import tables
from quillspark.sources.tables import dealt, table

PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LINEITEM = ["l_large", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part and lineitem columns as texts; doubles with two decimals."""
    part = table(spark, sf_dir, "part").withColumn("p_retailprice", F.format_string("%.2f", "p_retailprice"))
    items = table(spark, sf_dir, "lineitem").withColumn("l_large", F.when(F.col("l_quantity") > 25, "TRUE").otherwise("false")).select(*[F.format_string("%.2f", c).alias(c) if c in ("l_quantity", "l_discount", "l_tax") else F.col(c) for c in LINEITEM])
    return tables.unpivoted(part, PART).unionByName(tables.unpivoted(items, LINEITEM))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.profile(texts(spark, sf_dir))


def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_roles(column_profile(spark, sf_dir)).select("name", "dtype", "role")


def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.value_distribution(texts(spark, sf_dir))


def detect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of values of four tables, and of values written in other ways."""
    events = table(spark, sf_dir, "events")
    odd = F.array(F.concat(F.lit("("), F.floor("value").cast("string"), F.lit(")")), F.concat(F.lit("$"), F.format_string("%.2f", "value")), F.concat(F.floor("value").cast("string"), F.lit("%")), F.col("event_type"), F.lit(" true "), F.col("props"), F.lit("-"), F.lit("1d"), F.lit("1_000"), F.lit(".5"), F.date_format("ts", "yyyy-MM-dd"))
    values = events.select(F.explode(odd).alias("value")).unionByName(texts(spark, sf_dir).select("value"))
    return values.groupBy(value_type(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("name", value_shape(F.col("value")).alias("shape")).groupBy("name", "shape").agg(F.count("*").alias("n"))


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of part tables, one per brand; every second one has its column names as the first row."""
    part = table(spark, sf_dir, "part").withColumn("p_retailprice", F.format_string("%.2f", "p_retailprice"))
    each = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(PART)])
    rows = part.select("p_brand", F.col("p_partkey").alias("row"), F.explode(each).alias("cell")).select("p_brand", "row", "cell.*")
    names = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("col"), F.lit(c).alias("value")) for i, c in enumerate(PART)])
    heads = part.select("p_brand").distinct().filter(F.right("p_brand", F.lit(1)).cast("int") % 2 == 1)
    return rows.unionByName(heads.select("p_brand", F.lit(-1).cast("long").alias("row"), F.explode(names).alias("cell")).select("p_brand", "row", "cell.*"))


def header_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_mode(part_cells(spark, sf_dir), ["p_brand"])


def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = part_cells(spark, sf_dir).join(header_mode(spark, sf_dir).select("p_brand", "mode"), "p_brand")
    return tables.column_names(cells, ["p_brand"], F.col("mode") == "headerless")


def grid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sheets of orders; a value beginning with = is a formula."""
    cells = sheet_cells(spark, sf_dir)
    made = cells.withColumn("value", F.when(F.col("row") % 3 == 0, F.concat(F.lit("="), "value")).when(F.col("col") == 2, "").otherwise(F.col("value")))
    return tables.grid_stats(made, ["sheet"])


def pick_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("p_name", "p_brand", "p_type", "p_size")])
    return tables.first_samples(part.select(F.col("p_partkey").alias("row"), F.explode(each).alias("cell")).select("row", "cell.*"))


def dense_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.col("p_type"))
    return tables.dense_filter(part, {"P_BRAND": "brand#11", "unknown": "x"})


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", word_tokens(F.col("text")).alias("by_words"), char_tokens(F.col("text")).alias("by_chars"))


def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("l_large", F.when(F.col("l_quantity") > 25, "TRUE").otherwise("false")).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("line"))
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "line")]
    found = tables.token_batches(items, ["l_suppkey"], order, "line", 200)
    return found.groupBy("l_suppkey", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def sheet_cells(spark: SparkSession, sf_dir: str, by_sheet: bool = False) -> DataFrame:
    """Sheets of four blocks of order cells (one sheet per customer), with blank rows and columns between. by_sheet: orders are dealt by their sheets first, so that cells need not be."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    orders = dealt(orders, "o_custkey") if by_sheet else orders
    block = F.col("o_orderkey") % 4
    top, left = F.floor(block / 2) * 40, (block % 2) * 8
    at = (F.floor(F.col("o_orderkey") / 4) % 30 + 1)
    values = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.format_string("%.2f", "o_totalprice"), F.col("o_orderpriority")]
    each = F.array(*[F.struct(F.lit(i + 1).alias("i"), v.alias("value")) for i, v in enumerate(values)])
    rows = orders.select(F.col("o_custkey").alias("sheet"), "o_orderkey", (top + at).cast("long").alias("row"), left.alias("left"), F.explode(each).alias("cell"))
    cells = rows.select("sheet", "row", (F.col("left") + F.col("cell.i")).cast("long").alias("col"), F.col("cell.value").alias("value"))
    return cells.groupBy("sheet", "row", "col").agg(F.min("value").alias("value"))


def sheet_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.region_runs(sheet_cells(spark, sf_dir, by_sheet=True), ["sheet"]).groupBy("sheet", "region").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("first").alias("left"), F.max("last").alias("right"), F.sum("n").alias("n_cells"))


def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sheet_cells(spark, sf_dir).withColumn("region", (F.floor((F.col("row") - 1) / 40) * 2 + F.floor((F.col("col") - 1) / 8)).cast("long"))
    return tables.region_scores(cells, ["sheet", "region"])


def best_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.best_region(region_scores(spark, sf_dir), ["sheet"])


def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^(.*\|.*)$", r"|$1|").alias("text"))
    return tables.markdown_cells(docs, ["doc_id"], "text").select("doc_id", "line_number", "col", "value")


TEXTS = """
values_of AS (
  UNPIVOT (SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size, printf('%.2f', p_retailprice) AS p_retailprice FROM part)
    ON COLUMNS(*) INTO NAME name VALUE value
  UNION ALL
  UNPIVOT (SELECT CASE WHEN l_quantity > 25 THEN 'TRUE' ELSE 'false' END AS l_large, printf('%.2f', l_quantity) AS l_quantity, printf('%.2f', l_discount) AS l_discount, printf('%.2f', l_tax) AS l_tax, l_returnflag, l_linestatus FROM lineitem)
    ON COLUMNS(*) INTO NAME name VALUE value)"""

NUMERIC = r"""CASE WHEN regexp_matches(plain, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN plain::DOUBLE END"""
TYPED = rf"""
bare AS (
  SELECT *, regexp_replace(value, '^\s+|\s+$', '', 'g') AS b FROM values_of),
signed AS (
  SELECT *, regexp_replace(CASE WHEN regexp_matches(b, '^\(([0-9,.]+)\)$') THEN '-' || regexp_extract(b, '^\(([0-9,.]+)\)$', 1) ELSE b END, '[$,%]', '', 'g') AS plain FROM bare),
typed AS (
  SELECT *, {NUMERIC} AS number,
    CASE WHEN value IS NULL OR b = '' THEN 'null' WHEN upper(b) IN ('TRUE', 'FALSE') THEN 'boolean'
         WHEN regexp_matches(b, '^\d{{4}}-\d{{2}}-\d{{2}}(\s\d{{2}}:\d{{2}}:\d{{2}})?$') THEN 'date'
         WHEN {NUMERIC} IS NOT NULL THEN 'numeric' ELSE 'text' END AS kind
  FROM signed)"""
PROFILE = f"""{TEXTS}, {TYPED},
profiles AS (
  SELECT name, count(*) AS row_count, count(*) FILTER (kind = 'null') AS null_count, count(DISTINCT value) FILTER (kind <> 'null') AS unique_count,
    CASE count(DISTINCT kind) FILTER (kind <> 'null') WHEN 0 THEN 'text' WHEN 1 THEN any_value(kind) FILTER (kind <> 'null') ELSE 'mixed' END AS dtype,
    min(number) FILTER (kind = 'numeric') AS min_number, max(number) FILTER (kind = 'numeric') AS max_number,
    round(avg(number) FILTER (kind = 'numeric'), 4) AS mean,
    min(value) FILTER (kind = 'date') AS min_date, max(value) FILTER (kind = 'date') AS max_date,
    CASE WHEN count(*) FILTER (kind = 'boolean') > 0 THEN count(*) FILTER (kind = 'boolean' AND upper(b) = 'TRUE') END AS true_count,
    CASE WHEN count(*) FILTER (kind = 'boolean') > 0 THEN count(*) FILTER (kind = 'boolean' AND upper(b) = 'FALSE') END AS false_count,
    min(length(value)) AS min_length, max(length(value)) AS max_length, round(avg(length(value)), 1) AS avg_length
  FROM typed GROUP BY name)"""
CELLS = """
cells AS (
  SELECT o_custkey AS sheet, ((o_orderkey % 4) // 2) * 40 + (o_orderkey // 4) % 30 + 1 AS "row", (o_orderkey % 4) % 2 * 8 + c.i AS col,
    min(CASE c.i WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN o_orderstatus WHEN 3 THEN printf('%.2f', o_totalprice) ELSE o_orderpriority END) AS value
  FROM orders, range(1, 5) AS c(i) GROUP BY ALL)"""
SCORES = f"""{CELLS},
placed AS (SELECT *, ("row" - 1) // 40 * 2 + (col - 1) // 8 AS region FROM cells),
widths AS (SELECT sheet, region, "row", count(*) AS width FROM placed GROUP BY ALL),
shapes AS (
  SELECT sheet, region, list_sort(list(width)) AS ws, arg_min(width, "row") AS header_width FROM widths GROUP BY ALL),
boxes AS (
  SELECT sheet, region, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1, count(*) AS n_cells, list_sort(list(length(value))) AS ls FROM placed GROUP BY ALL),
parts AS (
  SELECT *, r1 - r0 + 1 AS n_rows, c1 - c0 + 1 AS n_cols, ls[len(ls) // 2 + 1] AS mid,
    len(list_filter(ws, lambda w: abs(w - ws[len(ws) // 2 + 1]) <= 1)) / len(ws) AS regular
  FROM boxes JOIN shapes USING (sheet, region)),
scores AS (
  SELECT *, CASE WHEN n_rows < 2 OR n_cols < 2 THEN 0.0::DOUBLE ELSE round(greatest(0.0, least(0.99,
    0.35::DOUBLE * regular + 0.25::DOUBLE * (n_cells / (n_rows * n_cols)) + 0.2::DOUBLE * (least(n_rows / n_cols, 2.0::DOUBLE) / 2 * least(1.0::DOUBLE, n_cols / 3))
    + 0.1::DOUBLE * least(1.0::DOUBLE, header_width / n_cols) + 0.1::DOUBLE * (1 - CASE WHEN mid >= 80 THEN 1.0 WHEN mid <= 20 THEN 0.0 ELSE (mid - 20) / 60 END)
    + CASE WHEN n_rows >= 3 THEN 0.05::DOUBLE ELSE 0.0 END)), 4) END AS score
  FROM parts)"""

HEADERS = rf"""
values_of AS (
  SELECT p_brand, p_partkey AS r, c.i AS col, CASE c.i WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN p_name WHEN 3 THEN p_brand WHEN 4 THEN p_type WHEN 5 THEN p_size::VARCHAR ELSE printf('%.2f', p_retailprice) END AS value
  FROM part, range(1, 7) c(i)
  UNION ALL SELECT b, -1, c.i, ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'][c.i] FROM (SELECT DISTINCT p_brand AS b FROM part WHERE right(p_brand, 1)::INT % 2 = 1), range(1, 7) c(i)),
{TYPED},
shaped AS (
  SELECT *, min(r) OVER (PARTITION BY p_brand) AS f,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '0', 'g'), '\s+', ' ', 'g'), 'AA+', 'A', 'g') AS shape FROM typed),
top AS (SELECT p_brand, col, value AS top, b AS bare, kind AS top_kind, shape AS top_shape FROM shaped WHERE r = f),
counted AS (SELECT p_brand, count(DISTINCT r) AS n_rows FROM typed GROUP BY 1),
data AS (SELECT *, row_number() OVER (PARTITION BY p_brand, col ORDER BY r) AS place FROM shaped WHERE r > f AND kind <> 'null'),
usual AS (
  SELECT p_brand, col, kind AS usual FROM (SELECT p_brand, col, kind, count(*) AS n, min(r) AS since FROM data GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY p_brand, col ORDER BY n DESC, since) = 1),
early AS (SELECT p_brand, col, list(DISTINCT shape) AS shapes, count(DISTINCT value) < count(value) AS repeats FROM data WHERE place <= 5 GROUP BY ALL),
recurs AS (SELECT DISTINCT d.p_brand, d.col, true AS recurs FROM data d JOIN top t ON d.p_brand = t.p_brand AND d.col = t.col AND d.value = t.top),
each AS (
  SELECT t.*, usual, coalesce(recurs, false) AS again, coalesce(list_contains(shapes, top_shape), false) AS alike, coalesce(repeats, false) AS repeats, coalesce(top_kind = usual, false) AS same,
    coalesce(top_kind = usual AND usual = 'text', false) AS both_text, contains(bare, '_') OR (upper(bare) = bare AND regexp_matches(bare, '[A-Za-z]')) OR bare LIKE '%:' AS label
  FROM top t LEFT JOIN usual USING (p_brand, col) LEFT JOIN early USING (p_brand, col) LEFT JOIN recurs USING (p_brand, col) WHERE top_kind <> 'null'),
scores AS (
  SELECT p_brand, sum(CASE WHEN again THEN 2 ELSE 0 END + CASE WHEN both_text AND alike OR same AND NOT both_text THEN 1 ELSE 0 END)::BIGINT AS data_score,
    sum(CASE WHEN both_text AND label THEN 1 ELSE 0 END + CASE WHEN both_text AND NOT again AND repeats THEN 1 ELSE 0 END
      + CASE WHEN usual IS NULL OR same THEN 0 WHEN top_kind = 'text' AND usual IN ('numeric', 'date', 'boolean') THEN 2 ELSE 1 END)::BIGINT AS header_score FROM each GROUP BY 1),
whole AS (
  SELECT p_brand, count(*) FILTER (top_kind NOT IN ('text', 'null')) * 2 > count(*) FILTER (top_kind <> 'null') AS looks_like_data, (count(DISTINCT lower(top)) = count(top))::BIGINT AS all_unique FROM top GROUP BY 1),
modes AS (
  SELECT p_brand, data_score, header_score + all_unique AS header_score,
    CASE WHEN looks_like_data THEN 'headerless' WHEN n_rows = 1 THEN 'header' WHEN data_score >= header_score + all_unique + 1 THEN 'headerless' ELSE 'header' END AS mode
  FROM whole JOIN scores USING (p_brand) JOIN counted USING (p_brand))"""

QUERIES = {f.__name__: f for f in (column_profile, column_roles, value_distribution, detect_types, value_shapes, header_mode, column_names, grid_stats, pick_samples, dense_filter, token_estimates, token_budget_batches, sheet_regions, region_scores, best_regions, markdown_cells)}

SQL = {
    "column_profile": f"WITH {PROFILE} SELECT * FROM profiles",
    "column_roles": f"""WITH {PROFILE}, s AS (SELECT *, unique_count / row_count AS share FROM profiles)
SELECT name, dtype, CASE WHEN dtype IN ('date', 'boolean') THEN 'filter'
  WHEN regexp_matches(lower(name), 'id|identifier|reference|ref|account|acct|code|key|number') AND (unique_count >= greatest(1, row_count - 1) OR share >= 0.8) THEN 'identifier'
  WHEN dtype = 'numeric' THEN 'measure' WHEN unique_count <= 20 AND (row_count <= 20 OR share <= 0.35) THEN 'filter'
  WHEN dtype = 'mixed' AND regexp_matches(lower(name), 'amount|amt|total|balance|revenue|cost|price|value|score|rate|count|quantity|qty|percent|pct') THEN 'measure'
  ELSE 'text_content' END AS role FROM s""",
    "value_distribution": f"""WITH {TEXTS}, c AS (SELECT name, value, count(*) AS n FROM values_of WHERE trim(value) <> '' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM c QUALIFY count(*) OVER (PARTITION BY name) <= 20""",
    "detect_types": f"""WITH {TEXTS.replace('values_of', 'texts_of')},
values_of AS (
  SELECT unnest(['(' || floor(value)::BIGINT || ')', '$' || printf('%.2f', value), floor(value)::BIGINT || '%', event_type, ' true ', props, '-', '1d', '1_000', '.5', strftime(ts, '%Y-%m-%d')]) AS value FROM events
  UNION ALL SELECT value FROM texts_of), {TYPED}
SELECT kind, count(*) AS n FROM typed GROUP BY kind""",
    "value_shapes": rf"""WITH {TEXTS}
SELECT name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(value), '[A-Za-z]+', 'A', 'g'), '[0-9]+', '0', 'g'), '\s+', ' ', 'g'), 'AA+', 'A', 'g') AS shape, count(*) AS n
FROM values_of GROUP BY ALL""",
    "header_mode": f"WITH {HEADERS} SELECT p_brand, data_score, header_score, mode FROM modes",
    "column_names": f"""WITH {HEADERS},
named AS (SELECT p_brand, col, CASE WHEN mode = 'headerless' OR trim(coalesce(top, '')) = '' THEN chr(64 + col::INT) ELSE trim(top) END AS name FROM top JOIN modes USING (p_brand))
SELECT p_brand, col, CASE WHEN count(*) OVER (PARTITION BY p_brand, name) > 1 THEN name || '_' || col ELSE name END AS name FROM named""",
    "grid_stats": f"""WITH {CELLS},
made AS (SELECT sheet, "row", col, CASE WHEN "row" % 3 = 0 THEN '=' || value WHEN col = 2 THEN '' ELSE value END AS value FROM cells),
f AS (SELECT *, count(*) OVER (PARTITION BY sheet, "row") AS width FROM made WHERE trim(value) <> '')
SELECT sheet, min("row") AS min_row, max("row") AS max_row, min(col) AS min_col, max(col) AS max_col, count(*) AS n_cells, count(DISTINCT "row") AS populated_rows,
  count(*) FILTER (value LIKE '=%') AS formula_cells, max(width) AS widest_row, count(DISTINCT col) AS populated_cols FROM f GROUP BY sheet""",
    "sheet_regions": f"""WITH RECURSIVE {CELLS},
turns AS (
  SELECT 0 AS turn, sheet, "row", col, '' AS region FROM cells
  UNION ALL
  SELECT turn + 1, sheet, "row", col, md5(region || '.' || sum(opens) OVER (PARTITION BY sheet, region ORDER BY p RANGE UNBOUNDED PRECEDING)) AS region FROM (
    SELECT *, CASE WHEN p > coalesce(lag(p) OVER (PARTITION BY sheet, region ORDER BY p), p) + 1 THEN 1 ELSE 0 END AS opens
    FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN "row" ELSE col END AS p FROM turns WHERE turn < 12))),
boxes AS (SELECT sheet, region, min("row") AS top, max("row") AS bottom, min(col) AS "left", max(col) AS "right", count(*) AS n_cells FROM turns WHERE turn = 12 GROUP BY ALL)
SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY top, "left") AS region, top, bottom, "left", "right", n_cells FROM boxes""",
    "pick_samples": """
WITH v AS (SELECT 'p_name' AS name, p_name AS value, p_partkey AS r FROM part UNION ALL SELECT 'p_brand', p_brand, p_partkey FROM part
  UNION ALL SELECT 'p_type', p_type, p_partkey FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR, p_partkey FROM part),
f AS (SELECT name, value, min(r) AS r FROM v WHERE trim(value) <> '' GROUP BY ALL)
SELECT name, row_number() OVER (PARTITION BY name ORDER BY r) AS "at", value FROM f QUALIFY "at" <= 5""",
    "dense_filter": "SELECT p_partkey, p_brand, p_size, p_type FROM part WHERE lower(p_brand) = 'brand#11'",
    "token_estimates": r"""
SELECT doc_id, greatest(1, floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) * 1.3::DOUBLE))::BIGINT AS by_words,
  (length(coalesce(text, '')) // 4)::BIGINT AS by_chars FROM documents""",
    "token_budget_batches": """
WITH l AS (SELECT *, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus) AS line FROM lineitem),
t AS (SELECT l_suppkey, length(line) // 4 AS tokens, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, line) AS "at" FROM l),
m AS (SELECT l_suppkey, avg(tokens) AS mean FROM t WHERE "at" <= 10 GROUP BY 1)
SELECT l_suppkey, ("at" - 1) // greatest(1, floor(190 / greatest(mean, 1.0)))::BIGINT AS batch, count(*) AS n, sum(tokens)::BIGINT AS tokens
FROM t JOIN m USING (l_suppkey) GROUP BY ALL""",
    "region_scores": f"""WITH {SCORES}
SELECT sheet, region, n_rows, n_cols, n_cells, score, chr((64 + c0)::INT) || r0 || ':' || chr((64 + c1)::INT) || r1 AS used_range,
  CASE WHEN score >= 0.55 THEN 'dense_table' WHEN n_rows >= 2 AND n_cols >= 2 THEN 'small_table' ELSE 'framing' END AS region_type FROM scores""",
    "best_regions": f"""WITH {SCORES}
SELECT sheet, region FROM scores WHERE score >= 0.55
QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY floor(score * 10 + 0.5) DESC, n_cells DESC, n_rows DESC, n_cols DESC, score DESC, region) = 1""",
    "markdown_cells": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents),
r AS (SELECT doc_id, line_number, string_split(line, '|') AS vs FROM l WHERE contains(line, '|') AND NOT regexp_matches(line, '^[\s:|-]+$'))
SELECT doc_id, line_number, unnest(range(1, len(vs) + 1)) AS col, regexp_replace(unnest(vs), '^\s+|\s+$', '', 'g') AS value FROM r""",
}
