"""Queries on the analysis of many tables: the lines of each order are a stored region, and the orders of each customer a pipe table in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import table_analysis
from quillspark.sources.tables import dealt, table

HEADS = ("line no.", "quantity", "ship date", "return flag")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored regions: columns B to E, rows from 3 on. Orders with an odd key have a header row; of returned lines the flag is missing; a line with a discount of 0 has its number as text, and is no row."""
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"), "l_orderkey")
    cell = lambda number, value: F.struct(F.lit(number).alias("column_number"), value.cast("string").alias("value"))
    cells = F.array(cell(2, F.col("l_linenumber")), cell(3, F.col("l_quantity")), cell(4, F.date_format("l_shipdate", "yyyy-MM-dd")), cell(5, F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))))
    values = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", cells.alias("cells"))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(values)).alias("lines"))  # an order's lines
    row = lambda number, own, text: F.concat(F.lit('{"row_number":'), F.when(text, F.concat(F.lit('"'), number.cast("string"), F.lit('"'))).otherwise(number.cast("string")), F.lit(',"cells":'), own, F.lit("}"))
    body = F.transform("lines", lambda x, i: row(i + 4, F.to_json(x["cells"], {"ignoreNullFields": "false"}), x["l_discount"] == 0))
    head = row(F.lit(3), F.lit("[" + ",".join(f'{{"column_number":{i + 2},"value":"{h}"}}' for i, h in enumerate(HEADS)) + "]"), F.lit(False))
    rows = F.when(F.col("l_orderkey") % 2 == 1, F.concat(F.array(head), body)).otherwise(body)
    raw = F.concat(F.lit('{"region_id":"r'), F.col("l_orderkey").cast("string"), F.lit('","used_range":"B3:E9","column_numbers":[2,3,4,5],"rows":['), F.array_join(rows, ","), F.lit("]}"))
    return per.select(F.col("l_orderkey").alias("id"), raw.alias("raw"))


def region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, _ = table_analysis.analysed(table_analysis.from_regions(regions(spark, sf_dir), ["id"]))
    return tables.select("id", "row_count", "header_row", "header_mode", "used_range", "region_id", "token_count", F.size("sample_rows").cast("long").alias("n_samples"))


def region_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, columns = table_analysis.analysed(table_analysis.from_regions(regions(spark, sf_dir), ["id"]))
    return columns.select("id", "place", "position", "name", "dtype", "non_null_count", "null_count", "unique_count", "min_number", "max_number", "min_date", "max_date")


def raw_region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = table_analysis.raw_rows(regions(spark, sf_dir), ["id"])
    return cells.select("id", "row", "col", "value")


def rejected_region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = table_analysis.raw_rows(regions(spark, sf_dir), ["id"])
    return rejected.groupBy("id", "reason").agg(F.count("*").alias("n"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each customer: what is before its table, the table of its orders with names below the letters, and what is after it."""
    orders = table(spark, sf_dir, "orders")
    line = F.format_string("| %d | %s | %s |", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"))
    per = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("lines"))  # a customer's orders
    head = F.lit("# Orders\n- Used range: A1:B9\n\n| Row | A | B |\n| --- | --- | --- |\n| 2 | Ordered on | How urgent |\n")
    text = F.concat(head, F.array_join("lines.line", "\n"), F.lit("\n\nEnd of orders"))
    return per.select(F.col("o_custkey").alias("id"), text.alias("text"))


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, _ = table_analysis.analysed(table_analysis.from_markdown(texts(spark, sf_dir), ["id"]))
    return tables.select("id", "row_count", "header_row", "header_mode", "framing", "used_range", "token_count", F.element_at("sample_rows", -1).alias("last_sample"))


def markdown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, columns = table_analysis.analysed(table_analysis.from_markdown(texts(spark, sf_dir), ["id"]))
    return columns.select("id", "place", "position", "name", "dtype", "non_null_count", "unique_count", "min_date", "max_date", "min_length", F.get("sample_values", F.lit(0)).alias("first_value"))


QUERIES = {f.__name__: f for f in (region_tables, region_columns, raw_region_cells, rejected_region_rows, markdown_tables, markdown_columns)}

REGIONS = """
numbered AS (
  SELECT l_orderkey AS id, 3 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS row, l_discount <> 0 AS kept,
    l_linenumber::TEXT AS c2, l_quantity::TEXT AS c3, strftime(l_shipdate, '%Y-%m-%d') AS c4, CASE WHEN l_returnflag <> 'R' THEN l_returnflag ELSE '' END AS c5 FROM lineitem),
good AS (SELECT * FROM numbered WHERE kept),
long AS (SELECT id, row, unnest([2, 3, 4, 5]) AS col, unnest([c2, c3, c4, c5]) AS value FROM good),
heads AS (SELECT DISTINCT id, unnest([2, 3, 4, 5]) AS col, unnest(['line no.', 'quantity', 'ship date', 'return flag']) AS value FROM numbered WHERE id % 2 = 1),
ids AS (SELECT DISTINCT id FROM numbered),
per AS (SELECT id, count(*) AS n FROM good GROUP BY id)"""

SQL = {
    "region_tables": f"""WITH {REGIONS}
SELECT id, coalesce(n, 0) AS row_count, CASE WHEN id % 2 = 1 THEN 3 ELSE 0 END::BIGINT AS header_row, CASE WHEN id % 2 = 1 THEN 'header_row' ELSE 'headerless' END AS header_mode,
  'B3:E9' AS used_range, 'r' || id AS region_id, 1::BIGINT AS token_count, least(coalesce(n, 0), 8) AS n_samples
FROM ids LEFT JOIN per USING (id)""",
    "region_columns": f"""WITH {REGIONS},
profiles AS (
  SELECT id, col, count(*) FILTER (value <> '') AS non_null_count, count(*) FILTER (value = '') AS null_count, count(DISTINCT value) FILTER (value <> '') AS unique_count,
    min(TRY_CAST(value AS DOUBLE)) FILTER (col <= 3) AS min_number, max(TRY_CAST(value AS DOUBLE)) FILTER (col <= 3) AS max_number, min(value) FILTER (col = 4) AS min_date, max(value) FILTER (col = 4) AS max_date FROM long GROUP BY id, col),
columns AS (SELECT id, unnest([2, 3, 4, 5]) AS col FROM ids WHERE id % 2 = 1 OR id IN (SELECT id FROM per))
SELECT id, (col - 1)::BIGINT AS place, chr(64 + col) AS position, coalesce(heads.value, chr(64 + col)) AS name,
  CASE WHEN coalesce(non_null_count, 0) = 0 OR col = 5 THEN 'text' WHEN col = 4 THEN 'date' ELSE 'numeric' END AS dtype,
  coalesce(non_null_count, 0) AS non_null_count, coalesce(null_count, 0) AS null_count, coalesce(unique_count, 0) AS unique_count, min_number, max_number, min_date, max_date
FROM columns LEFT JOIN profiles USING (id, col) LEFT JOIN heads USING (id, col)""",
    "raw_region_cells": f"WITH {REGIONS} SELECT id, row, col::BIGINT AS col, value FROM long UNION ALL SELECT id, 3, col, value FROM heads",
    "rejected_region_rows": f"WITH {REGIONS} SELECT id, 'row_number is no integer' AS reason, count(*) AS n FROM numbered WHERE NOT kept GROUP BY id",
    "markdown_tables": """
SELECT o_custkey AS id, count(*) AS row_count, 2::BIGINT AS header_row, 'header_row' AS header_mode, '# Orders' || chr(10) || '- Used range: A1:B9' || chr(10) || chr(10) || 'End of orders' AS framing, 'A1:B9' AS used_range,
  floor(1.3 * (32 + sum(6 + len(string_split(o_orderpriority, ' ')))))::BIGINT AS token_count, max_by('| ' || o_orderkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || o_orderpriority || ' |', o_orderkey) AS last_sample
FROM orders GROUP BY o_custkey""",
    "markdown_columns": """
WITH v AS (SELECT o_custkey AS id, o_orderkey, unnest([1, 2]) AS place, unnest([strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]) AS value FROM orders)
SELECT id, place::BIGINT AS place, chr(64 + place) AS position, CASE place WHEN 1 THEN 'Ordered on' ELSE 'How urgent' END AS name, CASE place WHEN 1 THEN 'date' ELSE 'text' END AS dtype, count(*) AS non_null_count, count(DISTINCT value) AS unique_count,
  min(value) FILTER (place = 1) AS min_date, max(value) FILTER (place = 1) AS max_date, min(length(value)) FILTER (place = 2) AS min_length, arg_min(value, o_orderkey) AS first_value
FROM v GROUP BY id, place""",
}
