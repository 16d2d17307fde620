"""Research in dense tables: stored rows to cells, filters, batches within a token budget, descriptions of columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import char_tokens, stripped, xml_escaped

RAW_ROWS = "array<struct<row_number:int,cells:array<struct<column_number:int,value:string>>>>"


def cells_of(tables: DataFrame, by: list[str], raw: str = "raw_rows") -> DataFrame:
    """Cells of tables stored as JSON rows: by..., row, col, value. Cells are placed by their column number, so gaps stay; malformed JSON has no cells."""
    rows = tables.select(*by, F.explode(F.from_json(raw, RAW_ROWS)).alias("line")).filter("line.row_number is not null")
    cells = rows.select(*by, F.col("line.row_number").cast("long").alias("row"), F.explode("line.cells").alias("cell"))
    return cells.filter("cell.column_number is not null").select(*by, "row", F.col("cell.column_number").cast("long").alias("col"), F.coalesce("cell.value", F.lit("")).alias("value"))


def headed(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells below the first row with the name that the first row gives their column."""
    lowest = cells.groupBy(*by).agg(F.min("row").alias("row"))  # not a window, which would put all cells of a table into one task
    heads = cells.join(lowest, [*by, "row"]).select(*by, "col", F.col("row").alias("first"), stripped(F.col("value")).alias("name"))
    return cells.join(heads, [*by, "col"]).filter(F.col("row") > F.col("first")).drop("first")


def matching_rows(cells: DataFrame, by: list[str], filters: Mapping[str, str]) -> DataFrame:
    """headed cells of the rows that equal all filters but for case; a filter on a column that a table lacks says nothing about it."""
    for name, wanted in filters.items():
        named = cells.filter(F.lower("name") == name.lower())
        having = named.select(*by).distinct()
        hit = named.filter(F.lower("value") == wanted.lower()).select(*by, "row").distinct()
        cells = cells.join(hit, [*by, "row"], "left_semi").unionByName(cells.join(having, by, "left_anti"))
    return cells


def row_lines(cells: DataFrame, by: list[str]) -> DataFrame:
    """One line per row: its values in the order of columns, joined by bars."""
    return cells.groupBy(*by, "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("col", "value")))["value"], " | ").alias("line"))


def batches(lines: DataFrame, by: list[str], budget: int, header: int = 10) -> DataFrame:
    """Lines put together to texts within a token budget, from the mean size of a table's first ten lines: by..., batch, n_rows, content."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy("row"))
    sized = lines.withColumn("at", at).withColumn("tokens", char_tokens(F.col("line")))
    mean = sized.filter("at <= 10").groupBy(*by).agg(F.greatest(F.avg("tokens"), F.lit(1.0)).alias("mean"))
    each = F.greatest(F.lit(1), F.floor((budget - header) / F.col("mean"))).cast("long")
    numbered = sized.join(mean, by).withColumn("batch", F.floor((F.col("at") - 1) / each).cast("long"))
    texts = numbered.groupBy(*by, "batch").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("all"))
    return texts.select(*by, "batch", "n_rows", F.array_join("all.line", "\n").alias("content"))


def packed_columns(columns: DataFrame, by: list[str], limit: int, position: str = "position", tokens: str = "tokens") -> DataFrame:
    """by..., position, batch: in the order of positions, a new batch starts where the next column would exceed the limit.

    A table with a column that exceeds the limit by itself can't be packed: its batches are null. Rows stream by in the order of (by, position), and only the
    last row's state is kept.
    """
    largest = columns.groupBy(*by).agg(F.max(tokens).alias("largest")).filter(F.col("largest") <= limit).drop("largest").withColumn("fits", F.lit(True))
    marked = columns.select(*by, F.col(position).cast("long").alias("position"), F.col(tokens).cast("long").alias("tokens")).join(largest, by, "left")
    ordered = marked.repartition(*by).sortWithinPartitions(*by, "position")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, used = None, 0, 0
        for part in parts:
            found = []
            for key, size, fits in zip(part[by].itertuples(index=False, name=None), part["tokens"], part["fits"]):
                if key != at:
                    at, batch, used = key, 0, 0
                if used and used + size > limit:
                    batch, used = batch + 1, 0
                used += size
                found.append(batch if fits is True else None)
            yield part[[*by, "position"]].assign(batch=pd.array(found, "Int64"))

    return ordered.mapInPandas(run, ordered.select(*by, "position").schema.add("batch", "long"))


def merged_descriptions(batches: DataFrame, by: list[str], order: str = "batch") -> DataFrame:
    """One description per column from several batches: the last one that isn't empty. batches: by..., position, batch, description."""
    real = batches.filter(stripped(F.coalesce("description", F.lit(""))) != "")
    return real.groupBy(*by, "position").agg(F.max_by("description", order).alias("description"))


def described(profiles: DataFrame, distribution: DataFrame, samples: DataFrame) -> DataFrame:
    """name and a description of each profiled column, by rule: ranges of numbers and dates, counts of booleans, the five commonest values, or three samples.

    distribution: name, rank, value of columns with few values; samples: name, at, value.
    """
    listed = lambda rows, place, most: rows.filter(F.col(place) <= most).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(F.struct(place, "value")))["value"], ", ").alias(place))
    rows = profiles.join(listed(distribution, "rank", 5), "name", "left").join(listed(samples, "at", 3), "name", "left")
    text = (
        F.when((F.col("dtype") == "numeric") & F.col("min_number").isNotNull(), F.format_string("%s contains numeric values ranging from %s to %s.", "name", F.col("min_number").cast("string"), F.col("max_number").cast("string")))
        .when(F.col("dtype") == "numeric", F.format_string("%s contains numeric values for analysis.", "name"))
        .when((F.col("dtype") == "date") & F.col("min_date").isNotNull(), F.format_string("%s contains date values from %s to %s.", "name", "min_date", "max_date"))
        .when(F.col("dtype") == "date", F.format_string("%s contains date values for time-based filtering.", "name"))
        .when(F.col("dtype") == "boolean", F.format_string("%s contains boolean values with %d true and %d false entries.", "name", "true_count", "false_count"))
        .when(F.col("rank").isNotNull(), F.format_string("%s contains categorical values such as %s.", "name", "rank"))
        .when(F.col("at").isNotNull(), F.format_string("%s contains text values such as %s.", "name", "at"))
        .otherwise(F.format_string("%s contains %s values.", "name", "dtype"))
    )
    return rows.select("name", text.alias("description"))


def suggested_queries(roles: DataFrame, titles: DataFrame, by: list[str]) -> DataFrame:
    """by..., queries: three to five questions that a table can answer, by rule. roles: by..., position, name, role; titles: by..., title."""
    first = lambda role: F.min_by("name", F.when(F.col("role") == role, F.col("position"))).alias(role)
    have = roles.groupBy(*by).agg(*map(first, ("measure", "filter", "identifier", "text_content")))
    rows = titles.join(have, by, "left")
    say = lambda text, *parts: F.format_string(text, *parts)
    both = lambda *names: F.forall(F.array(*names), lambda x: x.isNotNull())
    asked = F.array_compact(F.array(
        F.when(both("measure", "filter"), say("What is the total %s by %s?", "measure", "filter")),
        F.when(both("measure"), say("What is the average %s in %s?", "measure", "title")),
        F.when(both("filter"), say("How many rows fall into each %s category?", "filter")),
        F.when(both("identifier", "measure"), say("Which %s values have the highest %s?", "identifier", "measure")),
        F.when(both("text_content"), say("What details are recorded in %s?", "text_content")),
    ))
    asked = F.when(F.size(asked) == 0, F.array(say("What records are included in %s?", "title"))).otherwise(asked)
    padded = F.concat(asked, F.array_repeat(say("What does the %s dataset contain?", "title"), F.greatest(F.lit(0), 3 - F.size(asked))))
    return rows.select(*by, F.slice(padded, 1, 5).alias("queries"))


def routing(tables: DataFrame, by: list[str]) -> DataFrame:
    """The tables of a page as one route: the distinct ids and columns of all of them. tables: by..., region_id, filter_columns, measure_columns."""
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return tables.groupBy(*by).agg(F.array_sort(F.collect_set("region_id")).alias("region_ids"), together("filter_columns"), together("measure_columns"))


def table_xml(batches: DataFrame, by: list[str]) -> DataFrame:
    return batches.select(*by, "batch", F.concat(F.lit("<table>"), xml_escaped(F.col("content")), F.lit("</table>")).alias("xml"))
