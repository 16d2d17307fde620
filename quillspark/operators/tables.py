"""Tables inside documents: cell types, column profiles and roles, headers, filters and token budgets, layout of sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import char_tokens, column_letters, label_like, numeric, stripped, value_shape, value_type
from quillspark.sources.scratch import discard, written_by

# Parts of names that tell identifiers and measures.
IDENTIFIER_PARTS = ("id", "identifier", "reference", "ref", "account", "acct", "code", "key", "number")
MEASURE_PARTS = ("amount", "amt", "total", "balance", "revenue", "cost", "price", "value", "score", "rate", "count", "quantity", "qty", "percent", "pct")
#: Distinct values up to which a distribution is listed; samples of a column.
LISTED, SAMPLES = 20, 5


def unpivoted(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form without row numbers: name, value as text; nothing is shuffled."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(each).alias("cell")).select("cell.*")


def profile(values: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """One row per column (by..., the name unless given) of (by..., value): counts, type, and the statistics of that type.

    Values are counted by (name, value) first, so a hot value shrinks before the shuffle and the rest works on distinct values.
    """
    counted = values.groupBy(*by, "value").agg(F.count("*").alias("n"))
    kind = value_type(F.col("value"))
    rows = counted.withColumn("kind", kind).withColumn("number", numeric(F.col("value"))).withColumn("size", F.length("value"))
    real = F.col("kind") != "null"
    sum_if = lambda cond, x: F.sum(F.when(cond, x).otherwise(0))
    agg = rows.groupBy(*by).agg(
        F.sum("n").alias("row_count"),
        sum_if(~real, F.col("n")).alias("null_count"),
        F.count(F.when(real, 1)).alias("unique_count"),
        F.collect_set(F.when(real, F.col("kind"))).alias("kinds"),
        F.min(F.when(F.col("kind") == "numeric", F.col("number"))).alias("min_number"),
        F.max(F.when(F.col("kind") == "numeric", F.col("number"))).alias("max_number"),
        (F.sum(F.when(F.col("kind") == "numeric", F.col("number") * F.col("n"))) / F.sum(F.when(F.col("kind") == "numeric", F.col("n")))).alias("mean"),
        F.min(F.when(F.col("kind") == "date", F.col("value"))).alias("min_date"),
        F.max(F.when(F.col("kind") == "date", F.col("value"))).alias("max_date"),
        F.sum(F.when(F.col("kind") == "boolean", F.when(F.upper(stripped(F.col("value"))) == "TRUE", F.col("n")).otherwise(0))).alias("true_count"),
        F.sum(F.when(F.col("kind") == "boolean", F.when(F.upper(stripped(F.col("value"))) == "FALSE", F.col("n")).otherwise(0))).alias("false_count"),
        F.min(F.when(real, F.col("size"))).cast("long").alias("min_length"),
        F.max(F.when(real, F.col("size"))).cast("long").alias("max_length"),
        (sum_if(real, F.col("size") * F.col("n")) / F.nullif(sum_if(real, F.col("n")), F.lit(0))).alias("avg_length"),
    )
    dtype = F.when(F.size("kinds") == 0, "text").when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).otherwise("mixed")
    return agg.select(*by, "row_count", "null_count", "unique_count", dtype.alias("dtype"), "min_number", "max_number", F.round("mean", 4).alias("mean"), "min_date", "max_date", "true_count", "false_count", "min_length", "max_length", F.round("avg_length", 1).alias("avg_length"))


def value_distribution(values: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Values with their counts, most frequent first (rank), of the columns that have at most LISTED distinct values."""
    counted = values.filter(stripped(F.coalesce("value", F.lit(""))) != "").groupBy(*by, "value").agg(F.count("*").alias("n"))
    listed = counted.groupBy(*by).count().filter(F.col("count") <= LISTED).select(*by)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))
    return counted.join(listed, [*by], "left_semi").withColumn("rank", rank.cast("long"))


def column_roles(profiles: DataFrame) -> DataFrame:
    """profiles with role: filter, identifier, measure or text_content. Shares are of all rows, empty ones too."""
    share = F.coalesce(F.try_divide("unique_count", "row_count"), F.lit(0.0))
    has = lambda parts: F.lower("name").rlike("|".join(parts))
    unique = (F.col("unique_count") >= F.greatest(F.lit(1), F.col("row_count") - 1)) | (share >= 0.8)
    role = (
        F.when(F.col("dtype").isin("date", "boolean"), "filter")
        .when(has(IDENTIFIER_PARTS) & unique, "identifier")
        .when(F.col("dtype") == "numeric", "measure")
        .when((F.col("unique_count") <= LISTED) & ((F.col("row_count") <= LISTED) | (share <= 0.35)), "filter")
        .when(has(MEASURE_PARTS) & (F.col("dtype") == "mixed"), "measure")
        .otherwise("text_content")
    )
    return profiles.withColumn("role", role)


def first_samples(cells: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """The first SAMPLES distinct values of each column that aren't empty, in the order of rows, with their place."""
    first = cells.filter(stripped(F.coalesce("value", F.lit(""))) != "").groupBy(*by, "value").agg(F.min("row").alias("row"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy("row"))
    return first.withColumn("at", at.cast("long")).filter(F.col("at") <= SAMPLES).select(*by, "at", "value")


def header_mode(cells: DataFrame, by: list[str]) -> DataFrame:
    """Whether the first row of each table is a header: table, data_score, header_score, mode.

    cells: by..., row, col, value. The first row is data if most of its values aren't text. Else scores are added up: signs of data are a first
    value that recurs below, and one shaped like the values below; signs of a header are unique values, labels, and text over numbers.
    """
    rows = cells.withColumn("value", F.coalesce("value", F.lit(""))).withColumn("kind", value_type(F.col("value")))
    lowest = rows.groupBy(*by).agg(F.min("row").alias("first"), F.countDistinct("row").alias("n_rows"))
    rows = rows.join(lowest, by)
    top = rows.filter(F.col("row") == F.col("first")).select(*by, "col", F.col("value").alias("top"), F.col("kind").alias("top_kind"), "n_rows")
    data = rows.filter((F.col("row") > F.col("first")) & (F.col("kind") != "null")).select(*by, "row", "col", "value", "kind")
    at = F.row_number().over(Window.partitionBy(*by, "col").orderBy("row"))
    data = data.withColumn("at", at)
    kinds = data.groupBy(*by, "col", "kind").agg(F.count("*").alias("n"), F.min("row").alias("since"))
    usual = kinds.groupBy(*by, "col").agg(F.max_by("kind", F.struct("n", -F.col("since"))).alias("usual"))
    early = data.filter(F.col("at") <= 5).groupBy(*by, "col").agg(F.collect_set(value_shape(F.col("value"))).alias("shapes"), (F.countDistinct("value") < F.count("value")).alias("repeats"))
    recurs = data.join(top, [*by, "col"]).filter(F.col("value") == F.col("top")).select(*by, "col").distinct().withColumn("recurs", F.lit(True))
    each = top.filter("top_kind <> 'null'").join(usual, [*by, "col"], "left").join(early, [*by, "col"], "left").join(recurs, [*by, "col"], "left")
    again = F.coalesce("recurs", F.lit(False))
    same = F.col("top_kind") == F.col("usual")
    text = same & (F.col("usual") == "text")
    alike = F.coalesce(F.array_contains("shapes", value_shape(F.col("top"))), F.lit(False))
    data_score = F.when(again, 2).otherwise(0) + F.when(text & alike, 1).when(same & ~text, 1).otherwise(0)
    header_score = (
        F.when(text & label_like(F.col("top")), 1).otherwise(0)
        + F.when(text & ~again & F.coalesce("repeats", F.lit(False)), 1).otherwise(0)
        + F.when(~same & (F.col("top_kind") == "text") & F.col("usual").isin("numeric", "date", "boolean"), 2).when(~same & F.col("usual").isNotNull(), 1).otherwise(0)
    )
    scores = each.groupBy(*by).agg(F.sum(data_score).alias("data_score"), F.sum(header_score).alias("header_score"))
    whole = top.groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"),
        (F.count_if(~F.col("top_kind").isin("text", "null")) * 2 > F.count_if(F.col("top_kind") != "null")).alias("looks_like_data"),
        (F.countDistinct(F.lower("top")) == F.count("top")).cast("int").alias("all_unique"),
    )
    joined = whole.join(scores, by, "left").withColumns({"data_score": F.coalesce("data_score", F.lit(0)), "header_score": F.coalesce("header_score", F.lit(0)) + F.col("all_unique")})
    mode = F.when(F.col("looks_like_data"), "headerless").when(F.col("n_rows") == 1, "header").when(F.col("data_score") >= F.col("header_score") + 1, "headerless").otherwise("header")
    return joined.select(*by, "data_score", "header_score", mode.alias("mode"))


def column_names(cells: DataFrame, by: list[str], headerless: Column) -> DataFrame:
    """Names of a table's columns: letters, or the first row's values; those that occur twice get their position."""
    lowest = cells.groupBy(*by).agg(F.min("row").alias("first"))  # as a join by table and row: a window would put all cells of a table into one task
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]
    top = cells.alias("c").join(lowest.alias("l"), [*same, F.col("c.row") == F.col("l.first")], "left_semi")
    name = F.when(headerless | (stripped(F.coalesce("value", F.lit(""))) == ""), column_letters(F.col("col"))).otherwise(stripped(F.col("value")))
    named = top.withColumn("name", name)
    twice = F.count("*").over(Window.partitionBy(*by, "name")) > 1
    return named.withColumn("name", F.when(twice, F.concat("name", F.lit("_"), F.col("col").cast("string"))).otherwise(F.col("name"))).select(*by, "col", "name")


def dense_filter(rows: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Rows that equal all filters but for case; names are matched but for case too, and unknown ones are ignored."""
    known = {c.lower(): c for c in rows.columns}
    for name, value in filters.items():
        if name.lower() in known:
            rows = rows.filter(F.lower(F.col(known[name.lower()]).cast("string")) == value.lower())
    return rows


def row_text(columns: Sequence[str]) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def token_batches(rows: DataFrame, by: list[str], order: list[Column], text: str, budget: int, header: int = 10) -> DataFrame:
    """rows with the number of their batch: as many rows each as the budget holds at the mean size of the group's first 10 rows."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    sized = rows.withColumn("at", at).withColumn("tokens", char_tokens(F.col(text)))
    mean = sized.filter("at <= 10").groupBy(*by).agg(F.avg("tokens").alias("mean"))
    each = F.greatest(F.lit(1), F.floor((budget - header) / F.greatest(F.col("mean"), F.lit(1.0)))).cast("long")
    return sized.join(mean, by).withColumn("batch", F.floor((F.col("at") - 1) / each).cast("long")).drop("mean", "at")


def in_runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells with `first`: the column where the run of neighbouring cells of their row begins. No blank column can cut a run, so layout works on runs."""
    order = Window.partitionBy(*by, "row").orderBy("col")
    opens = F.coalesce(F.col("col") > F.lag("col").over(order) + 1, F.lit(True))
    marked = cells.filter("row is not null and col is not null").withColumn("opens", opens)
    return marked.withColumn("first", F.max(F.when(F.col("opens"), F.col("col"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def bands(runs: DataFrame, by: list[str], low: str, high: str, corner: str) -> DataFrame:
    """runs with a region's corner (top or left) set anew: to where their band begins, after the last row or column that nothing uses."""
    order = Window.partitionBy(*by, "top", "left").orderBy(low, high)
    reached = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("opens", F.coalesce(F.col(low) > reached + 1, F.lit(True)))
    return marked.withColumn(corner, F.max(F.when(F.col("opens"), F.col(low))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def region_runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Runs of cells with their region: by..., row, first, last, n (cells), region. Sheets are split at blank rows and columns, in turns, until nothing can be split.

    A region is told by its corner: bands lie apart, so no two regions of a sheet share one. Sheets are dealt once; two turns split all of them and are written, without a shuffle.
    """
    runs = in_runs(cells, by).groupBy(*by, "row", "first").agg(F.max("col").alias("last"), F.count("*").alias("n"))
    runs = written_by(runs.withColumns({c: F.lit(0).cast("long") for c in ("top", "left")}), "runs", by)
    turn = lambda r: bands(bands(r, by, "row", "row", "top"), by, "first", "last", "left")
    moved = True
    while moved:
        before, once = runs, turn(runs).withColumns({"was_top": F.col("top"), "was_left": F.col("left")})
        split = turn(once).withColumn("moved", (F.col("top") != F.col("was_top")) | (F.col("left") != F.col("was_left")))
        runs = written_by(split.drop("was_top", "was_left"), "runs", by)
        discard(before)
        moved = not runs.filter("moved").isEmpty()
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("top", "left")).cast("long")
    return runs.select(*by, "row", "first", "last", "n", number.alias("region"))


def regions(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells with region: the number of theirs, as in region_runs. Cells are dealt by their sheets once and written."""
    dealt = written_by(cells, "cells", by)
    return in_runs(dealt, by).join(region_runs(dealt, by).select(*by, "row", "first", "region"), [*by, "row", "first"]).select(*cells.columns, "region")


def grid_stats(cells: DataFrame, by: list[str]) -> DataFrame:
    """Bounds and counts of a grid's filled cells: by..., min_row, max_row, min_col, max_col, n_cells, populated_rows, populated_cols, formula_cells, widest_row."""
    filled = cells.filter(stripped(F.coalesce("value", F.lit(""))) != "")
    of_row = filled.groupBy(*by, "row").agg(F.count("*").alias("width"), F.min("col").alias("first"), F.max("col").alias("last"), F.count_if(F.col("value").startswith("=")).alias("formulas"))
    whole = of_row.groupBy(*by).agg(
        F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("first").alias("min_col"), F.max("last").alias("max_col"), F.sum("width").alias("n_cells"),
        F.count("*").alias("populated_rows"), F.sum("formulas").alias("formula_cells"), F.max("width").alias("widest_row"),
    )
    used = filled.select(*by, "col").distinct().groupBy(*by).agg(F.count("*").alias("populated_cols"))
    return whole.join(used, by)


def upper_medians(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by..., middle and n: the value in the middle (of two the larger one) and how many there are. Values are counted first, so a group is as large as it has different values."""
    counted = values.groupBy(*by, value).agg(F.count("*").alias("times"))
    group = Window.partitionBy(*by)
    placed = counted.withColumn("upto", F.sum("times").over(group.orderBy(value))).withColumn("n", F.sum("times").over(group))
    return placed.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(value).alias("middle"), F.first("n").alias("n"))


def region_scores(cells: DataFrame, by: list[str]) -> DataFrame:
    """How much a region looks like a dense table (0 to 0.99), from the regularity of its rows, its fill, its shape and its texts. cells: by..., row, col, value."""
    filled = cells.filter(stripped(F.coalesce("value", F.lit(""))) != "")
    rows = filled.groupBy(*by, "row").agg(F.count("*").alias("width"))
    widths = upper_medians(rows, by, "width").withColumnRenamed("middle", "usual")
    alike = F.count_if(F.abs(F.col("width") - F.col("usual")) <= 1).alias("alike")
    shape = rows.join(widths, by).groupBy(*by).agg(F.min_by("width", "row").alias("header_width"), alike, F.max("n").alias("n_filled"))
    regular = F.col("alike") / F.col("n_filled")
    lengths = upper_medians(filled.select(*by, F.length("value").alias("size")), by, "size").select(*by, F.col("middle").alias("length"))
    sizes = filled.groupBy(*by).agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.count("*").alias("n_cells"))
    length = F.col("length")
    long_text = F.when(length >= 80, 1.0).when(length <= 20, 0.0).otherwise((length - 20) / 60)
    n_rows, n_cols = F.col("max_row") - F.col("min_row") + 1, F.col("max_col") - F.col("min_col") + 1
    one = lambda x: F.least(F.lit(1.0), x)
    # fixed values: the weights of a region's features and the score of a dense table
    score = (
        0.35 * regular
        + 0.25 * (F.col("n_cells") / (n_rows * n_cols))
        + 0.2 * (F.least(n_rows / n_cols, F.lit(2.0)) / 2 * one(n_cols / 3))
        + 0.1 * one(F.col("header_width") / n_cols)
        + 0.1 * (1 - long_text)
        + F.when(n_rows >= 3, 0.05).otherwise(0.0)
    )
    score = F.when((n_rows < 2) | (n_cols < 2), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)), 4))
    joined = sizes.join(shape, by).join(lengths, by)
    used = F.concat(column_letters(F.col("min_col")), F.col("min_row").cast("string"), F.lit(":"), column_letters(F.col("max_col")), F.col("max_row").cast("string"))
    return joined.select(*by, n_rows.alias("n_rows"), n_cols.alias("n_cols"), "n_cells", score.alias("score"), used.alias("used_range"), F.when(score >= 0.55, "dense_table").when((n_rows >= 2) & (n_cols >= 2), "small_table").otherwise("framing").alias("region_type"))


def best_region(scores: DataFrame, by: list[str], region: str = "region") -> DataFrame:
    """The densest region of each sheet of at least 0.55: by score in tenths, then cells, rows, columns, score."""
    rank = F.struct(F.floor(F.col("score") * 10 + 0.5), "n_cells", "n_rows", "n_cols", "score", -F.col(region))
    return scores.filter("score >= 0.55").groupBy(*by).agg(F.max_by(region, rank).alias(region))


def markdown_cells(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """Pipe tables in a text to cells: by..., line, col, value. Escaped bars stay; separator rows are left out."""
    lines = docs.select(*by, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    rows = lines.withColumn("line", stripped(F.col("line"))).filter(F.col("line").rlike(r"^\|.+\|$") & ~F.col("line").rlike(r"^\|[\s:|-]+\|$"))
    values = F.split(F.expr("substring(line, 2, length(line) - 2)"), r"(?<!\\)\|", -1)
    return rows.select(*by, (F.col("at") + 1).cast("long").alias("line_number"), F.posexplode(values).alias("col", "value")).select(*by, "line_number", (F.col("col") + 1).cast("long").alias("col"), F.replace(stripped(F.col("value")), F.lit("\\|"), F.lit("|")).alias("value"))
