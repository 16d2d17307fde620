"""Sheets as text: regions between markers, previews, replacements, samples; and how visuals, tables and columns are matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import column_letters, stripped

# Lines of a preview at its two ends and their length, and what stands between; points of a series.
HEAD, TAIL, LINE, OMITTED = 24, 10, 300, "... omitted sheet rows ..."
POINTS = 12


def table_cell(text: Column) -> Column:
    """Safe in a pipe table: bars escaped, line ends as spaces."""
    return F.regexp_replace(F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("|"), F.lit("\\|")), "\n", " ")


def pipe_line(first: Column, values: Column) -> Column:
    return F.concat(F.lit("| "), first, F.lit(" | "), F.array_join(values, " | "), F.lit(" |"))


def region_lines(cells: DataFrame, by: list[str], region: str = "region") -> DataFrame:
    """Every region as a pipe table between markers: by..., region, place, line, to be read in the order of place (-3, -2, -1, the rows, and the end).

    cells: by..., region, row, col, value. Columns are those with a cell in the region; lines stay rows, as a region may have millions.
    """
    columns = cells.groupBy(*by, region).agg(F.array_sort(F.collect_set("col")).alias("columns"), F.max("row").alias("last"))
    name = F.col(region).cast("string")
    mark = lambda what: F.concat(F.lit("<!-- region:"), name, F.lit(f" {what} -->"))
    letters = F.transform("columns", column_letters)
    frame = F.array(
        F.struct(F.lit(-3).cast("long").alias("place"), mark("start").alias("line")),
        F.struct(F.lit(-2).cast("long").alias("place"), pipe_line(F.lit("Row"), letters).alias("line")),
        F.struct(F.lit(-1).cast("long").alias("place"), pipe_line(F.lit("---"), F.transform("columns", lambda c: F.lit("---"))).alias("line")),
        F.struct((F.col("last") + 1).cast("long").alias("place"), mark("end").alias("line")),
    )
    of_row = cells.groupBy(*by, region, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("value")))).alias("values"))
    rows = of_row.join(columns, [*by, region])
    values = F.transform("columns", lambda c: table_cell(F.coalesce(F.try_element_at("values", c), F.lit(""))))
    body = rows.select(*by, region, F.col("row").cast("long").alias("place"), pipe_line(F.col("row").cast("string"), values).alias("line"))
    return body.unionByName(columns.select(*by, region, F.explode(frame).alias("f")).select(*by, region, "f.*"))


def preview(text: Column) -> Column:
    """The first HEAD and last TAIL lines, each cut at LINE characters."""
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1)
    short = lambda part: F.transform(part, lambda x: F.when(F.length(x) > LINE, F.concat(F.left(x, F.lit(LINE)), F.lit(" ..."))).otherwise(x))
    ends = F.concat(short(F.slice(lines, 1, HEAD)), F.array(F.lit(OMITTED)), short(F.slice(lines, -TAIL, TAIL)))
    return F.array_join(F.when(F.size(lines) <= HEAD + TAIL, short(lines)).otherwise(ends), "\n")


def without_markers(text: Column) -> Column:
    """Without the lines of region markers; of several blank lines one stays."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~stripped(x).rlike(r"^<!-- region:.*-->$"))
    return stripped(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def spliced(text: Column, replacements: Column) -> Column:
    """text with each region's block replaced (an array of structs region_id, replacement); if a block is missing, the replacements alone, a blank line between."""
    start = F.struct(text.alias("text"), F.lit(True).alias("found"))

    def step(acc: Column, r: Column) -> Column:
        opening, closing = (F.concat(F.lit("<!-- region:"), r["region_id"], F.lit(f" {w} -->")) for w in ("start", "end"))
        begin = F.position(opening, acc["text"])
        end = F.position(closing, acc["text"], begin + F.length(opening))
        past = end + F.length(closing)
        rest = F.substring(acc["text"], past + F.when(F.substring(acc["text"], past, F.lit(1)) == "\n", 1).otherwise(0), F.length(acc["text"]))
        new = F.concat(F.left(acc["text"], begin - 1), stripped(r["replacement"]), rest)
        hit = (begin > 0) & (end > 0) & (stripped(r["region_id"]) != "")
        return F.struct(F.when(hit, new).otherwise(acc["text"]).alias("text"), (acc["found"] & hit).alias("found"))

    done = F.aggregate(replacements, start, step)
    alone = F.array_join(F.filter(F.transform(replacements, lambda r: stripped(r["replacement"])), lambda x: x != ""), "\n\n")
    return F.when(done["found"], without_markers(done["text"])).otherwise(alone)


def padded_line(values: Column, width: Column | int) -> Column:
    """Values joined by bars, filled up or cut to a width."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.array_join(F.slice(F.concat(values, F.array_repeat(F.lit(""), width)), F.lit(1), width), " | ")


def sample_rows(rows: DataFrame, by: list[str], order: list[str], head: int = 5, tail: int = 3) -> DataFrame:
    """The first head and the last tail rows of each group; all, if there are no more."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    last = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumns({"first": first, "last": last}).filter((F.col("first") <= head) | (F.col("last") <= tail)).drop("first", "last")


def used_range(text: Column) -> Column:
    return stripped(F.regexp_extract(text, r"(?m)^- Used range: (.+)$", 1))


def framing(text: Column) -> Column:
    """What stands before and after the pipe table of a text, a blank line between."""
    lines = F.split(text, "\n", -1)
    piped = F.transform(lines, lambda x: stripped(x).startswith("|"))
    first = F.array_position(piped, True)
    last = F.size(lines) - F.array_position(F.reverse(piped), True) + 1
    part = lambda a: stripped(F.array_join(a, "\n"))
    both = F.array(part(F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))), part(F.slice(lines, (last + 1).cast("int"), F.size(lines))))
    return F.when(first == 0, stripped(text)).otherwise(F.array_join(F.filter(both, lambda x: x != ""), "\n\n"))


def linked_visuals(regions: DataFrame, visuals: DataFrame, by: list[str]) -> DataFrame:
    """by..., region, visual: the visuals whose anchor lies inside a region. regions: by..., region, min_row ... max_col; visuals: by..., visual, anchor_row, anchor_col."""
    inside = F.col("anchor_row").between(F.col("min_row"), F.col("max_row")) & F.col("anchor_col").between(F.col("min_col"), F.col("max_col"))
    return regions.join(visuals, by).filter(inside).select(*by, "region", "visual")


def typed_regions(regions: DataFrame, visuals: DataFrame, by: list[str]) -> DataFrame:
    """regions with visuals, the number of linked ones, and kind: mixed, dense_table, small_table or framing. regions: by..., region, native, score, bounds."""
    linked = linked_visuals(regions, visuals, by).groupBy(*by, "region").agg(F.count("*").alias("visuals"))
    rows = regions.join(linked, [*by, "region"], "left").withColumn("visuals", F.coalesce("visuals", F.lit(0)))
    wide = (F.col("max_row") > F.col("min_row")) & (F.col("max_col") > F.col("min_col"))
    return rows.withColumn("kind", F.when(F.col("visuals") > 0, "mixed").when(F.col("native") | (F.col("score") >= 0.55), "dense_table").when(wide, "small_table").otherwise("framing"))


def uncovered(cells: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """Cells that lie in no native table. tables: by..., min_row ... max_col."""
    t = tables.select(*[F.col(c).alias(f"t_{c}") for c in (*by, "min_row", "max_row", "min_col", "max_col")])
    same = [F.col(c) == F.col(f"t_{c}") for c in by]
    inside = F.col("row").between(F.col("t_min_row"), F.col("t_max_row")) & F.col("col").between(F.col("t_min_col"), F.col("t_max_col"))
    condition = inside
    for s in same:
        condition = condition & s
    return cells.join(t, condition, "left_anti")


def resolved_columns(references: DataFrame, columns: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """references with position: that of the column with this position, else of the first one with this name; null if there is neither."""
    spots = columns.select(*by, F.col("position").alias("at")).distinct()
    names = columns.groupBy(*by, "name").agg(F.min("position").alias("named"))
    rows = references.join(spots.withColumn(key, F.col("at")), [*by, key], "left").join(names.withColumnRenamed("name", key), [*by, key], "left")
    return rows.withColumn("position", F.coalesce("at", "named")).drop("at", "named")


def series_points(categories: Column, values: Column, most: int = POINTS) -> Column:
    """Categories and values of a series in pairs, the shorter one filled up with nulls; the first `most`."""
    return F.slice(F.arrays_zip(categories.alias("category"), values.alias("value")), 1, most)


def column_table(columns: DataFrame, by: list[str]) -> DataFrame:
    """by..., text: a pipe table of a table's columns. columns: by..., position, name, dtype, description."""
    line = F.concat(F.lit("| "), table_cell(F.col("name")), F.lit(" | "), F.col("dtype"), F.lit(" | "), table_cell(F.coalesce("description", F.lit(""))), F.lit(" |"))
    rows = columns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return rows.select(*by, F.concat(F.lit("| Column | Type | Description |\n| --- | --- | --- |\n"), F.array_join("lines.line", "\n")).alias("text"))


def role_section(columns: DataFrame, by: list[str]) -> DataFrame:
    """by..., text: the columns of each role under a heading. columns: by..., position, name, role, low and high (texts, may be null), values."""
    label = table_cell(F.col("name"))
    line = (
        F.when(F.col("role") == "filter", F.concat(F.lit("- "), label, F.when(F.col("values").isNotNull(), F.concat(F.lit(": "), F.col("values"))).otherwise("")))
        .when(F.col("role") == "measure", F.concat(F.lit("- "), label, F.when(F.col("low").isNotNull(), F.concat(F.lit(": "), F.col("low"), F.lit(" to "), F.col("high"))).otherwise("")))
        .otherwise(label)
    )
    order = {"filter": "### Filter Columns", "identifier": "### Identifiers", "measure": "### Measures", "text_content": "### Text Content"}
    part = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("position", line.alias("line")))))["line"]
    rows = columns.groupBy(*by).agg(*[part(role).alias(role) for role in order])
    section = lambda role, title: F.when(F.size(role) > 0, F.concat(F.lit(title + "\n"), F.array_join(role, "\n") if role in ("filter", "measure") else F.concat(F.lit("- "), F.array_join(role, ", "))))
    return rows.select(*by, F.array_join(F.array_compact(F.array(*[section(r, t) for r, t in order.items()])), "\n\n").alias("text"))
