"""Analysis of many tables of any width in one plan: stored regions or pipe tables in texts to rows, header, column profiles and samples.

A table comes as one text in one row, and is analysed in that row: its cells are lists by column, sorted by their row, so tables of different widths go through the same
plan and nothing is shuffled, joined or written. Each list is sorted once, so the work of a table follows its cells. Cells that a row lacks are empty; they are counted and not made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import DATE_CELL, IN_BRACKETS, NUMBER, bound, column_letters, label_like, stripped, trimmed, value_shape, word_tokens
from quillspark.operators import tables as profiles

#: Values below the first row whose shapes are compared with it; rows at both ends that are shown.
COMPARED, HEAD, TAIL = 5, 5, 3


@dataclass
class Tables:
    """grids: by..., columns (name of each place), shown, framing, used_range, region_id, token_count, rows (number and line of each), cells (for each place: at, value, bare, number, kind).

    shown: whether a row's line is made from its cells; line: its text, if it has one. at is a cell's row, from 0; cells without a value aren't listed.
    """

    by: list[str]
    grids: DataFrame


def worked(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """df's columns `keep` and new ones, each worked out once for a row: as columns of a projection, they would be put wherever a later one names them."""
    return df.select(*keep, F.explode(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))).alias("worked")).select(*keep, "worked.*")


def none_of(kind: str) -> Column:
    """An empty list."""
    return F.array().cast(f"array<{kind}>")


def runs(entries: Column, key: str) -> Column:
    """Entries in their order, cut where their key changes: a list of lists."""

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i)[key] != F.get(s, i - 1)[key])))
        return bound(starts, lambda at: F.transform(at, lambda i, j: F.slice(s, i + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - i)))

    return bound(F.sort_array(entries), cut)


def number_of(bare: Column) -> Column:
    """numeric() of a value without white space at its ends."""
    inner = F.regexp_extract(bare, IN_BRACKETS, 1)
    marked = F.translate(F.when(inner != "", F.concat(F.lit("-"), inner)).otherwise(bare), "$,%", "")
    plain = lambda x: F.when(x.rlike(NUMBER), x.try_cast("double"))
    return F.when(bare.rlike(r"[$,%(]"), bound(marked, plain)).otherwise(plain(bare))


def typed(cells: Column) -> Column:
    """Cells (at, value) with their bare value, its number if it is one, and its type as of value_type()."""
    bare = F.transform(cells, lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), trimmed(c["value"]).alias("bare")))
    numbered = F.transform(bare, lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), c["bare"].alias("bare"), number_of(c["bare"]).alias("number")))
    kind = lambda c: F.when(c["bare"] == "", "null").when(c["number"].isNotNull(), "numeric").when(F.upper(c["bare"]).isin("TRUE", "FALSE"), "boolean").when(c["bare"].rlike(DATE_CELL), "date").otherwise("text")
    return F.transform(numbered, lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), c["bare"].alias("bare"), c["number"].alias("number"), kind(c).alias("kind")))


def by_place(df: DataFrame, keep: Sequence[str], numbers: Column) -> DataFrame:
    """df's flat cells (col, at, turn, value) as lists for each of the numbers of columns: keep..., numbers, cells. Of cells of a row with the same column the last one counts.

    numbers may name used, the columns that have cells.
    """
    last = lambda g: F.filter(g, lambda c, i: F.coalesce(F.get(g, i + 1)["at"] != c["at"], F.lit(True)))
    lists = F.transform(runs(F.col("flat"), "col"), last)
    df = worked(df, keep, lists=lists)
    df = worked(df, [*keep, "lists"], used=F.transform("lists", lambda g: F.get(g, F.lit(0))["col"]))
    df = worked(df, [*keep, "lists", "used"], numbers=numbers)
    filled = lambda g: typed(F.filter(g, lambda c: c["value"] != ""))
    placed = bound(F.map_from_arrays("used", "lists"), lambda m: F.transform("numbers", lambda n: F.coalesce(F.try_element_at(m, n), none_of("struct<col:bigint,at:int,turn:int,value:string>"))))
    return worked(df, [*keep, "numbers"], cells=F.transform(placed, filled))


def kind_of(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def is_integer(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "BIGINT", F.lit(False))


def text_of(value: Column) -> Column:
    """A cell's value as text: null and missing are empty, true and false begin with a capital."""
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce(F.when(kind_of(value) == "BOOLEAN", F.initcap(text)).when(kind_of(value).isin("OBJECT", "ARRAY"), F.to_json(value)).otherwise(text), F.lit(""))


def cell_text(value: Column) -> Column:
    """text_of, without looking further at strings, which most cells are."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(text_of(value))


#: What stored rows are read as; what is no object or no list is null there, fields may be of any kind.
RAW_ROWS = "array<struct<row_number:variant,cells:array<struct<column_number:variant,value:variant>>>>"


def raw_cells(cells: Column) -> Column:
    """Cells of RAW_ROWS to (place, reason, col, value); those without a reason are sound."""
    wrong = lambda c: F.when(c.isNull(), "cell is no object").when(~is_integer(c["column_number"]), "column_number is no integer")
    told = F.transform(cells, lambda c, i: F.struct(i.alias("place"), wrong(c).alias("reason"), c["column_number"].alias("number"), c["value"].alias("value"), F.schema_of_variant(c["value"]).alias("kind")))
    text = lambda c: F.when(c["kind"] == "STRING", F.try_variant_get(c["value"], "$", "string")).otherwise(text_of(c["value"]))
    sound = lambda c, x: F.when(c["reason"].isNull(), x)
    return F.transform(told, lambda c: F.struct(c["place"].alias("place"), c["reason"].alias("reason"), sound(c, F.try_variant_get(c["number"], "$", "long")).alias("col"), sound(c, text(c)).alias("value")))


def raw_rows(regions: DataFrame, by: Sequence[str], raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Stored regions, JSON texts of an object with the list rows, to their cells and to what is rejected.

    A row is an object with an integer row_number and a list of cells; a cell is an object with an integer column_number. Cells: by..., at (the row's place in the list), row, place
    (the cell's in its row), col, value; a row without cells has one whose col is null. Rejected: by..., at, place, reason; at is null for a whole region, place for a whole row.

    Each step is a column or an array's element that the next one reads: as conditions of filters, texts would be parsed again for each of them.
    """
    region = F.transform(F.array(F.try_parse_json(raw)), lambda v: F.struct(v.alias("v"), F.try_variant_get(v, "$.rows", RAW_ROWS).alias("rows")))
    # what a region or its rows are instead is looked for only where rows or cells are missing
    whole = lambda x: F.when(x["rows"].isNull(), F.when(x["v"].isNull(), "no JSON").when(kind_of(x["v"]) != "OBJECT", "no object").when(F.try_variant_get(x["v"], "$.rows", "variant").isNotNull(), "rows is no list"))
    loose = lambda x: F.when(F.exists(x["rows"], lambda r: r["cells"].isNull()), F.try_variant_get(x["v"], "$.rows", "array<map<string,variant>>"))
    read = regions.select(*by, F.explode_outer(F.transform(region, lambda x: F.struct(whole(x).alias("reason"), x["rows"].alias("rows"), loose(x).alias("loose")))).alias("x")).select(*by, "x.*")
    is_list = lambda r, i: r["cells"].isNotNull() | F.try_element_at(F.get("loose", i), F.lit("cells")).isNull()  # noqa: E731  or missing
    bad = lambda r, i: F.when(r.isNull(), "row is no object").when(~is_integer(r["row_number"]), "row_number is no integer").when(~is_list(r, i), "cells is no list")
    told = F.transform("rows", lambda r, i: F.struct(bad(r, i).alias("reason"), r["row_number"].alias("number"), r["cells"].alias("cells")))
    rows = read.select(*by, F.col("reason").alias("whole"), F.posexplode_outer(told).alias("at", "r")).select(*by, "whole", "at", F.col("r.reason").alias("reason"), F.try_variant_get("r.number", "$", "long").alias("row"), F.col("r.cells").alias("cells"))
    sound = rows.filter("whole is null and reason is null and at is not null")
    found = sound.select(*by, "at", "row", F.explode_outer(raw_cells(F.col("cells"))).alias("c")).select(*by, "at", "row", "c.*")
    none = F.lit(None).cast("int")
    kind = "array<struct<at:int,place:int,reason:string>>"
    one = F.when(F.col("whole").isNotNull(), F.array(F.struct(none.alias("at"), none.alias("place"), F.col("whole").alias("reason")))).when(F.col("reason").isNotNull(), F.array(F.struct("at", none.alias("place"), "reason")))
    of_cells = F.transform(F.filter(raw_cells(F.col("cells")), lambda c: c["reason"].isNotNull()), lambda c: F.struct(F.col("at"), c["place"].alias("place"), c["reason"].alias("reason")))
    rejected = rows.select(*by, F.explode_outer(F.coalesce(one.cast(kind), of_cells.cast(kind))).alias("c")).filter("c is not null").select(*by, "c.at", "c.place", "c.reason")
    return found.select(*by, "at", "row", "place", "col", "value"), rejected


def from_regions(regions: DataFrame, by: Sequence[str], raw: str = "raw", framing: str | None = None, source: str | None = None) -> Tables:
    """Stored regions as tables; what raw_rows rejects has no part. framing, source: columns with the text around a region, and with the text that its tokens are counted of.

    Columns are those of column_numbers, or else those of the cells; rows are those of row_numbers in that order, then the others; without row_numbers all by number. Of rows with the same
    number the last one counts, of cells of a row with the same column too.
    """
    by = list(by)
    texts = [F.coalesce(F.col(c), F.lit("")).alias(n) if c else F.lit("").alias(n) for c, n in ((framing, "framing"), (source, "source"))]
    heads = [*by, "framing", "source"]
    df = worked(regions.select(*by, *texts, F.col(raw).alias("raw")), heads, v=F.try_parse_json("raw"))
    ints = lambda name: F.transform(F.filter(F.coalesce(F.try_variant_get("v", f"$.{name}", "array<variant>"), none_of("variant")), is_integer), lambda x: F.try_variant_get(x, "$", "long"))
    said = lambda name: stripped(text_of(F.try_variant_get("v", f"$.{name}", "variant")))
    stored = F.coalesce(F.try_variant_get("v", "$.rows", RAW_ROWS), F.array().cast(RAW_ROWS))
    df = worked(df, [*heads, "v"], used_range=said("used_range"), region_id=said("region_id"), listed_columns=F.array_sort(ints("column_numbers")), listed_rows=ints("row_numbers"), stored=stored)
    heads += ["used_range", "region_id"]
    loose = F.when(F.exists("stored", lambda r: r["cells"].isNull()), F.try_variant_get("v", "$.rows", "array<map<string,variant>>"))
    df = worked(df, [*heads, "listed_columns", "listed_rows", "stored"], loose=loose)
    sound = lambda r, i: r.isNotNull() & is_integer(r["row_number"]) & (r["cells"].isNotNull() | F.try_element_at(F.get("loose", i), F.lit("cells")).isNull())
    entry = lambda number, is_stored, k: F.struct(number.alias("number"), F.lit(is_stored).alias("is_stored"), k.alias("k"))
    own = F.filter(F.transform("stored", lambda r, i: F.when(sound(r, i), entry(F.try_variant_get(r["row_number"], "$", "long"), True, i))), lambda r: r.isNotNull())
    df = worked(df, [*heads, "listed_columns", "listed_rows", "stored"], same=runs(F.concat(F.transform("listed_rows", lambda x, i: entry(x, False, i)), own), "number"))
    first, last = lambda g: F.get(g, F.lit(0)), lambda g: F.element_at(g, -1)
    since = lambda g: F.when(F.size("listed_rows") > 0, F.get(F.filter(g, lambda e: e["is_stored"]), F.lit(0))["k"])
    turn = lambda g: F.when(first(g)["is_stored"], F.lit(2**31 - 1)).otherwise(first(g)["k"])
    order = F.sort_array(F.transform("same", lambda g: F.struct(turn(g).alias("turn"), since(g).alias("since"), first(g)["number"].alias("number"), F.when(last(g)["is_stored"], last(g)["k"]).alias("place"))))
    df = worked(df, [*heads, "listed_columns", "stored"], order=order)
    kept = lambda r: F.filter(F.coalesce(F.get("stored", r["place"])["cells"], none_of("struct<column_number:variant,value:variant>")), lambda c: c.isNotNull() & is_integer(c["column_number"]))
    cell = lambda at: lambda c, i: F.struct(F.try_variant_get(c["column_number"], "$", "long").alias("col"), at.alias("at"), i.alias("turn"), cell_text(c["value"]).alias("value"))
    df = worked(df, [*heads, "listed_columns", "order"], flat=F.flatten(F.transform("order", lambda r, at: F.transform(kept(r), cell(at)))))
    df = by_place(df, [*heads, "listed_columns", "order"], F.when(F.size("listed_columns") > 0, F.col("listed_columns")).otherwise(F.col("used")))
    source_text = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("source", "framing", "used_range", "region_id")], F.lit(""))
    rows = F.transform("order", lambda r: F.struct(r["number"].alias("number"), F.lit(None).cast("string").alias("line")))
    return Tables(by, df.select(*by, F.transform("numbers", column_letters).alias("columns"), F.lit(True).alias("shown"), "framing", "used_range", "region_id", word_tokens(source_text).alias("token_count"), rows.alias("rows"), "cells"))


def unescaped(cell: Column) -> Column:
    return F.replace(F.replace(cell, F.lit("\\|"), F.lit("|")), F.lit("<br>"), F.lit("\n"))


def pipe_cells(line: Column) -> Column:
    """The cells of a pipe row; a bar after a backslash is part of its cell."""
    inner = F.regexp_replace(F.regexp_replace(stripped(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), stripped)


def from_markdown(docs: DataFrame, by: Sequence[str], text: str = "text") -> Tables:
    """The pipe table of each text: all lines from its first pipe row to its last one. The first row names the columns' letters, after a column Row with the rows' numbers, if there is one."""
    by = list(by)
    lines = F.split(text, "\r\n|\n|\r", -1)
    piped = F.transform("lines", lambda x: F.coalesce(stripped(x).rlike(r"^\|.+\|$"), F.lit(False)))
    read = worked(docs.select(*by, F.col(text).alias("text")), [*by, "text"], lines=lines)
    read = worked(read, [*by, "text", "lines"], piped=piped)
    read = worked(read, [*by, "text", "lines"], first=F.array_position("piped", True).cast("int"), past=(F.size("lines") - F.array_position(F.reverse("piped"), True) + 2).cast("int"))
    has = F.coalesce(F.col("first") > 0, F.lit(False))
    part = lambda a: stripped(F.array_join(a, "\n"))
    around = F.filter(F.array(part(F.slice("lines", F.lit(1), F.col("first") - 1)), part(F.slice("lines", F.col("past"), F.size("lines")))), lambda x: x != "")
    framing = F.when(has, F.array_join(around, "\n\n")).otherwise(stripped(F.coalesce("text", F.lit(""))))
    read = worked(read, [*by, "text"], table=F.when(has, F.slice("lines", F.col("first"), F.col("past") - F.col("first"))), framing=framing)
    read = worked(read, [*by, "text", "table", "framing"], heads=pipe_cells(F.get("table", F.lit(0))))
    skip = (F.coalesce(F.get("heads", F.lit(0)) == "Row", F.lit(False))).cast("int")
    cut = F.transform(F.coalesce(F.slice("table", F.lit(2), F.greatest(F.size("table"), F.lit(0))), none_of("string")), lambda x: F.struct(x.alias("line"), pipe_cells(x).alias("values")))
    filled = lambda x: F.filter(x["values"], lambda c: c != "")
    ruled = lambda f: (F.size(f) > 0) & F.forall(f, lambda c: c.rlike("^:?-+:?$"))
    read = worked(read, [*by, "text", "framing", "heads"], skip=skip, below=F.filter(cut, lambda x: ~bound(filled(x), ruled)))
    cell = lambda at: lambda c, i: F.struct(i.cast("long").alias("col"), at.alias("at"), F.lit(0).alias("turn"), unescaped(c).alias("value"))
    flat = F.flatten(F.transform("below", lambda x, at: F.transform(F.slice(x["values"], F.col("skip") + 1, F.size(x["values"])), cell(at))))
    columns = F.coalesce(F.slice("heads", F.col("skip") + 1, F.greatest(F.size("heads"), F.lit(0))), none_of("string"))
    read = worked(read, [*by, "text", "framing", "skip", "below"], columns=columns, flat=flat)
    read = by_place(read, [*by, "text", "framing", "skip", "below", "columns"], F.transform("columns", lambda _, i: i.cast("long")))
    used = F.coalesce(stripped(F.regexp_extract("text", r"(?m)^- Used range: (.+)$", 1)), F.lit(""))
    number = lambda x: F.coalesce(F.when(F.col("skip") == 1, F.get(x["values"], F.lit(0)).try_cast("long")), F.lit(0))
    rows = F.transform("below", lambda x: F.struct(number(x).alias("number"), x["line"].alias("line")))
    return Tables(by, read.select(*by, "columns", F.lit(False).alias("shown"), "framing", used.alias("used_range"), F.lit("").alias("region_id"), word_tokens(F.coalesce("text", F.lit(""))).alias("token_count"), rows.alias("rows"), "cells"))


def labels_a_column(text: Column) -> Column:
    return stripped(text).contains(" ") | label_like(text)


def usual_kind(later: Column) -> Column:
    """The most frequent type of cells, of equal ones the one that comes first."""
    own = lambda k: F.filter(later, lambda c: c["kind"] == k)
    counted = lambda k: bound(own(k), lambda x: F.when(F.size(x) > 0, F.struct(F.size(x).alias("n"), (-F.get(x, F.lit(0))["at"]).alias("since"), k.alias("kind"))))
    first = F.get(later, F.lit(0))["kind"]
    return F.when(F.forall(later, lambda c: c["kind"] == first), first).otherwise(F.array_max(F.transform(F.array(*map(F.lit, ("boolean", "date", "numeric", "text"))), counted))["kind"])


def data_over_header(cells: Column) -> Column:
    """By how much the first value of a column, of its cells that aren't blank, looks more like data than like a header; 0 if it or the values below are missing.

    A first value that recurs below counts 2 for data. Where the values below are mostly of its type: for text, a shape like theirs is data, a label and values that repeat below without it are
    signs of a header; for other types it's data. Where they're of another type: text over numbers, dates or booleans counts 2 for a header, anything else 1.
    """
    one = lambda x: x.cast("int")

    def points(top: Column, later: Column, usual: Column) -> Column:
        bare, early = top["bare"], F.transform(F.slice(later, 1, COMPARED), lambda c: c["bare"])
        recurs = F.exists(later, lambda c: c["bare"] == bare)
        alike = F.exists(early, lambda x: value_shape(x) == value_shape(bare))
        repeats = F.size(F.array_distinct(early)) < F.size(early)
        as_text = one(alike) - one(labels_a_column(bare)) - one(~recurs & repeats)
        other = F.when((top["kind"] == "text") & usual.isin("numeric", "date", "boolean"), 2).otherwise(1)
        return 2 * one(recurs) + F.when(top["kind"] != usual, -other).when(usual == "text", as_text).otherwise(1)

    below = lambda c: F.slice(c, 2, F.size(c))
    told = bound(below(cells), lambda later: bound(usual_kind(later), lambda usual: points(F.get(cells, F.lit(0)), later, usual)))
    return F.when((F.size(cells) > 1) & (F.get(cells, F.lit(0))["at"] == 0), told).otherwise(0)


def modes(t: Tables) -> DataFrame:
    """grids with header_mode, skip (rows that are a header) and empty.

    A first row whose values mostly aren't text is data; so is one of a shown table that looks more like data by its columns (data_over_header) and by 1 for values that are all unique.
    """
    columns = [c for c in t.grids.columns if c not in t.by]
    df = worked(t.grids, [*t.by, *columns], real=F.transform("cells", lambda g: F.filter(g, lambda c: c["kind"] != "null")))
    top = F.filter(F.transform("real", lambda g: F.get(g, F.lit(0))), lambda c: c["at"] == 0)
    df = worked(df, [*t.by, *columns, "real"], top=top)
    mostly = 2 * F.size(F.filter("top", lambda c: c["kind"] != "text")) > F.size("top")
    values = F.transform("top", lambda c: c["value"])
    unique = ((F.size("top") > 0) & (F.size(F.array_distinct(values)) == F.size("top"))).cast("int")
    more = F.aggregate(F.transform("real", data_over_header), F.lit(0), lambda a, x: a + x) - unique
    n_rows, empty = F.size("rows"), (F.size("columns") == 0) | (F.size("rows") == 0)
    mode = F.when(empty, F.when(F.col("shown"), "headerless").otherwise("")).when(mostly, "headerless").when(F.col("shown") & (n_rows > 1), F.when(more >= 1, "headerless").otherwise("header_row")).otherwise("header_row")
    df = worked(df, [*t.by, *columns], header_mode=mode, empty=empty)
    return df.withColumn("skip", (F.col("header_mode") == "header_row").cast("int"))


def analysed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(tables, columns) of the analysis; each is worked out from the texts where it is used.

    tables: by..., row_count, header_row, header_mode, framing, used_range, region_id, token_count, sample_rows. columns: by..., place, position, name, and what profile() tells of the values
    below the header: non_null_count, null_count, unique_count, dtype, statistics, sample_values. Columns without a name in their header have an empty name; names that occur twice get their position.
    """
    by = t.by
    told = modes(t)
    count = F.when(F.col("empty"), F.lit(0)).otherwise(F.size("rows") - F.col("skip")).cast("long")
    header_row = F.when(F.col("header_mode") == "header_row", F.get("rows", F.lit(0))["number"]).otherwise(0).cast("long")
    summary = told.select(*by, count.alias("row_count"), header_row.alias("header_row"), "header_mode", "framing", "used_range", "region_id", "token_count", F.when(F.col("empty"), none_of("string")).otherwise(samples()).alias("sample_rows"))
    return summary, column_profiles(told, by)


def samples() -> Column:
    """The first HEAD and the last TAIL rows below the header as pipe rows, all if there are no more."""
    first, n = F.col("skip"), F.size("rows")
    low = F.filter(F.transform(F.array(*map(F.lit, range(HEAD))), lambda i: first + i), lambda at: at < n)
    high = F.filter(F.transform(F.array(*map(F.lit, range(TAIL, 0, -1))), lambda i: n - i), lambda at: at >= first + HEAD)
    found = lambda g, at: F.when(F.get(g, at)["at"] == at, F.get(g, at)["value"]).otherwise(F.get(F.filter(g, lambda c: c["at"] == at), F.lit(0))["value"])
    escaped = lambda x: F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    values = lambda at: F.array_join(F.transform("cells", lambda g: escaped(F.coalesce(found(g, at), F.lit("")))), " | ")
    row = lambda at: F.get("rows", at)
    line = lambda at: F.when(F.col("shown"), F.concat(F.lit("| "), row(at)["number"].cast("string"), F.lit(" | "), values(at), F.lit(" |"))).otherwise(row(at)["line"])
    return F.transform(F.concat(low, high), line)


def column_profiles(told: DataFrame, by: list[str]) -> DataFrame:
    top = lambda g: F.when(F.get(g, F.lit(0))["at"] == 0, F.get(g, F.lit(0))["value"])
    own = lambda g: F.coalesce(F.when(F.col("shown"), unescaped(top(g))).otherwise(top(g)), F.lit(""))
    raw_names = F.when(F.col("header_mode") == "headerless", F.col("columns")).otherwise(F.transform("cells", own))
    df = worked(told.filter("not empty"), [*by, "columns", "cells", "rows", "skip"], raw_names=raw_names)
    twice = bound(F.sort_array("raw_names"), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
    df = worked(df, [*by, "columns", "cells", "rows", "skip", "raw_names"], twice=twice)
    data = lambda g: F.filter(g, lambda c: (c["at"] >= F.col("skip")) & (c["kind"] != "null"))
    name = lambda x, position: F.when(F.array_contains("twice", x) & (position != ""), F.concat(x, F.lit(" ("), position, F.lit(")"))).otherwise(x)
    each = F.transform("columns", lambda p, i: F.struct(p.alias("position"), name(F.get("raw_names", i), p).alias("name"), data(F.get("cells", i)).alias("data")))
    df = df.select(*by, (F.size("rows") - F.col("skip")).alias("n_rows"), F.posexplode(each).alias("i", "column")).select(*by, "n_rows", (F.col("i") + 1).cast("long").alias("place"), "column.*")
    pick = lambda field: F.transform("data", lambda c: c[field])
    df = worked(df, [*by, "n_rows", "place", "position", "name", "data"], values=pick("value"), kinds=F.array_distinct(pick("kind")))
    df = worked(df, [*by, "n_rows", "place", "position", "name", "data", "values", "kinds"], unlike=F.array_distinct("values"))
    full = F.size("data").cast("long")
    dtype = F.when(F.size("kinds") == 0, "text").when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).otherwise("mixed")
    of = lambda kinds, x: F.when(dtype.isin(*kinds) & (full > 0), x)
    text, lengths, numbers = ("text", "mixed"), F.transform("values", lambda x: F.length(x).cast("long")), pick("number")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    true = F.size(F.filter("data", lambda c: F.upper(c["bare"]) == "TRUE")).cast("long")
    spread = F.transform("unlike", lambda x: F.struct((-F.size(F.filter("values", lambda y: y == x))).alias("n"), x.alias("value")))
    spread = F.map_from_entries(F.transform(F.sort_array(spread), lambda s: F.struct(s["value"], (-s["n"]).cast("long"))))
    return df.select(
        *by, "place", "position", "name", dtype.alias("dtype"), full.alias("non_null_count"), (F.col("n_rows") - full).cast("long").alias("null_count"), F.size("unlike").cast("long").alias("unique_count"),
        of(["numeric"], F.array_min(numbers)).alias("min_number"), of(["numeric"], F.array_max(numbers)).alias("max_number"), of(["numeric"], F.round(total(numbers) / full, 4)).alias("mean"),
        of(["date"], F.array_min("values")).alias("min_date"), of(["date"], F.array_max("values")).alias("max_date"), of(["boolean"], true).alias("true_count"), of(["boolean"], full - true).alias("false_count"),
        of(text, F.array_min(lengths)).alias("min_length"), of(text, F.array_max(lengths)).alias("max_length"), of(text, F.round(total(lengths) / full, 1)).alias("avg_length"),
        of(text, F.when(F.size("unlike") <= profiles.LISTED, spread)).alias("value_distribution"), F.slice("unlike", 1, profiles.SAMPLES).alias("sample_values"),
    )
