"""Facts from text by rules: dates, metrics, keywords, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.dates import first_date
from quillspark.functions.text import bound, stripped, trimmed

# What a metric's value looks like, and its units.
UNITS = "%|bp|bps|pt|pts|d|days|k|m|mm|b|bn"
VALUE = rf"[\$\£\€\¥C]?\$?\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:{UNITS})(?![A-Za-z]))?"
# Pairs in prose, with a colon or equals sign, and with "at".
PAIRS = (
    rf"(?i)^([A-Z][A-Za-z0-9_ /&\-]{{1,60}}?)\s*[:=]\s*({VALUE})\s*(?:[).,;:]*)$",
    rf"(?i)^([A-Za-z][A-Za-z0-9_ /&\-\(\)]{{1,60}}?)\s+at\s+({VALUE})\s*(?:[).,;:]*)$",
)
# Headers of the label column and of the value column.
LABEL_HEADERS = ("metric", "metrics", "card", "cards", "kpi", "kpis", "label", "labels")
VALUE_HEADERS = ("value", "values", "current", "current value", "amount")
# Labels that say nothing.
GENERIC_LABELS = (
    "adverse", "base", "response", "severe", "value", "values", "retail", "commercial", "markets", "cards", "payments", "deposits", "other", "visuals",
    "second dense table", "mm range", "pct range", "stage values",
)
# Phrases and words of labels that are no metric's.
NOISY_PHRASES = ("formula region", "dense table", "example rows", "key table rows", "used range", "sheet name", "file type", "column headers")
NOISY_WORDS = (
    "appendix", "column", "columns", "currency", "currencies", "example", "examples", "grid", "listing", "page", "range", "record", "records", "region",
    "row", "rows", "scenario", "sheet", "symbol", "symbols", "table", "unicode", "worksheet",
)
# Parts of labels that allow a plain number, and words at the end of a label that go.
COUNT_TERMS = ("backlog", "complaint", "complaints", "incident", "incidents", "record", "records", "case", "cases", "count", "rows")
QUALIFIERS = ("estimated", "estimate", "listed", "measured", "observed", "reported", "shown")


def document_dates(pages: DataFrame, by: list[str], page: str = "page", content: str = "content", most: int = 5) -> DataFrame:
    """The first date-like text of each document's first pages: by page, then by the order of the patterns."""
    found = pages.filter(F.col(page) <= most).withColumn("date", stripped(first_date(F.col(content)))).filter("date is not null")
    return found.groupBy(*by).agg(F.min_by("date", page).alias("date"))


def clauses(text: Column) -> Column:
    """Parts between semicolons and line ends, cut again before a comma with a label that starts a new pair."""
    first = F.split(F.replace(text, F.lit(";"), F.lit("\n")), "\n", -1)
    cut = F.transform(first, lambda c: F.regexp_replace(c, r",\s+(?=[A-Z][A-Za-z0-9_ /&\-\(\)]{1,60}\s*(?:[:=]|\bat\b))", "\n"))  # a pattern of split() would be compiled for each text
    cut = F.split(F.array_join(cut, "\n"), "\n", -1)
    return F.transform(F.filter(cut, lambda c: trimmed(c) != ""), lambda c: F.btrim(c, F.lit(" *-")))


def tidy_label(text: Column) -> Column:
    """Without white space and punctuation at its ends, and with single spaces."""
    return F.regexp_replace(F.btrim(trimmed(text), F.lit(":;,.")), r"\s+", " ")


def without_qualifiers(text: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(tidy_label(text)), rf"(?i)(?:(?:^| )(?:{'|'.join(QUALIFIERS)})\.*)+$", ""))


def capitalised(label: Column) -> Column:
    """A label in small letters with a capital."""
    return F.when(F.lower(label) == label, F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.length(label)))).otherwise(label)


def metric_label(text: Column) -> Column:
    """A label without qualifiers at its end; one in small letters gets a capital."""
    return capitalised(without_qualifiers(text))


def label_key(label: Column) -> Column:
    """What labels have in common that count as the same."""
    return F.lower(tidy_label(label))


def metric_value(text: Column) -> Column:
    return F.rtrim(trimmed(text), F.lit(".,;:"))


def looks_like_sequence(value: Column, strict: bool = False) -> Column:
    """Whether a value is a series of numbers. Groups of three digits after the first comma are thousands of one number; strict: any comma makes a series."""
    bare = F.regexp_replace(trimmed(value), rf"(?i)^[\$\£\€\¥C]?\$?\s*|\s*(?:{UNITS})$", "")
    parts = F.filter(F.split(bare, ","), lambda p: p != "")
    if strict:
        return F.size(parts) > 1
    odd = F.filter(parts, lambda p, i: F.when(i == 0, F.length(F.regexp_replace(p, r"\..*$", "")) > 3).otherwise(~p.rlike(r"^\d{3}(?:\.\d+)?$")))
    return value.contains(",") & (F.size(parts) > 1) & (F.size(odd) > 0)


def usable(label: Column, value: Column) -> Column:
    """Whether a pair says something: no generic or noisy label, one number, and no bare number unless the label counts things or begins with total."""
    return usable_key(label_key(label), value)


def usable_key(key: Column, value: Column) -> Column:
    """usable() by the label's key."""
    noisy = F.arrays_overlap(F.split(key, " "), F.array(*map(F.lit, NOISY_WORDS))) | key.rlike(rf"\b(?:{'|'.join(NOISY_PHRASES)})\b")
    counts = key.startswith("total ") | key.rlike("|".join(COUNT_TERMS))
    bare = value.rlike(r"^\d+(?:\.\d+)?$")
    return (key != "") & (value != "") & ~key.isin(*GENERIC_LABELS) & (~bare | counts) & ~noisy & ~looks_like_sequence(value)


def last_pairs(pairs: Column) -> Column:
    """Of pairs (key, label, value) whose keys are the same the last one, as (label, value). Pairs are sorted, so many of them cost no square."""
    placed = F.sort_array(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["label"].alias("label"), p["value"].alias("value"))))
    last = lambda found: F.filter(found, lambda p, i: ~F.get(found, i + 1)["key"].eqNullSafe(p["key"]))
    return F.transform(bound(placed, last), lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value")))


def keyed(pairs: Column) -> Column:
    """Pairs (label, value) with the key of their label before them."""
    return F.transform(pairs, lambda p: F.struct(label_key(p["label"]).alias("key"), p["label"].alias("label"), p["value"].alias("value")))


def sound_pairs(pairs: Column) -> Column:
    """Of pairs (label, value) as they are written, in their order, those that say something, tidied; of equal labels the last one."""
    tidy = F.transform(pairs, lambda p: F.struct(without_qualifiers(p["label"]).alias("label"), metric_value(p["value"]).alias("value")))  # step by step: what a step names twice is worked out once
    tidy = F.transform(tidy, lambda p: F.struct(capitalised(p["label"]).alias("label"), p["value"].alias("value")))
    return last_pairs(F.filter(keyed(tidy), lambda p: usable_key(p["key"], p["value"])))


def pair_rows(rows: DataFrame, by: list[str], pairs: Column) -> DataFrame:
    """by..., label, value: a row for each pair."""
    return rows.select(*by, F.explode_outer(pairs).alias("p")).filter("p is not null").select(*by, "p.label", "p.value")  # a plain explode has its array worked out a second time, to filter by its size


def last_of_label(pairs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by..., label, value: of pairs whose labels count as the same, the last one."""
    last = Window.partitionBy(*by, label_key(F.col("label"))).orderBy(*[F.desc(c) for c in order])
    return pairs.withColumn("last", F.row_number().over(last)).filter("last = 1").select(*by, "label", "value")


def text_pairs(text: Column) -> Column:
    """Pairs (label, value) of a text's prose: `Label: value`, `Label = value` and `Label at value`; of equal labels the last one stands."""
    parts = lambda c, pattern: F.split(F.regexp_replace(c, pattern, "$1\n$2"), "\n", -1)  # noqa: E731  a clause has no line end, so two parts are a pair
    found = F.transform(clauses(text), lambda c: F.struct(c.alias("clause"), parts(c, PAIRS[0]).alias("p")))
    found = F.transform(found, lambda c: F.when(F.size(c["p"]) == 2, c["p"]).otherwise(parts(c["clause"], PAIRS[1])))
    return sound_pairs(F.transform(F.filter(found, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].alias("label"), p[1].alias("value"))))


def text_metrics(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """The pairs of texts (text_pairs): by..., label, value. texts: a row for each value of by; nothing is shuffled."""
    return pair_rows(texts, by, text_pairs(F.col(text)))


def region_metrics(cells: DataFrame, by: list[str], search: int = 3) -> DataFrame:
    """Pairs from cells (by..., row, col, value) below a row whose first two filled cells are headers of labels and values.

    The header is looked for in the first `search` rows that have cells: 3 for a region of a sheet, 1 for a table in a text. Narrative notes are left out.
    """
    filled = cells.withColumn("value", stripped(F.col("value"))).filter("value <> ''")
    of_row = filled.groupBy(*by, "row").agg(F.slice(F.array_sort(F.collect_list(F.struct("col", "value"))), 1, 2).alias("first"))
    of_row = of_row.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("row"))).filter(F.col("at") <= search)
    one, two = F.get("first", F.lit(0)), F.get("first", F.lit(1))
    heads = of_row.filter(label_key(one["value"]).isin(*LABEL_HEADERS) & label_key(two["value"]).isin(*VALUE_HEADERS))
    heads = heads.groupBy(*by).agg(F.min(F.struct(F.col("row").alias("head"), one["col"].alias("label_col"), two["col"].alias("value_col"))).alias("h")).select(*by, "h.*")
    body = filled.join(heads, by).filter(F.col("row") > F.col("head"))
    pairs = body.groupBy(*by, "row").agg(F.max(F.when(F.col("col") == F.col("label_col"), F.col("value"))).alias("name"), F.max(F.when(F.col("col") == F.col("value_col"), F.col("value"))).alias("value"))
    pairs = pairs.filter("name is not null and value is not null").filter(~F.lower("name").startswith("narrative note"))
    pairs = pairs.select(*by, "row", metric_label(F.col("name")).alias("label"), metric_value(F.col("value")).alias("value"))
    return last_of_label(pairs.filter(usable(F.col("label"), F.col("value"))), by, ["row"])


def region_pairs(cells: Column, search: int = 3) -> Column:
    """region_metrics() of a region that is one row with its cells, an array of (row, col, value) with one value a place: pairs (label, value); of equal labels the last one stands."""
    filled = F.filter(F.transform(cells, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), trimmed(c["value"]).alias("value"))), lambda c: c["value"] != "")
    beside = lambda found: F.transform(found, lambda c, i: F.struct(c.alias("cell"), F.get(found, i + 1).alias("next"), (~F.get(found, i - 1)["row"].eqNullSafe(c["row"])).alias("opens")))
    first = F.slice(F.filter(bound(F.sort_array(filled), beside), lambda c: c["opens"]), 1, search)
    heads = F.filter(first, lambda c: (c["next"]["row"] == c["cell"]["row"]) & label_key(c["cell"]["value"]).isin(*LABEL_HEADERS) & label_key(c["next"]["value"]).isin(*VALUE_HEADERS))
    below = lambda h: F.filter(filled, lambda c: (c["row"] > h["cell"]["row"]) & c["col"].isin(h["cell"]["col"], h["next"]["col"]))
    rows = F.flatten(F.transform(F.slice(heads, 1, 1), lambda h: bound(F.sort_array(below(h)), beside)))  # the label's column is before the value's
    pairs = F.filter(rows, lambda c: (c["next"]["row"] == c["cell"]["row"]) & ~F.lower(c["cell"]["value"]).startswith("narrative note"))
    return sound_pairs(F.transform(pairs, lambda c: F.struct(c["cell"]["value"].alias("label"), c["next"]["value"].alias("value"))))


def merged_pairs(found: list[Column]) -> Column:
    """Pairs (label, value) of several sources in one row in one: where a label occurs in several, the last source stands; a source that is null has none."""
    return last_pairs(keyed(F.concat(*[F.coalesce(f, F.array().cast("array<struct<label:string,value:string>>")) for f in found])))


def merged_metrics(found: list[DataFrame], by: list[str]) -> DataFrame:
    """Metrics of several sources (by..., label, value) in one: where a label occurs in several, the last source stands."""
    rows = [f.select(*by, F.lit(i).alias("source_at"), "label", "value") for i, f in enumerate(found)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return last_of_label(every, by, ["source_at"])


def keyword_rows(pages: DataFrame, by: list[str], keywords: str = "keywords", page: str = "page") -> DataFrame:
    """A row per distinct keyword of a page, trimmed, in the order in which they stand; what stands again is left out."""
    tidy = F.array_distinct(F.filter(F.transform(keywords, lambda k: stripped(k)), lambda k: k != ""))
    return pages.select(*by, page, F.posexplode(tidy).alias("at", "keyword")).withColumn("at", (F.col("at") + 1).cast("long"))


def bullet_pairs(text: Column) -> Column:
    """Pairs (label, value) of a text's cards: a bullet `- Label` without indent and without a colon, and below it the first nested bullet `- Value: 12%`; of equal labels the last one stands."""
    pattern = rf"(?i)^-\s*Value\s*:\s*({VALUE})$"
    filled = F.filter(F.split(text, "\n", -1), lambda line: trimmed(line) != "")
    cards = F.transform(F.split(F.array_join(filled, "\n"), r"\n(?! )", -1), lambda card: F.split(card, "\n", -1))  # each line without indent begins one
    is_card = lambda card: ~card[0].startswith(" ") & card[0].startswith("- ")
    nested = lambda card: F.transform(F.slice(card, F.lit(2), F.size(card)), lambda line: F.regexp_extract(trimmed(line), pattern, 1))
    named = F.transform(F.filter(cards, is_card), lambda card: F.struct(trimmed(F.substring(trimmed(card[0]), F.lit(3), F.length(card[0]))).alias("label"), card.alias("card")))
    named = F.filter(named, lambda c: ~c["label"].contains(":") & (c["label"] != ""))
    valued = F.transform(named, lambda c: F.struct(c["label"].alias("label"), F.get(F.filter(nested(c["card"]), lambda v: v != ""), F.lit(0)).alias("value")))
    return sound_pairs(F.filter(valued, lambda p: p["value"].isNotNull()))


def bullet_metrics(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """The pairs of texts' cards (bullet_pairs): by..., label, value. docs: a row for each value of by; nothing is shuffled."""
    return pair_rows(docs, by, bullet_pairs(F.col(text)))
