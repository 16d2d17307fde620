"""Titles and summaries of documents by rule, texts to embed, and metrics of dense tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import bare_title, is_boilerplate, stripped

# Names of metrics and descriptions of columns that are formulas, no data.
FORMULA_NAME = r"(?i)(?:\bCalc[_\s]?\d+\b|\bFormula(?:[_\s]?\d+)?\b|Adjusted (?:Percentage|Ratio).*(?:Variant|Offset)|\bOffset \d+\b|ROUND\(|IF\(|SUM\(|VLOOKUP\(|\bComputation\b|\bIntermediate\b)"
FORMULA_TEXT = r"(?i)formula text|template|scenario|round\(|if\(|sum\(|vlookup\("
#: Keywords of a page that become topics of its summary; characters of a text that is embedded.
TOPICS, EMBEDDED = 8, 20_000


def filled(text: Column, otherwise: Column) -> Column:
    """text, trimmed, or otherwise if it's null or empty."""
    return F.coalesce(F.nullif(stripped(text), F.lit("")), otherwise)


def tidy_list(values: Column) -> Column:
    """Trimmed, without empty and repeated values, in order; null is empty."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(values, stripped), lambda v: v != "")), F.array().cast("array<string>"))


def heading(hierarchy: Column, level: int) -> Column:
    """The first title at a level that isn't empty, of an array of structs (level, title); empty if there is none."""
    titles = F.filter(F.transform(F.filter(hierarchy, lambda h: h["level"] == level), lambda h: stripped(h["title"])), lambda t: t != "")
    return F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit(""))


def default_titles(pages: DataFrame, by: list[str]) -> DataFrame:
    """by..., title: of each document's first page its first heading, else its title, else Document. pages: by..., page, hierarchy, page_title."""
    first = pages.groupBy(*by).agg(F.min_by(F.struct("hierarchy", "page_title"), "page").alias("p"))
    return first.select(*by, filled(heading(F.col("p.hierarchy"), 1), filled(F.col("p.page_title"), F.lit("Document"))).alias("title"))


def boilerplate_overview(title: Column, abstract: Column) -> Column:
    """What stands for the summary of a boilerplate section (an abstract: the document's abstract); null for any other."""
    standard = F.concat(F.lit("Standard "), title, F.lit(" section"))
    return F.when(is_boilerplate(title), F.when(bare_title(title) == "abstract", filled(abstract, standard)).otherwise(standard))


def section_summaries(sections: DataFrame) -> DataFrame:
    """sections (title, abstract ...) with overview and needs_model: boilerplate is summed up by rule."""
    return sections.withColumn("overview", boilerplate_overview(F.col("title"), F.col("abstract"))).withColumn("needs_model", F.col("overview").isNull())


def subsection_summaries(subsections: DataFrame) -> DataFrame:
    """subsections (section_title, abstract, title, page_count, page_summary, keywords) with overview, topics and needs_model.

    Those of a boilerplate section have its summary, those of one page the page's (or their own title); the others are left to a model.
    """
    inherited = boilerplate_overview(F.col("section_title"), F.col("abstract"))
    own = F.when(F.col("page_count") <= 1, filled(F.col("page_summary"), F.col("title")))
    topics = F.when(inherited.isNull() & (F.col("page_count") <= 1), F.slice(tidy_list(F.col("keywords")), 1, TOPICS)).otherwise(F.array().cast("array<string>"))
    return subsections.withColumn("overview", F.coalesce(inherited, own)).withColumn("topics", topics).withColumn("needs_model", F.col("overview").isNull())


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.format_string("page %d", first)).otherwise(F.format_string("pages %d-%d", first, last))


def document_lines(documents: DataFrame, sections: DataFrame, by: list[str]) -> DataFrame:
    """by..., text: a document's summary in Markdown, from its metadata and its sections in order.

    documents: by..., title, authors (array), date, kind, page_count, abstract; sections: by..., number, title, page_start, page_end, overview, topics, findings (arrays).
    """
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"- {label}: "), value))
    text = lambda c: F.coalesce(stripped(F.col(c)), F.lit(""))
    head = F.array_compact(F.array(
        F.lit("# Document Metadata"), line("Title", text("title")), line("Authors", F.array_join(tidy_list(F.col("authors")), ", ")), line("Date", text("date")),
        line("Type", text("kind")), line("Pages", F.col("page_count").cast("string")), F.when(text("abstract") != "", F.concat(F.lit("\n## Abstract\n"), text("abstract"))),
    ))
    bold = lambda label, value: F.when(value != "", F.concat(F.lit(f"**{label}:** "), value))
    part = F.array_join(F.array_compact(F.array(
        F.format_string("\n## Section %d: %s (%s)", "number", "title", page_label(F.col("page_start"), F.col("page_end"))), bold("Overview", text("overview")),
        bold("Key Topics", F.array_join(tidy_list(F.col("topics")), ", ")), bold("Key Findings", F.array_join(tidy_list(F.col("findings")), "; ")),
    )), "\n")
    parts = sections.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("number", part.alias("part"))))["part"].alias("parts"))
    rows = documents.withColumn("head", head).join(parts, by, "left")
    return rows.select(*by, F.array_join(F.concat("head", F.coalesce("parts", F.array().cast("array<string>"))), "\n").alias("text"))


def dense_title(page_title: Column, used_range: Column, region_id: Column, number: Column) -> Column:
    """The title of a dense table's subsection: with its range, else its region, else its number."""
    tagged = F.coalesce(F.nullif(stripped(used_range), F.lit("")), F.nullif(stripped(region_id), F.lit("")))
    return F.when(tagged.isNotNull(), F.concat(page_title, F.lit(" ["), tagged, F.lit("]"))).otherwise(F.concat(page_title, F.lit(" dense table "), number.cast("string")))


def keyword_text(page_title: Column, keyword: Column, section_title: Column) -> Column:
    """A keyword with its context, as it's embedded."""
    section = F.concat(F.lit("section: "), F.nullif(section_title, F.lit("")))
    return F.concat_ws(" | ", F.nullif(page_title, F.lit("")), F.concat(F.lit("keyword: "), keyword), section)


def metric_text(sheet: Column, metric: Column, platform: Column, sub_platform: Column) -> Column:
    """A metric with its context, as it's embedded."""
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.nullif(stripped(c), F.lit("")))
    return F.concat_ws(" | ", F.nullif(stripped(sheet), F.lit("")), F.concat(F.lit("metric: "), stripped(metric)), part("platform", platform), part("sub-platform", sub_platform))


def embedded(text: Column) -> Column:
    """The characters of a text that are embedded; it's kept whole elsewhere."""
    return F.left(text, F.lit(EMBEDDED))


def formula_tables(tables: DataFrame) -> Column:
    """Whether a dense table is formulas alone: names and descriptions that are such make 0.6 of its columns, and it has no measures. names, descriptions, measures: arrays."""
    like = F.size(F.filter("names", lambda n: n.rlike(FORMULA_NAME))) + F.size(F.filter("descriptions", lambda d: d.rlike(FORMULA_TEXT)))
    return (F.size("names") > 0) & (F.try_divide(like, F.size("names")) >= 0.6) & (F.size("measures") == 0)


def metric_items(tables: DataFrame, by: list[str], items: str = "metrics") -> DataFrame:
    """by..., the metrics of dense tables (an array of structs metric_name, platform, sub_platform): trimmed, without empty names and formulas."""
    rows = tables.select(*by, F.explode(items).alias("m"))
    text = lambda c: F.coalesce(stripped(F.col(f"m.{c}")), F.lit("")).alias(c)
    found = rows.select(*by, text("metric_name"), text("platform"), text("sub_platform"))
    return found.filter((F.col("metric_name") != "") & ~F.col("metric_name").rlike(FORMULA_NAME))


def expanded_title(title: Column, filetype: Column, hierarchy: Column, named: str = r"\b(?:q[1-4]|fy)?20\d{2}\b") -> Column:
    """A title; a short one of a docx file without a period is followed by its first page's first telling heading of level 2 or below."""
    # fixed values: beginnings of headings that tell nothing, and words of which a heading may not be made alone
    skipped = r"(?i)^(?:diagram|notes|appendix)"
    generic = "card|cards|chart|figure|grid|key|kpi|snapshot|summary|table|visual"
    names = F.transform(F.filter(hierarchy, lambda h: h["level"] >= 2), lambda h: stripped(F.regexp_replace(stripped(h["title"]), r"(?i)^(?:table|figure)\s*:\s*", "")))
    telling = F.filter(names, lambda n: (n != "") & ~n.rlike(skipped) & ~(n.rlike("[A-Za-z]") & (F.regexp_replace(n, rf"(?i)(?<![A-Za-z])(?:{generic})(?![A-Za-z])|[^A-Za-z]", "") == "")))
    first = F.try_element_at(telling, F.lit(1))
    bare = stripped(title)
    short = (F.size(F.split(bare, r"\s+")) <= 4) & ~bare.rlike(f"(?i){named}")
    more = (filetype == "docx") & (bare != "") & short & first.isNotNull() & ~F.contains(F.lower(bare), F.lower(first))
    return F.when(more, F.concat(bare, F.lit(" - "), first)).otherwise(bare)
