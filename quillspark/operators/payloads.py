"""Stored and received payloads: tolerant parsing, validation, defaults, and what is sent of pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_boilerplate, stripped, truncated

# Phrases by which a sheet refers to one before it, and where they are looked for.
CONTEXT_PHRASES = ("continued", "continuation", "continued from", "see previous", "prior sheet", "prior page", "same definitions", "same basis as", "carried forward")
CONTEXT_CHARS, SENT_CHARS = 1200, 4000
# The flags of a page and their defaults.
PAGE_FLAGS = (
    "continued_from_previous_page", "section_continuation_detected", "table_continuation_detected", "repeated_header_detected", "repeated_footer_detected",
    "contains_page_furniture", "contains_chart", "contains_dashboard", "contains_comparison_layout", "has_dense_visual_content",
)
LISTS = {"keywords": "array<string>", "classifications": "array<string>", "entities": "array<struct<type:string,value:string>>", "section_hierarchy": "array<struct<level:int,title:string>>"}
ROWS = "array<struct<row_number:int,cells:array<struct<column_number:int,value:string>>>>"


def integer(text: Column, default: int = 0) -> Column:
    """The integer that a text is, else the default."""
    return F.coalesce(stripped(text).try_cast("int"), F.lit(default))


def listed(values: Column) -> Column:
    """A list as one text: its trimmed values that aren't empty, joined by semicolons; null is empty."""
    return F.coalesce(F.array_join(F.filter(F.transform(values, stripped), lambda v: v != ""), "; "), F.lit(""))


def cell_text(moment: Column) -> Column:
    """A date and time as a cell's text; midnight is the date alone."""
    return F.when(F.date_trunc("day", moment) == moment, F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def stored_rows(text: Column) -> Column:
    """Rows stored as a JSON list, or as an object with a list of rows; anything else has none."""
    inside = F.from_json(F.get_json_object(text, "$.rows"), ROWS)
    return F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, ROWS)).otherwise(inside), F.array().cast(ROWS))


def enrichment(text: Column) -> Column:
    """A page's enrichment from JSON; null if it's malformed or a part has another type. Parts that are left out are empty."""
    parsed = F.from_json(text, "summary string, usage_description string, " + ", ".join(f"{k} {t}" for k, t in LISTS.items()))
    is_list = lambda key: F.coalesce(F.ltrim(F.get_json_object(text, f"$.{key}")).startswith("["), F.lit(True))
    sound = F.ltrim(text).startswith("{") & F.get_json_object(text, "$").isNotNull()
    for key in LISTS:
        sound = sound & is_list(key)
    lists = [F.coalesce(parsed[key], F.array().cast(kind)).alias(key) for key, kind in LISTS.items()]
    texts = [F.coalesce(parsed[key], F.lit("")).alias(key) for key in ("summary", "usage_description")]
    return F.when(F.coalesce(sound, F.lit(False)), F.struct(*texts, *lists))


def classified(payloads: DataFrame) -> DataFrame:
    """payloads (handling_mode, contains_dense_table, confidence, rationale) with mode and error: the mode falls back to the flag; the error says what is missing or wrong."""
    mode = F.coalesce(F.nullif("handling_mode", F.lit("")), F.when(F.col("contains_dense_table"), "dense_table_candidate").when(~F.col("contains_dense_table"), "page_like"))
    error = (
        F.when(mode.isNull(), "no handling mode")
        .when(~mode.isin("page_like", "dense_table_candidate"), "invalid handling mode")
        .when(F.col("confidence").isNull() | F.isnan("confidence"), "no confidence")
        .when(~F.col("confidence").between(0, 1), "confidence out of range")
        .when(F.coalesce("rationale", F.lit("")) == "", "no rationale")
    )
    return payloads.withColumn("error", error).withColumn("mode", F.when(error.isNull(), mode))


def needs_prior_context(flagged: Column, *texts: Column) -> Column:
    """Whether a sheet is flagged, or one of its texts (the last one is the content, of which the beginning counts) has a phrase that refers to a sheet before it."""
    *heads, content = texts
    whole = F.lower(F.concat_ws(" ", *heads, F.left(content, F.lit(CONTEXT_CHARS))))
    return F.coalesce(flagged, F.lit(False)) | whole.rlike("|".join(CONTEXT_PHRASES))


def dense_tables(pages: DataFrame) -> DataFrame:
    """pages with dense: the tables of candidates among them; a page without a list has its single table of old, if there is one. pages: handling_mode, regions, region."""
    single = F.when(F.col("region").isNotNull(), F.array("region")).otherwise(F.array().cast(pages.schema["regions"].dataType))
    found = F.when(F.size(F.coalesce("regions", F.array().cast(pages.schema["regions"].dataType))) > 0, F.col("regions")).otherwise(single)
    return pages.filter("handling_mode = 'dense_table_candidate'").withColumn("dense", found)


def page_flags(found: Column) -> Column:
    """All flags of a page (a map), those that weren't found false."""
    return F.map_from_arrays(F.array(*map(F.lit, PAGE_FLAGS)), F.array(*[F.coalesce(F.try_element_at(found, F.lit(f)), F.lit(False)) for f in PAGE_FLAGS]))


def chunk_payloads(chunks: DataFrame, sections: DataFrame, by: list[str]) -> DataFrame:
    """What is sent of each chunk for its summary: by..., chunk, section_title, section_overview, content. Chunks of boilerplate or without a section's name aren't sent.

    chunks: by..., chunk, section, section_name, content; sections: by..., section, overview.
    """
    sent = chunks.filter((F.coalesce("section_name", F.lit("")) != "") & ~is_boilerplate(F.col("section_name")))
    sent = sent.select(*by, "chunk", "section", F.col("section_name").alias("section_title"), truncated(F.col("content"), SENT_CHARS).alias("content"))  # no more of a text is moved than is sent
    of_section = sections.select(*by, "section", stripped(F.col("overview")).alias("section_overview")).hint("shuffle_hash")  # texts stream by and are not sorted; a task holds its sections' overviews
    joined = sent.join(of_section, [*by, "section"], "left")
    return joined.select(*by, "chunk", "section_title", F.coalesce("section_overview", F.lit("")).alias("section_overview"), "content")


def with_embeddings(rows: DataFrame, embedded: DataFrame, text: str = "text") -> DataFrame:
    """rows with the embedding of their text. embedded: text, embedding, a row for each different text, see distinct_texts()."""
    return rows.join(embedded, text, "left")


def distinct_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Each different text once, to be embedded."""
    return rows.select(text).distinct()


def by_index(choices: DataFrame, sources: DataFrame, index: str = "index", key: str = "data_source") -> DataFrame:
    """choices with the source at their place, from 0 on, in the order of the keys; a place out of range has a null source."""
    place = (F.row_number().over(Window.orderBy(key)) - 1).cast("long")  # one row a source
    return choices.join(F.broadcast(sources.select(key).distinct().withColumn(index, place)), index, "left")


def as_text_order(rows: DataFrame) -> list[Column]:
    """The order of rows by all of their columns as texts, as exchanged files have it."""
    return [F.col(f"`{c}`").cast("string").asc_nulls_first() for c in rows.columns]
