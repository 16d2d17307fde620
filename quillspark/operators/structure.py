"""Document structure: pages, headings to sections, subsections, chunks with breadcrumbs, and chains of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import breadcrumb, stripped
from quillspark.sources.scratch import written


def pages_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per line of the text: page from 1 on, content."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(F.split(text, "\n", -1)).alias("at", "content")).withColumn("page", (F.col("at") + 1).cast("long")).drop("at")


def heading_boundaries(pages: DataFrame, by: list[str], title: str = "title", page: str = "page") -> DataFrame:
    """Pages at which a section starts: the title differs from the one before (but for case); pages without a title don't count, except a first page."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(page)) == 1
    named = pages.withColumn("first", first).filter(F.col("first") | (F.col(title) != ""))
    before = F.lag(F.lower(title)).over(Window.partitionBy(*by).orderBy(page))
    return named.withColumn("before", before).filter(F.col("first") | (F.lower(title) != F.col("before"))).select(*by, page, title)


def normalised_boundaries(items: DataFrame, by: list[str], low: Column, high: Column, title: str = "title", start: str = "start", order: str = "at") -> DataFrame:
    """Starts clamped to low..high, the first item of each start kept, and the first start moved to low."""
    clamped = items.withColumn("low", low).withColumn("page_start", F.greatest(F.least(F.col(start), high), low))
    once = F.row_number().over(Window.partitionBy(*by, "page_start").orderBy(order))
    kept = clamped.withColumn("once", once).filter("once = 1")
    at = F.row_number().over(Window.partitionBy(*by).orderBy("page_start"))
    return kept.withColumn("number", at.cast("long")).withColumn("page_start", F.when(F.col("number") == 1, F.col("low")).otherwise(F.col("page_start"))).select(*by, "number", title, "page_start")


def intervals(boundaries: DataFrame, by: list[str], last: Column, page: str = "page", title: str = "title") -> DataFrame:
    """Sections from their starts: number, title, page_start, page_end (the page before the next start; at the end: last)."""
    order = Window.partitionBy(*by).orderBy(page)
    end = F.greatest(F.coalesce(F.lead(page).over(order) - 1, last), F.col(page))
    numbered = boundaries.withColumn("number", F.row_number().over(order).cast("long")).withColumn("page_end", end)
    return numbered.select(*by, "number", F.col(title).alias("title"), F.col(page).alias("page_start"), "page_end")


def section_of_pages(pages: DataFrame, starts: DataFrame, by: list[str], page: str = "page") -> DataFrame:
    """pages with the section that they are in: the last start at or before them. Sections cover all pages, so a window does what a range join would."""
    marked = pages.join(starts.select(*by, F.col("page_start").alias(page), F.col("number").alias("starts"), F.col("title").alias("starts_title")), [*by, page], "left")
    upto = Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    carried = {"section": F.last("starts", ignorenulls=True).over(upto), "section_title": F.last("starts_title", ignorenulls=True).over(upto)}
    return marked.withColumns(carried).drop("starts", "starts_title")


def chunks_of(pages: DataFrame, by: list[str], page: str = "page") -> DataFrame:
    """One chunk per page: number from 0 on, breadcrumb, and the prefix for embedding. pages: section_title, subsection_title."""
    number = (F.row_number().over(Window.partitionBy(*by).orderBy(page)) - 1).cast("long")
    path = breadcrumb(F.col("section_title"), F.col("subsection_title"))
    return pages.withColumns({"chunk": number, "hierarchy_path": path, "embedding_prefix": F.when(path != "", F.concat(path, F.lit(": "))).otherwise("")})


def slide_sections(slides: DataFrame, by: list[str], starts: Column, page: str = "page") -> DataFrame:
    """slides with section (a new one at every slide that starts one) and subsection (the slide's place in it)."""
    order = Window.partitionBy(*by).orderBy(page)
    first = F.row_number().over(order) == 1
    numbered = slides.withColumn("section", F.sum((starts | first).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return numbered.withColumn("subsection", F.row_number().over(Window.partitionBy(*by, "section").orderBy(page)).cast("long"))


def context_chains(sheets: DataFrame, by: list[str], needs: str = "needs_context", page: str = "page", depth: int = 3) -> DataFrame:
    """For every sheet that needs context: the sheets before it back to one that needs none, at most depth of them, in order."""
    before = Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.last(F.when(~F.col(needs), F.col(page)), ignorenulls=True).over(before)
    first = F.greatest(F.col(page) - depth, F.coalesce(stop, F.lit(1)))
    chain = F.when(F.col(needs) & (F.col(page) > 1), F.sequence(first, F.col(page) - 1)).otherwise(F.array().cast("array<long>"))
    return sheets.select(*by, page, chain.alias("chain"))


def previous_page(pages: DataFrame, by: list[str], page: str = "page", content: str = "content", most: int = 800) -> DataFrame:
    """pages with the end of the page before them."""
    return pages.withColumn("previous", F.right(F.lag(content).over(Window.partitionBy(*by).orderBy(page)), F.lit(most)))


def paragraphs_within(docs: DataFrame, text: str, budget: int) -> DataFrame:
    """A text cut at line ends into parts of about budget characters: a line is in the part in which its first character falls."""
    kept = [c for c in docs.columns if c != text]
    lines = docs.select(*kept, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    before = Window.partitionBy(*kept).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)) / budget)
    grouped = lines.withColumn("cut", part).groupBy(*kept, "cut").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("content"))
    return grouped.withColumn("part", (F.row_number().over(Window.partitionBy(*kept).orderBy("cut")) - 1).cast("long")).drop("cut")


def degradation_signals(documents: DataFrame) -> Column:
    """Rules by which a finished document is taken to be poor: title, default structure over more than 5 pages, no vector, fallback description, mostly fallback sections.

    A document without sections has a null fallback_share, which is no signal.
    """
    # fixed values: the names of the signals as they are stored
    rules = (
        (F.coalesce(F.trim("title"), F.lit("")) == "", "empty metadata"),
        ((F.col("page_count") > 5) & F.col("default_structure"), "default structure classification"),
        (F.col("summary_embedding").isNull(), "missing summary embedding"),
        (F.col("fallback_description"), "fallback document description"),
        (F.col("fallback_share") > 0.5, "empty section summaries"),
    )
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


def sheet_sections(sheets: DataFrame, by: list[str], page: str = "page", title: str = "title", tables: str = "dense_tables") -> DataFrame:
    """A section per sheet and in it a subsection per dense table, or one named like the sheet: by..., section, title, subsection, subsection_title."""
    section = F.row_number().over(Window.partitionBy(*by).orderBy(page)).cast("long")
    each = sheets.withColumn("section", section).select(*by, page, "section", title, F.posexplode_outer(tables).alias("at", "subsection_title"))
    return each.select(*by, page, "section", title, F.coalesce(F.col("at") + 1, F.lit(1)).cast("long").alias("subsection"), F.coalesce("subsection_title", title).alias("subsection_title"))


def structure_type(filetype: Column, proposed: Column, confidence: Column, sections: Column) -> Column:
    """type and confidence: slides and sheets by file type; else what is proposed (semantic, low by default), promoted to sections where there are two or more."""
    kind = F.when(proposed.isin("sections", "chapters", "topic_based", "semantic"), proposed).otherwise("semantic")
    sure = F.coalesce(confidence, F.lit("low"))
    promoted = kind.isin("semantic", "topic_based") & (sections >= 2)
    own = F.when(filetype == "pptx", "slides").when(filetype == "xlsx", "sheets")
    return F.struct(
        F.coalesce(own, F.when(promoted, "sections").otherwise(kind)).alias("structure_type"),
        F.when(own.isNotNull(), "high").when(promoted & (sure == "low"), "medium").otherwise(sure).alias("structure_confidence"),
    )


def split_at_breakpoints(docs: DataFrame, text: str, breakpoints: str) -> DataFrame:
    """A text cut before the lines whose numbers (from 1 on) are breakpoints: part, content."""
    kept = [c for c in docs.columns if c not in (text, breakpoints)]
    lines = docs.select(*kept, breakpoints, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    starts = (F.coalesce(F.array_contains(breakpoints, F.col("at") + 1), F.lit(False)) & (F.col("at") > 0)).cast("int")
    part = F.sum(starts).over(Window.partitionBy(*kept).orderBy("at")).cast("long")
    grouped = lines.withColumn("part", part).groupBy(*kept, "part").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    return grouped.select(*kept, "part", F.array_join("lines.line", "\n").alias("content"))


def split_at_blank_lines(docs: DataFrame, text: str, most: int) -> DataFrame:
    """A text cut at the blank line nearest to its middle line, and each half again, until no part has more than `most` words: part, content.

    Without a blank line the middle is taken; a single line stays whole. Turns of all texts are made at once; a turn halves the lines, so a text of n lines takes log2(n) turns.
    """
    kept = [c for c in docs.columns if c != text]
    size = lambda part: F.greatest(F.lit(1), F.size(F.filter(F.split(part, r"\s+"), lambda w: w != "")))
    at_end = lambda part: F.regexp_replace(part, r"\s+$", "")
    open_ = docs.select(*kept, F.lit("").alias("path"), F.coalesce(text, F.lit("")).alias("content"))
    done = None
    while True:
        lines = F.split("content", r"(?<=\n)", -1)
        lines = F.filter(lines, lambda x: x != "")
        settled = (size(F.col("content")) <= most) | (F.size(lines) <= 1)
        part = written(open_.withColumn("settled", settled), "blank-lines")
        ready = part.filter("settled").select(*kept, "path", "content")
        done = ready if done is None else done.unionByName(ready)
        rest = part.filter("not settled").withColumn("lines", lines)
        if not rest.limit(1).count():
            break
        middle = F.floor(F.size("lines") / 2).cast("int")
        blanks = F.filter(F.transform("lines", lambda x, i: F.when((i > 0) & (stripped(x) == ""), F.struct(F.abs(i - middle).alias("far"), (-i).alias("i")))), lambda x: x.isNotNull())
        cut = rest.withColumn("cut", F.coalesce(-F.array_min(blanks)["i"], middle))
        halves = F.array(F.struct(F.lit("0").alias("step"), F.slice("lines", F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit("1").alias("step"), F.slice("lines", F.col("cut") + 1, F.size("lines")).alias("part")))
        each = cut.select(*kept, "path", F.explode(halves).alias("h"))
        open_ = each.select(*kept, F.concat("path", "h.step").alias("path"), at_end(F.array_join("h.part", "")).alias("content")).filter(stripped(F.col("content")) != "")
    number = F.row_number().over(Window.partitionBy(*kept).orderBy("path")) - 1
    return done.withColumn("part", number.cast("long")).drop("path")


def detection_ways(documents: DataFrame, most: int = 100) -> Column:
    """How a document's sections are found: slides and sheets by their own rules; others by a model up to `most` pages, beyond by headings."""
    return F.when(F.col("filetype") == "pptx", "slides").when(F.col("filetype") == "xlsx", "sheets").when(F.col("page_count") <= most, "model").otherwise("headings")
