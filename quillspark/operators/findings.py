"""Decisions, findings and citations, from documents to a cited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.citations import page_link
from quillspark.functions.text import trimmed, xml_escaped
from quillspark.sources.scratch import written

STATUSES = ("answered", "needs_deep_research", "irrelevant")
IRRELEVANT = "Not relevant to the research statement."


def validated(batch: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """One valid decision for each document of a batch.

    batch: by..., document_index, document_id; decisions: by..., document_index, status, finding, page, at (their order). Unknown indexes and repeated
    decisions are dropped; a bad status, an answer without text and a missing decision need deep research; only answers keep a page.
    """
    first = F.row_number().over(Window.partitionBy(*by, "document_index").orderBy("at"))
    once = decisions.withColumn("turn", first).filter("turn = 1").drop("turn", "at")
    joined = batch.join(once, [*by, "document_index"], "left")
    return joined.select(*by, "document_index", "document_id", *decision(F.col("status"), F.col("finding"), F.col("page")))


def decision(status: Column, finding: Column, page: Column) -> list[Column]:
    """The valid decision that a proposal, or none, is: status, finding, page."""
    text = trimmed(F.coalesce(finding, F.lit("")))
    status = F.when(status.isin(*STATUSES), status).otherwise("needs_deep_research")
    status = F.when((status == "answered") & (text == ""), "needs_deep_research").otherwise(status)
    said = F.when((status == "irrelevant") & (text == ""), IRRELEVANT).otherwise(text)
    return [status.alias("status"), said.alias("finding"), F.when(status == "answered", page).alias("page")]


def validated_in_place(batch: DataFrame, proposals: str) -> DataFrame:
    """validated() of documents that carry their proposals, a list of (at, status, finding, page) or null: the first of them counts, the other columns stay."""
    kept = [c for c in batch.columns if c != proposals]
    once = lambda x, name: F.explode(F.array(x)).alias(name)  # noqa: E731  # worked out once: filters and later columns would name the whole of it again
    first = batch.select(*kept, once(F.array_min(proposals), "proposal"))
    told = F.struct(*decision(F.col("proposal.status"), F.col("proposal.finding"), F.col("proposal.page")))
    return first.select(*kept, once(told, "decision")).select(*kept, "decision.*")


def findings_of(decisions: DataFrame) -> DataFrame:
    """Decisions that are findings: answered or to be researched, with a text."""
    return decisions.filter(F.col("status").isin("answered", "needs_deep_research") & (F.col("finding") != ""))


def numbered(rows: DataFrame, order: list[Column | str], number: str = "ref_id") -> DataFrame:
    """rows with consecutive numbers from 1 on in the order given, nulls first.

    Rows are dealt by ranges of that order and sorted within them; a range starts where the counts of those before it end, so no task has more rows than its range.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.select(F.monotonically_increasing_id().alias("numbered_place"), F.struct(*rows.columns).alias("numbered_row")), "numbered")
    placed = placed.withColumn("numbered_range", F.shiftright("numbered_place", 33))
    sizes = placed.groupBy("numbered_range").agg(F.count("*").alias("size"))  # one row a range
    before = F.sum("size").over(Window.orderBy("numbered_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("numbered_range", F.coalesce(before, F.lit(0)).alias("before"))
    joined = placed.join(F.broadcast(starts), "numbered_range")
    return joined.select("numbered_row.*", (F.col("before") + F.col("numbered_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(number))


def findings_text(findings: DataFrame, by: list[str]) -> DataFrame:
    """A text for each document of a group, `## document` and then its findings by page: by..., document_name, text. findings: by..., document_name, page, finding, ref_id.

    The text of a group is these texts in the order of document_name; they stay rows, as a group may be a third of all findings.
    """
    paged = F.when(F.col("page").isNotNull(), F.concat(F.lit("**Page "), F.col("page").cast("string"), F.lit(":** "))).otherwise("")
    line = F.concat(paged, F.col("finding"), F.lit(" [REF:"), F.col("ref_id").cast("string"), F.lit("]"))
    lines = findings.withColumn("line", line).groupBy(*by, "document_name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("page"), "ref_id", "line"))).alias("lines"))
    block = F.concat(F.lit("## "), F.col("document_name"), F.lit("\n"), F.array_join("lines.line", "\n"))
    return lines.select(*by, "document_name", block.alias("text"))


def status_summary(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings, documents and pages of each group."""
    return findings.groupBy(*by).agg(F.count("*").alias("n_findings"), F.countDistinct("document_name").alias("n_documents"), F.countDistinct("document_name", "page").alias("n_pages"))


def decision_counts(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Documents of each group by status."""
    return decisions.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def without_superseded(metadata_findings: DataFrame, researched: DataFrame) -> DataFrame:
    """Findings from metadata, but for documents that were researched."""
    return metadata_findings.join(researched.select("document_id").distinct(), "document_id", "left_anti")


def reference_links(findings: DataFrame) -> DataFrame:
    """ref_id and its link, for each finding. findings: ref_id, file_name, file_link, page."""
    return findings.select("ref_id", page_link(F.col("file_name"), F.col("file_link"), F.col("page")).alias("link"))


def documents_xml(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Documents with their chunks as XML, contents and attributes escaped. chunks: by..., chunk, page, content."""
    element = F.format_string('<chunk number="%d" page="%d">%s</chunk>', "chunk", "page", xml_escaped(F.col("content")))
    grouped = chunks.withColumn("element", element).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page", "chunk", "element"))).alias("all"))
    opening = F.concat(F.lit("<document"), *[F.concat(F.lit(f' {c}="'), xml_escaped(F.col(c).cast("string")), F.lit('"')) for c in by], F.lit(">"))
    return grouped.select(*by, F.concat(opening, F.array_join("all.element", ""), F.lit("</document>")).alias("xml"))
