"""Research in two stages, for many questions in one plan: documents are ranked and decided on by their summaries and best chunks, then read with their context.

Stage 1: every question ranks the documents of its sources by the similarity of their summaries, numbers them, brings their best chunks, and cuts them into batches.
Somebody (a model, outside) decides on each document of a batch. Decisions are validated; answers become findings, and documents that need research go to stage 2.
Stage 2: their seed chunks are expanded to their context in the chunk store and laid out as texts to read; what is found there joins the findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import xml_escaped
from quillspark.operators import chunk_store, findings, vector_cells

#: Documents by summary that a selection of files always looks at.
TOP_SUMMARIES = 5


def numbered_in(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], number: str) -> DataFrame:
    """rows with consecutive numbers from 1 on in each group. All rows are sorted by ranges and numbered, and each group's first number is taken off, so no group needs one task."""
    whole = findings.numbered(rows, [*by, *order], number)
    first = whole.groupBy(*by).agg(F.min(number).alias("first_number"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return whole.alias("a").join(first.alias("b"), same).select(*[f"a.{c}" for c in rows.columns], (F.col(f"a.{number}") - F.col("b.first_number") + 1).alias(number))


def ranked_documents(documents: DataFrame, questions: DataFrame, batch_size: int, digits: int = 6, chunks: DataFrame | None = None, n: int = 0) -> DataFrame:
    """Every question's documents with similarity, document_index (from 1, best first, ties by id) and batch (from 0); with chunks, also best: the n best chunks of the document (chunk_id, score).

    documents: document_id, data_source, summary_embedding, ...; questions: question_id, data_source, query_embedding; chunks: document_id, chunk_id, embedding. Documents without a summary's vector come last.
    A source's documents are ranked in one cell with their chunks, for some questions at a time; where its vectors are too large for that, pairs are scored in smaller cells, sorted by ranges and numbered.
    """
    if chunks is not None:
        chunks = chunks.select("document_id", "chunk_id", "embedding").join(documents.select("document_id", "data_source"), "document_id")
    large = vector_cells.whole_sources(documents, chunks, "data_source", "summary_embedding", "embedding").filter("large").select("data_source")
    parts = [(documents, chunks)]
    if not large.isEmpty():
        large = F.broadcast(large)  # each has more than COMPONENTS
        split = lambda how: [None if t is None else t.join(large, "data_source", how) for t in (documents, chunks)]
        parts = [split("left_anti"), split("left_semi")]
    rows = vector_cells.ranked(parts[0][0], "summary_embedding", "data_source", "document_id", questions, "question_id", "query_embedding", digits, parts[0][1], n=n)
    if len(parts) > 1:
        rows = rows.unionByName(ranked_by_pairs(*parts[1], questions, digits, n, rows.schema["best"].dataType))
    return in_batches(rows if chunks is not None else rows.drop("best"), batch_size)


def ranked_by_pairs(documents: DataFrame, chunks: DataFrame | None, questions: DataFrame, digits: int, n: int, kind: T.DataType) -> DataFrame:
    """ranked_documents() for sources of any size: every pair of a question and a document is a row that is moved."""
    vectors = questions.select("question_id", "query_embedding").dropDuplicates(["question_id"])
    pairs = questions.select("question_id", "data_source").distinct()
    met = vector_cells.scored(documents, "summary_embedding", "data_source", "document_id", vectors, "question_id", "query_embedding", pairs, digits)
    rows = met.select(*[c for c in documents.columns if c != "summary_embedding"], "question_id", F.col("score").alias("similarity"))
    indexed = numbered_in(rows, ["question_id", "data_source"], [F.col("similarity").desc_nulls_last(), "document_id"], "document_index")
    if chunks is None:
        return indexed.withColumn("best", F.array().cast(kind))
    wanted = documents.select("document_id", "data_source").join(pairs, "data_source").select("question_id", "document_id").distinct()
    own = chunks.drop("data_source").dropDuplicates(["document_id", "chunk_id"])
    lists = best_chunks(own, questions, wanted, n, digits).groupBy("question_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("best"))
    best = F.coalesce(F.transform("best", lambda x: F.struct(x["chunk_id"], x["score"])), F.array()).cast(kind)
    return indexed.join(lists, ["question_id", "document_id"], "left").withColumn("best", best)


def in_batches(indexed: DataFrame, size: int) -> DataFrame:
    """rows numbered from 1 on in document_index with their batch of `size`."""
    return indexed.withColumn("batch", F.floor((F.col("document_index") - 1) / size).cast("long"))


def best_chunks(chunks: DataFrame, questions: DataFrame, ranked: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """The n best chunks of every ranked document: question_id, document_id, rank, score and the chunk's columns. chunks: document_id, chunk_id, embedding, ...; questions: question_id, query_embedding."""
    vectors = questions.select("question_id", "query_embedding").dropDuplicates(["question_id"])
    scored = vector_cells.scored(chunks.filter("embedding is not null"), "embedding", "document_id", "chunk_id", vectors, "question_id", "query_embedding", ranked.select("question_id", "document_id"), digits, n)
    place = Window.partitionBy("question_id", "document_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= n)


def batch_texts(ranked: DataFrame, excerpts: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """What is to be read of each document of a batch, as XML: question_id, data_source, batch, document_index, text; a batch's text is its documents' in order.

    ranked: also document_name, document_type, page_count, summary; excerpts: question_id, document_id, rank, page, location, content; top: question_id, document_id that are marked.
    """
    say = lambda tag, value: F.concat(F.lit(f"  <{tag}>"), xml_escaped(value), F.lit(f"</{tag}>\n"))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
    excerpt = F.concat(F.lit('    <excerpt page="'), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit('" location="'), xml_escaped(F.coalesce("location", F.lit(""))), F.lit('">\n      '), xml_escaped(F.coalesce("content", F.lit(""))), F.lit("\n    </excerpt>\n"))
    lists = excerpts.withColumn("excerpt", excerpt).groupBy("question_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))).alias("excerpts"))
    marked = (ranked.limit(0) if top is None else top).select("question_id", "document_id").distinct().withColumn("marked", F.lit(" [TOP SUMMARY MATCH]"))
    rows = ranked.join(lists, ["question_id", "document_id"], "left").join(marked, ["question_id", "document_id"], "left")
    text = F.concat(
        F.lit('<document index="'), F.col("document_index").cast("string"), F.lit('"'), F.coalesce("marked", F.lit("")), F.lit(">\n"), say("document_id", F.col("document_id").cast("string")), say("document_name", known("document_name")),
        say("type", known("document_type")), say("pages", known("page_count")), F.when(F.coalesce("summary", F.lit("")) != "", say("summary", F.col("summary"))).otherwise(""),
        F.when(F.col("excerpts").isNotNull(), F.concat(F.lit("  <excerpts>\n"), F.array_join("excerpts.excerpt", ""), F.lit("  </excerpts>\n"))).otherwise(""), F.lit("</document>"),
    )
    return rows.select("question_id", "data_source", "batch", "document_index", text.alias("text"))


def decided(ranked: DataFrame, proposals: DataFrame) -> DataFrame:
    """One valid decision for each ranked document. proposals: question_id, data_source, document_index, status, finding, page, at (their order)."""
    by = ["question_id", "data_source"]
    return findings.validated(ranked.select(*by, "document_index", "document_id"), proposals, by)


def decided_in_place(ranked: DataFrame) -> DataFrame:
    """decided() of ranked documents that carry their proposals, a list of (at, status, finding, page) or null: the other columns stay, and nothing is joined."""
    return findings.validated_in_place(ranked, "proposals")


def metadata_findings(decisions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Findings of decisions that are answered or to be researched, with the names of their documents: question_id, data_source, document_index, document_id, document_name, file_name, file_link, page, finding, source.

    decisions: question_id, data_source, document_index, document_id, status, finding, page; documents: document_id, document_name, file_name. Decisions on unknown documents have none.
    Without documents, decisions have these names themselves.
    """
    own = F.nullif("file_name", F.lit("")).alias("own_file")
    rows = findings.findings_of(decisions)
    named = rows.withColumn("own_file", own) if documents is None else rows.join(documents.select("document_id", "document_name", own), "document_id")
    return named.select("question_id", "data_source", "document_index", "document_id", "document_name", F.coalesce("own_file", "document_name").alias("file_name"), F.coalesce("own_file", F.lit("")).alias("file_link"), "page", "finding", F.lit("metadata").alias("source"))


def outcome(decisions: DataFrame) -> DataFrame:
    """question_id, data_source and how many documents were answered, need research, and are irrelevant."""
    return findings.decision_counts(decisions, ["question_id", "data_source"])


def to_research(decisions: DataFrame, most: int | None = None) -> DataFrame:
    """question_id, data_source, document_id, document_index of documents that need research; the first `most` of each question and source, if given."""
    found = decisions.filter("status = 'needs_deep_research'").select("question_id", "data_source", "document_id", "document_index")
    if most is None:
        return found
    place = F.row_number().over(Window.partitionBy("question_id", "data_source").orderBy("document_index"))
    return found.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def read_in_context(store: chunk_store.ChunkStore, documents: DataFrame, seeds: DataFrame, **limits: int) -> DataFrame:
    """question_id, and the chunks of the store that a question's seeds bring, with expansion_level; the chunks are not shuffled. documents: document, page_count; seeds: question_id, document, chunk."""
    return chunk_store.expanded(store.rows(), documents, seeds, by=["question_id"], **limits)


def context_texts(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The chunks of each document as XML, by section (null last) and subsection (0 or null: directly in the section, after the others): by..., n_chunks, text.

    chunks: by..., chunk, page, section, section_name, subsection, subsection_name, content.
    """
    none = F.coalesce(F.col("subsection") == 0, F.lit(True))
    indent = F.when(none, F.lit("    ")).otherwise(F.lit("      "))
    content = F.array_join(F.transform(F.split(xml_escaped(F.coalesce("content", F.lit(""))), "\r\n|\n|\r"), lambda line: F.concat(indent, F.lit("  "), line)), "\n")
    chunk = F.concat(indent, F.lit('<chunk page="'), F.coalesce(F.col("page").cast("string"), F.lit("unknown")), F.lit('">\n'), content, F.lit("\n"), indent, F.lit("</chunk>"))
    rows = chunks.withColumn("element", chunk).withColumn("own", F.when(~none, F.col("subsection")))
    filled = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.struct("page", "chunk")))
    sub = rows.groupBy(*by, "section", "own").agg(
        F.array_sort(F.collect_list(F.struct("page", "chunk", "element"))).alias("elements"), filled("section_name").alias("section_name"), filled("subsection_name").alias("subsection_name"), F.min("page").alias("page"), F.min("chunk").alias("chunk"),
    )
    body = F.array_join("elements.element", "\n")
    title = F.coalesce("subsection_name", F.concat(F.lit("Subsection "), F.col("own").cast("string")))
    sub = sub.withColumn("body", F.when(F.col("own").isNull(), body).otherwise(F.concat(F.lit('    <subsection name="'), xml_escaped(title), F.lit('">\n'), body, F.lit("\n    </subsection>"))))
    sub = sub.withColumn("n", F.size("elements"))
    section = sub.groupBy(*by, "section").agg(F.array_sort(F.collect_list(F.struct(F.col("own").isNull().alias("last"), "own", "body"))).alias("bodies"), filled("section_name").alias("section_name"), F.sum("n").alias("n"))
    name = F.when(F.coalesce("section_name", F.lit("")) != "", F.concat(F.lit(' name="'), xml_escaped(F.col("section_name")), F.lit('"'))).otherwise("")
    section = section.withColumn("body", F.concat(F.lit("  <primary_section"), name, F.lit(">\n"), F.array_join("bodies.body", "\n"), F.lit("\n  </primary_section>")))
    whole = section.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("section").isNull().alias("last"), "section", "body"))).alias("sections"), F.sum("n").alias("n_chunks"))
    opening = F.concat(F.lit("<document"), *[F.concat(F.lit(f' {c}="'), xml_escaped(F.col(c).cast("string")), F.lit('"')) for c in by], F.lit(">\n"))
    return whole.select(*by, "n_chunks", F.concat(opening, F.array_join("sections.body", "\n"), F.lit("\n</document>")).alias("text"))
