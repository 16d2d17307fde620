"""Vector retrieval: exact similarity search, top-k per document, and expansion of hits to their surroundings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine, norm


def with_norm(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with their length, so that it's computed once for all queries."""
    return vectors.withColumn("vector_norm", norm(F.col(vector)))


def similarity(vectors: DataFrame, query: list[float], vector: str = "embedding", digits: int = 6) -> DataFrame:
    """Rows that have a vector, with their cosine to one query vector (a literal, so nothing is joined)."""
    score = cosine(F.col(vector), F.lit([float(x) for x in query]))
    return vectors.filter(F.col(vector).isNotNull()).withColumn("score", F.round(score, digits))


def filtered(rows: DataFrame, equal: Mapping[str, object | None]) -> DataFrame:
    """Equality filters, those with a value only; they reach the scan."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def top_k(scored: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The k best rows, ties to the smaller key."""
    return scored.filter(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k)


def top_k_by(scored: DataFrame, by: str, k: int, key: str, score: str = "score") -> DataFrame:
    """The k best rows of each group, with their rank; Spark limits each group before the shuffle."""
    best = Window.partitionBy(by).orderBy(F.desc(score), key)
    return scored.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def merged_ranges(ranges: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and adjacent ranges of integers joined, per group."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col(start) > F.coalesce(F.max(end).over(before) + 1, F.col(start) - 1)).cast("int")
    islands = ranges.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def neighbours(chunks: DataFrame, hits: DataFrame, by: list[str], number: str, n: int) -> DataFrame:
    """Chunks at most n away from a hit of the same group; each hit asks for 2n + 1 numbers, so the join stays an equality join."""
    wanted = hits.select(*by, F.explode(F.sequence(F.greatest(F.col(number) - n, F.lit(0)), F.col(number) + n)).alias(number)).distinct()
    return chunks.join(wanted, [*by, number], "left_semi")


def gap_pages(pages: DataFrame, by: list[str], page: str, most: int) -> DataFrame:
    """The pages missing between two found pages, where at most `most` are missing."""
    order = Window.partitionBy(*by).orderBy(page)
    following = pages.select(*by, page).distinct().withColumn("following", F.lead(page).over(order))
    missing = F.col("following") - F.col(page) - 1
    return following.filter(missing.between(1, most)).select(*by, F.explode(F.sequence(F.col(page) + 1, F.col("following") - 1)).alias(page))


def expansion_metrics(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per document: chunks, pages and sections found, and the ratio of chunks to seeds (1 without seeds)."""
    counts = found.groupBy("document").agg(F.countDistinct("chunk").alias("n_chunks"), F.countDistinct("page").alias("n_pages"), F.countDistinct("section").alias("n_sections"))
    asked = seeds.groupBy("document").agg(F.countDistinct("chunk").alias("n_seeds"))
    joined = counts.join(asked, "document", "left").withColumn("n_seeds", F.coalesce("n_seeds", F.lit(0)))
    return joined.withColumn("ratio", F.when(F.col("n_seeds") > 0, F.round(F.col("n_chunks") / F.col("n_seeds"), 2)).otherwise(1.0))


def chunk_groups(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks of whole documents in groups of a section and a subsection (null: none): by..., section, subsection, section_name, subsection_name, path, level, place, chunk_ids.

    Names and paths are the first that aren't empty. Numbered sections come first, and in a section the chunks without a subsection; a chunk counts once, where it stands first.
    chunks: by..., chunk_id, page, chunk, section, section_name, subsection, subsection_name, path.
    """
    at = F.struct(F.coalesce("page", F.lit(0)).alias("page"), "chunk")
    named = F.coalesce("chunk_id", F.lit("")) != ""
    rows = chunks.repartition(*by)  # a document's chunks move together, once
    first = lambda c: F.min(F.when(F.coalesce(c, F.lit("")) != "", F.struct("page", "chunk", F.col(c).alias("value"))))
    groups = rows.groupBy(*by, "section", "subsection").agg(
        F.array_distinct(F.sort_array(F.collect_list(F.when(named, F.struct(at.alias("at"), "chunk_id"))))["chunk_id"]).alias("chunk_ids"),
        first("section_name").alias("name"), first("path").alias("own"), first("subsection_name")["value"].alias("subsection_name"),
    )
    section = Window.partitionBy(*by, "section")
    joined = groups.withColumns({"section_name": F.min("name").over(section)["value"], "section_path": F.min("own").over(section)["value"], "own_path": F.col("own.value")}).filter(F.size("chunk_ids") > 0)
    whole = F.col("subsection").isNull()
    order = Window.partitionBy(*by).orderBy(F.col("section").asc_nulls_last(), F.coalesce("subsection", F.lit(-1)))
    place = F.row_number().over(order).cast("long")
    return joined.select(*by, "section", "subsection", "section_name", F.when(~whole, F.col("subsection_name")).alias("subsection_name"), F.when(whole, F.col("section_path")).otherwise(F.col("own_path")).alias("path"), F.when(whole, "document_full").otherwise("subsection").alias("level"), place.alias("place"), "chunk_ids")


def documents_by_id(documents: DataFrame, wanted: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """The documents of the wanted ids, and the wanted ids that there is no document for."""
    ids = wanted.select(key).distinct()
    return documents.join(ids, key, "left_semi"), ids.join(documents.select(key), key, "left_anti")
