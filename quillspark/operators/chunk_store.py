"""A store of chunks, bucketed and sorted by document, and what is read from it without moving a chunk between machines.

Requests (documents, sections, pages, chunks) are shuffled or broadcast to the chunks' buckets; the chunks themselves stay where they lie. Joins therefore use the
document alone as their key, and test the rest of a request as a condition: a key of two columns would need the chunks dealt anew.
A request is a row; a chunk that several requests ask for comes once. A section, subsection or sheet that is null asks for chunks without one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = ("document", "page", "chunk")
LEVELS = ("full", "primary", "subsection", "neighbor", "gap")


@dataclass
class ChunkStore:
    """A table of rows that have a document, in `buckets` buckets."""

    spark: SparkSession
    name: str
    path: str
    buckets: int

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)


def write_store(rows: DataFrame, path: str, buckets: int = 200, order: Sequence[str] = ORDER) -> ChunkStore:
    """rows as a store at path. Each bucket is one file, sorted; buckets are chosen so that a bucket fits a task."""
    name = f"store_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, "document")
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, "document").sortBy(*[c for c in order if c in rows.columns]).saveAsTable(name)
    return ChunkStore(rows.sparkSession, name, path, buckets)


def open_store(spark: SparkSession, path: str, schema: T.StructType, buckets: int, order: Sequence[str] = ORDER) -> ChunkStore:
    """A store that another session has written."""
    name = f"store_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (document) SORTED BY ({', '.join(c for c in order if c in schema.names)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return ChunkStore(spark, name, path, buckets)


def same(a: Column, b: Column) -> Column:
    """Null-safe equality as a condition, not as a key of the join."""
    return F.coalesce(a == b, F.lit(False)) | (a.isNull() & b.isNull())


def asked(rows: DataFrame, requests: DataFrame, condition: Column | None = None) -> DataFrame:
    """The rows r that a request q of the same document asks for."""
    on = F.col("r.document") == F.col("q.document")
    return rows.alias("r").join(requests.distinct().alias("q"), on if condition is None else on & condition, "left_semi").select("r.*")


def in_sources(documents: DataFrame, sources: Sequence[str], column: str = "data_source") -> DataFrame:
    """Documents of the sources in a list; an empty list has none. The filter reaches the scan."""
    return documents.filter(F.col(column).isin(list(sources)) if sources else F.lit(False))


def of_documents(store: ChunkStore, requests: DataFrame) -> DataFrame:
    """All rows of documents. requests: document."""
    return asked(store.rows(), requests.select("document"))


def of_pages(store: ChunkStore, requests: DataFrame) -> DataFrame:
    """Chunks of page ranges, both ends included. requests: document, first, last."""
    return asked(store.rows(), requests.select("document", "first", "last"), F.col("r.page").between(F.col("q.first"), F.col("q.last")))


def of_sections(store: ChunkStore, requests: DataFrame) -> DataFrame:
    """All chunks of primary sections. requests: document, section."""
    return asked(store.rows(), requests.select("document", "section"), same(F.col("r.section"), F.col("q.section")))


def of_subsections(store: ChunkStore, requests: DataFrame) -> DataFrame:
    """All chunks of subsections. requests: document, section, subsection."""
    return asked(store.rows(), requests.select("document", "section", "subsection"), same(F.col("r.section"), F.col("q.section")) & same(F.col("r.subsection"), F.col("q.subsection")))


def neighbours(store: ChunkStore, requests: DataFrame) -> DataFrame:
    """Chunks of a section whose numbers lie in a range, both ends included. requests: document, section, first, last."""
    return asked(store.rows(), requests.select("document", "section", "first", "last"), same(F.col("r.section"), F.col("q.section")) & F.col("r.chunk").between(F.col("q.first"), F.col("q.last")))


def found_regions(store: ChunkStore, requests: DataFrame, by_sheet: bool = True) -> DataFrame:
    """One row of a store of dense tables for each request: requests with `found`, null if there is none; of several the one of the smallest table id.

    requests: document, region_id, and sheet_name unless by_sheet is false; store: document, region_id, sheet_name, dense_table_id, ...
    """
    names = ["document", "region_id", *(["sheet_name"] if by_sheet else [])]
    rows = store.rows()
    on = (F.col("r.document") == F.col("q.document")) & F.coalesce(F.col("r.region_id") == F.col("q.region_id"), F.lit(False))
    if by_sheet:
        on = on & F.coalesce(F.col("r.sheet_name") == F.col("q.sheet_name"), F.lit(False))
    wanted = requests.select(*names).distinct()
    met = rows.alias("r").join(wanted.alias("q"), on).select(*[F.col(f"q.{n}") for n in names], F.struct(*[F.col(f"r.`{c}`") for c in rows.columns]).alias("row"))
    one = met.groupBy(*names).agg(F.min_by("row", "row.dense_table_id").alias("found"))
    null_safe = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    return requests.alias("a").join(one.alias("b"), null_safe, "left").select("a.*", "found")


def regions_of_documents(store: ChunkStore, requests: DataFrame) -> DataFrame:
    """The dense tables of documents with their place in the order of region ids, as text."""
    place = F.row_number().over(Window.partitionBy("document").orderBy("region_id", "dense_table_id")).cast("long")
    return of_documents(store, requests).withColumn("place", place)


def expanded(chunks: DataFrame, documents: DataFrame, seeds: DataFrame, full: int = 6, section: int = 6, subsection: int = 3, around: int = 2, gap: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Seeds expanded to their context, with expansion_level, in one pass over the chunks of the documents that have seeds.

    chunks: document, chunk, page, section, subsection (0: none), section_pages, subsection_pages; documents: document, page_count;
    seeds: document, chunk, and columns `by` (a question, say): each value has its own expansion, and comes before the chunks' columns. A document of at most `full` pages is taken whole. Otherwise a seed brings its whole section if that has at most
    `section` pages, or else its subsection if that has at most `subsection` pages, or else its neighbours in the section. Gaps of at most
    `gap` pages between found pages are filled. A chunk found in several ways has the first of the levels full, primary, subsection, neighbor, gap.
    An unknown number of pages counts as too large. Every window begins with the document, so chunks that are bucketed by it are not shuffled.
    """
    wanted = seeds.groupBy("document", *by).agg(F.collect_set("chunk").alias("seed_chunks")).join(documents.select("document", "page_count"), "document", "left")  # a document's seeds
    rows = chunks.alias("r").join(wanted.alias("q"), F.col("r.document") == F.col("q.document")).select("r.*", *[f"q.{c}" for c in by], "q.seed_chunks", "q.page_count")
    short = F.coalesce(F.col("page_count") <= full, F.lit(False))
    small_section = F.coalesce(F.col("section_pages") <= section, F.lit(False))
    small_sub = F.coalesce(F.col("subsection_pages") <= subsection, F.lit(False)) & (F.col("subsection") > 0)
    way = F.when(short, 1).when(F.array_contains("seed_chunks", F.col("chunk")), F.when(small_section, 2).when(small_sub, 3).otherwise(4))
    rows = rows.withColumn("way", way)
    hit = lambda n, window: F.coalesce(F.max((F.col("way") == n).cast("int")).over(window), F.lit(0)) == 1
    in_section, in_sub = Window.partitionBy("document", *by, "section"), Window.partitionBy("document", *by, "section", "subsection")
    near = in_section.orderBy("chunk").rangeBetween(-around, around)
    level = F.when(F.col("way") == 1, 1).when(hit(2, in_section), 2).when(hit(3, in_sub), 3).when(hit(4, near), 4)
    rows = rows.withColumn("level", level)
    found_page = F.when(F.col("level") > 1, F.col("page"))
    upto = lambda order: Window.partitionBy("document", *by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before = F.max(found_page).over(upto(F.col("page")))
    after = F.min(found_page).over(upto(F.desc("page")))
    rows = rows.withColumn("before", before).withColumn("after", after)
    between = F.col("level").isNull() & (F.col("before") < F.col("page")) & (F.col("page") < F.col("after")) & (F.col("after") - F.col("before") - 1 <= gap)
    level = F.when(F.col("level").isNotNull(), F.col("level")).when(between, 5)
    named = F.when(level == 1, LEVELS[0])
    for i, name in enumerate(LEVELS[1:], 2):
        named = named.when(level == i, name)
    kept = rows.withColumn("expansion_level", named).filter("expansion_level is not null")
    return kept.select(*by, *chunks.columns, "expansion_level")
