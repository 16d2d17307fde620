"""What a question is asked of: sources of the registry, their filters, combinations, files, and the findings that come back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = ("filter_1", "filter_2", "filter_3")


def enabled_sources(registry: DataFrame) -> DataFrame:
    """Enabled rows of a registry with a text for every null label and description, and the document's summary as context where none is named."""
    texts = [c for c in registry.columns if c.endswith(("_label", "_description"))]
    filled = registry.filter("enabled").withColumns({c: F.coalesce(c, F.lit("")) for c in texts})
    context = F.coalesce(F.when(F.size("metadata_context_fields") > 0, F.col("metadata_context_fields")), F.array(F.lit("document_summary")))
    return filled.withColumn("metadata_context_fields", context).withColumn("sample_questions", F.coalesce("sample_questions", F.array().cast("array<string>")))


def missing_fields(config: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows of config in which a required field is null, with the names of those fields."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return config.withColumn("missing", missing).filter(F.size("missing") > 0)


def of_known_sources(rows: DataFrame, sources: DataFrame, column: str = "data_source") -> DataFrame:
    """rows whose source is registered; those of other sources are dropped."""
    return rows.join(sources.select(column).distinct(), column, "left_semi")


def config_of(sources: DataFrame, wanted: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The named columns of the wanted sources; a LookupError names those that aren't registered."""
    found = sources.filter(F.col("data_source").isin(list(wanted)) if wanted else F.lit(False)).select("data_source", *columns)
    known = {r.data_source for r in found.select("data_source").distinct().collect()}  # no more than were asked for
    if missing := sorted(set(wanted) - known):
        raise LookupError(f"no such data source: {', '.join(missing)}")
    return found


def filters_of(sources: DataFrame) -> DataFrame:
    """data_source and levels: the filters that have a label."""
    labelled = F.array_compact(F.array(*[F.when(F.col(f"{f}_label") != "", F.lit(f)) for f in FILTERS]))
    return sources.select("data_source", labelled.alias("levels"))


def needs_resolution(sources: DataFrame, given: DataFrame) -> DataFrame:
    """data_source, levels and given: the sources with a labelled filter that isn't given. given: data_source, filters (a map); an empty value gives nothing."""
    rows = filters_of(sources).join(given.select("data_source", F.col("filters").alias("given")), "data_source", "left")
    rows = rows.withColumn("given", F.coalesce("given", F.create_map().cast("map<string,string>")))
    return rows.filter(F.exists("levels", lambda level: F.coalesce(F.try_element_at("given", level), F.lit("")) == ""))


def merged_filters(given: Column, resolved: Column) -> Column:
    """Filters that were given, replaced by resolved ones of the same level."""
    resolved = F.coalesce(resolved, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(resolved, k)), resolved)


def picked_by_index(choices: DataFrame, offered: DataFrame, by: list[str], index: str = "index") -> DataFrame:
    """Choices by their place among what was offered, from 1 on; places that weren't offered are dropped."""
    return choices.join(offered, [*by, index])


def selected(choices: DataFrame, by: list[str], key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` different keys of each group in the order given, with their rank."""
    first = choices.groupBy(*by, key).agg(F.min(F.struct(*order)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("first", key)).cast("long")
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).select(*by, key, "rank")


def research_path(db_wide: Column, approved: Column, deep: Column) -> Column:
    """A: documents were approved before; B: the whole source in two stages; C: metadata alone, where deep research isn't enabled for a source-wide question."""
    return F.when(approved, "A").when(db_wide & ~deep, "C").otherwise("B")


def combined_findings(parts: list[DataFrame]) -> DataFrame:
    """Findings of several sources or stages one after the other, with the number of their part; a document's findings keep its id, whatever its name."""
    every = parts[0].withColumn("part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("part", F.lit(i)))
    return every
