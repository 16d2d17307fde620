"""Mixing sources to target weights, with DataFrame operations only.

Every source gets a budget of words. Documents are put in the order of a hash of their id, and a
source's mix takes each document a whole number of times plus once more for those whose hash lies
below the source's threshold. The threshold comes from nested histograms: words are summed by source
and the hash's leading bits, the bucket in which the budget runs out is found, and only the documents
of that bucket are summed again by the bits that follow. Nothing is sorted and nothing is sampled.

Defined results: a null or empty text has size 0; a null source is a source of its own, ordered last;
rows that repeat a doc_id share its hash and so its fate; a null doc_id hashes as an empty string; an empty
table gives an empty mix. Other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.arrow import numbered
from quillspark.sources.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: The hash has LEVELS * BITS bits; each pass over the boundary bucket settles BITS of them.
LEVELS, BITS = 3, 12
#: Thresholds of so many sources are broadcast (a row has under 100 bytes); beyond, they are joined with salt.
BROADCAST_SOURCES = 50_000
SALTS = 64


def words(text: str = "text") -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(key: str = "doc_id") -> Column:
    """36 bits from the id: the document's place in its source's order."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """A budget for each row of sizes (mix_source, source_size): one row per source.

    share times all words are divided by weight; a source stops at most times its own words, and what that
    leaves is divided again among the others until none is above. In the order of most * size / weight the
    sources that stop are the first ones, so running sums find them without a loop.
    """
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    ratio = Window.orderBy("stops_at")
    everything = Window.partitionBy()
    pattern = F.array(*[F.lit(w).cast("double") for w in weights])
    ranked = sizes.withColumn("weight", F.get(pattern, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * F.lit(float(most))).withColumn("stops_at", F.col("ceiling") / F.col("weight"))
    upto = ratio.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.sum("source_size").over(everything) * F.lit(share)
    used = F.sum("ceiling").over(upto) + F.col("stops_at") * (F.sum("weight").over(everything) - F.sum("weight").over(upto))
    ranked = ranked.withColumn("budget", budget).withColumn("stops", used <= F.col("budget"))
    left = F.col("budget") - F.sum(F.when(F.col("stops"), F.col("ceiling")).otherwise(0.0)).over(everything)
    level = F.try_divide(left, F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("stops"), F.col("ceiling")).otherwise(F.col("weight") * level)
    return ranked.select("mix_source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """For each source: mix_source, source_size, target, whole (copies of every document) and below (the hash under which one more is taken).

    sized has mix_source, size and place. The bucket in which the budget runs out is refined until a single hash is left,
    which is taken if that brings the source nearer to its target.
    """
    sizes = sized.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    state = targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = state.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    state = written(state, "mix-state")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bits = F.shiftright("place", shift)
        found = sized
        if level:
            edge = state.filter("prefix is not null").select(F.col("mix_source").alias("edge_source"), "prefix")
            found = small_join(sized, edge, (F.shiftright("place", shift + BITS) == F.col("prefix")), "edge_source")
        histogram = found.groupBy("mix_source", bits.alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("mix_source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("words").over(running)).withColumnRenamed("mix_source", "of_source")
        crossed = histogram.join(state.select("mix_source", "need"), F.col("of_source").eqNullSafe(F.col("mix_source"))).filter(F.col("upto") > F.col("need"))
        first = crossed.groupBy("of_source").agg(F.min(F.struct("bucket", "upto", "words")).alias("edge"))
        state = state.join(first, F.col("of_source").eqNullSafe(F.col("mix_source")), "left").select(
            "mix_source", "source_size", "target", "whole",
            (F.col("need") - F.coalesce(F.col("edge.upto") - F.col("edge.words"), F.lit(0))).alias("need"),
            F.col("edge.bucket").alias("prefix"), F.col("edge.words").alias("words"),
        )
        state = written(state, "mix-state")
    nearer = F.col("words") - F.col("need") < F.col("need")
    below = F.when(F.col("prefix").isNull(), F.lit(1 << (LEVELS * BITS))).otherwise(F.col("prefix") + nearer.cast("long"))
    return state.select("mix_source", "source_size", "target", "whole", below.cast("long").alias("below"))


def small_join(rows: DataFrame, by_source: DataFrame, condition: Column, name: str) -> DataFrame:
    """rows joined with one row per source: broadcast where the sources are counted to be few, else salted so that a hot source spreads."""
    same = F.col("mix_source").eqNullSafe(F.col(name))
    if by_source.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(by_source), same & condition)
    salted = by_source.withColumn("their_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.col("place") % SALTS).cast("int")).join(salted, same & condition & (F.col("salt") == F.col("their_salt"))).drop("salt", "their_salt")


def mixed(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """docs with mix_source and place, with copies, the times that the mix takes each row, and its source's figures."""
    named = limits.withColumnRenamed("mix_source", "limit_source")
    return small_join(docs, named, F.lit(True), "limit_source").withColumn("copies", F.col("whole") + (F.col("place") < F.col("below")).cast("long")).drop("limit_source", "whole", "below")


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """keep, size, mix_source and place of every row."""
    return docs.select(*[F.col(c) for c in keep], words(text).alias("size"), F.col(source).alias("mix_source"), place(key).alias("place"))


def mix_report(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of docs."""
    rows = written(sized(docs, keep=["doc_id"]), "mix-sized")
    limits = thresholds(rows, weights, share, most)
    return mixed(rows, limits).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: the rows of docs, each as many times as its source's budget takes it, with the columns of docs."""
    limits = thresholds(written(sized(docs), "mix-sized"), weights, share, most)
    plain, names = numbered(docs)
    at = dict(zip(docs.columns, names))
    row = plain.select(F.struct(*names).alias("row"), F.col(at["source"]).alias("mix_source"), place(at["doc_id"]).alias("place"))
    taken = mixed(row, limits).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*").toDF(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS ceiling,
         ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources),
filled AS (
  SELECT *, sum(ceiling) OVER upto + ceiling / weight * (sum(weight) OVER () - sum(weight) OVER upto) <= budget AS stops
  FROM ranked WINDOW upto AS (ORDER BY ceiling / weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (
  SELECT source, source_size, CASE WHEN stops THEN ceiling ELSE weight *
           ((budget - sum(CASE WHEN stops THEN ceiling ELSE 0 END) OVER ()) / sum(CASE WHEN stops THEN 0 ELSE weight END) OVER ()) END AS target
  FROM filled),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
places AS (
  SELECT source, place, sum(size)::BIGINT AS words FROM sized GROUP BY source, place),
running AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM places),
extra AS (
  SELECT r.source, r.place, CASE WHEN upto <= target - whole * source_size THEN 1
    WHEN upto - words <= target - whole * source_size
         AND upto - (target - whole * source_size) < (target - whole * source_size) - (upto - words) THEN 1 ELSE 0 END AS more
  FROM running r JOIN needs n ON r.source IS NOT DISTINCT FROM n.source)
SELECT s.doc_id, s.size, n.source_size, n.target, s.size * (n.whole + e.more) AS taken, n.whole + e.more AS copies
FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source
JOIN extra e ON s.source IS NOT DISTINCT FROM e.source AND s.place = e.place
"""
