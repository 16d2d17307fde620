"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases as LZ78 does: from left to right, each phrase is the longest one already in the dictionary and one more
symbol. The symbols are words (runs without white space, cut after SYMBOL code points). The set of phrases stands for
what a compressor would learn from the text; its SIZE least hashes are the fingerprint, and the likeness of two fingerprints is the
share of the least hashes of both sets together that are in both (a bottom-k estimate of the sets' Jaccard similarity).

Defined results: null and empty texts have an empty fingerprint; two empty fingerprints are alike (1), an empty and another one aren't (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrow import in_batches

#: Hashes of 32 bits in a fingerprint, and code points of a symbol at most.
SIZE, SYMBOL = 128, 24
#: Ranges of ids for each partition; many small ones spread evenly.
FINER = 8
INFINITY = float("inf")


def symbols(text: str) -> list[str]:
    words = text.split()
    if len(text) > SYMBOL and max(map(len, words), default=0) > SYMBOL:
        return [w[i : i + SYMBOL] for w in words for i in range(0, len(w), SYMBOL)]
    return words


def parse(words: Iterable[str], phrases: dict[str, None], open_: str = "") -> str:
    """Adds the phrases of words to phrases, in order; takes and gives the phrase that isn't finished."""
    for word in words:
        open_ += word
        if open_ in phrases:
            open_ += " "
        else:
            phrases[open_] = None
            open_ = ""
    return open_


def least(phrases: Iterable[str]) -> np.ndarray:
    """The SIZE least hashes, in order."""
    hashes = np.unique(np.fromiter(map(xxhash.xxh32_intdigest, phrases), np.uint32))
    return hashes[:SIZE]


def fingerprint(text: str) -> np.ndarray:
    phrases: dict[str, None] = {}
    rest = parse(symbols(text), phrases)
    return least([*phrases, rest] if rest else phrases)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two phrase sets, from their fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SIZE]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many code points from the start of the following text, or all that it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (part, past, id, text), sorted by (part, past, id, text): the documents dealt by ranges of id.

    Each part ends with a copy of the first row of the next part that has rows, marked past (after the last part: of the first),
    so that every document has its successor in its own part. Ids are read first, alone, to choose the ranges; texts move once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = [i / (FINER * parts) for i in range(1, FINER * parts)]
    edges = docs.agg(F.percentile_approx("id", marks, max(10_000, len(marks)))).first()[0]
    edges = sorted({float(e) for e in edges or []})
    # as doubles ids keep their order, so equal ones share a part; a null id comes before all others
    place = F.coalesce(F.col("id").cast("double"), F.lit(-INFINITY))
    rows = Bucketizer(splits=[-INFINITY, *(edges or [0.0]), INFINITY], inputCol="place", outputCol="range").transform(docs.withColumn("place", place))
    rows = rows.select(F.col("range").cast("int").alias("part"), F.lit(False).alias("past"), "id", "text")
    heads = rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("named"), "id")).alias("head")).orderBy("part").collect()  # one row a part
    if not heads:
        return rows
    # a row for each part, so its broadcast is bounded by the number of parts
    firsts = spark.createDataFrame([(h.part, h.head.id, heads[i - 1].part) for i, h in enumerate(heads)], "head_part int, head long, before int")
    copies = rows.join(F.broadcast(firsts), (F.col("part") == F.col("head_part")) & F.col("id").eqNullSafe(F.col("head")))
    # of rows that share the id, the first is the one with the least text, null before all
    copies = copies.groupBy("before", "id").agg(F.min("text").alias("text"), F.count_if(F.col("text").isNull()).alias("nulls"))
    copies = copies.select(F.col("before").alias("part"), F.lit(True).alias("past"), "id", F.when(F.col("nulls") == 0, F.col("text")).alias("text"))
    return rows.unionByName(copies).repartition(parts, "part").sortWithinPartitions("part", "past", "id", "text")


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to each document's fingerprint, that of its edited text, and the two likenesses."""
    held = None  # the document whose successor comes next
    for batch in batches:
        out = []
        for part, past, id_, text in zip(*(batch.column(c).to_pylist() for c in ("part", "past", "id", "text"))):
            text = text or ""
            words = symbols(text)
            phrases: dict[str, None] = {}
            rest = parse(words, phrases)
            own = least([*phrases, rest] if rest else phrases)
            if held is not None and held[0] == part:
                _, their_id, their_text, theirs = held
                changed = edited(their_text, text)
                new = fingerprint(changed)
                out.append((their_id, len(their_text), hashlib.sha256(changed.encode()).hexdigest(), theirs.tobytes().hex(), new.tobytes().hex(), likeness(theirs, new), likeness(theirs, own)))
            held = None if past else (part, id_, text, own)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=COLUMNS)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of docs: its fingerprint and that of its edited text (the last half taken from the next document), and how near they and the next document's are."""
    ordered = in_order(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    return in_batches(ordered, compare, SCHEMA).withColumnRenamed("doc_id", key)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column fingerprint, as hexadecimal digits."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: fingerprint(t).tobytes().hex())

    return docs.withColumn("fingerprint", of(F.col(text)))
