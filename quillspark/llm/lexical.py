"""Ranked lexical search: the best documents of each query item by weighted term frequencies, by Fagin's threshold algorithm.

1. The items are taken in portions whose text is bounded, so the terms of a portion can go to every task. One pass over the documents counts their terms and
   writes a forward index: for each document the portion's terms it has, with their frequencies.
2. The index gives the corpus's counts: documents, terms, and the documents of each term. They fix every term's weight and every posting's impact.
3. Tasks read the index in blocks. A block has an impact-sorted list for each term. For each item the lists are read round robin, a few entries at a time;
   every new document's whole score comes from random lookups in the forward index. What the lists' last entries add up to is a bound for all documents not
   met yet: when it falls strictly below the k-th score (so far, of the task's earlier blocks too), no other document can enter the result, equal scores included.
4. Each task gives its k best documents for an item, and those are merged.

Weights, impacts and scores are 64-bit integers, so sums in any order are equal and the results exact.

Defined results: null texts have no terms, and documents without terms are not counted; an item without terms that documents have gets no rows; rows that share
an id are different documents (or items); null ids come after all others in ties; an empty table gives an empty result. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.arrow import in_batches
from quillspark.llm.terms import lowered, spans
from quillspark.llm.text import content, pieces
from quillspark.sources.scratch import written

#: Text of the items of a portion, about; postings of a block; entries of a list read in the first round (each round reads twice as many).
PORTION_BYTES, BLOCK, FIRST = 8 << 20, 1 << 21, 16
PIECE = 2 << 20
#: Of the weight of a document's length, in hundredths.
LENGTH = 75
# Digits, A-Z, a-z, and every byte of a code point beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in a row, and the text each is in."""
    data, offsets = content(column)
    inside = _TERM[data]
    starts, ends, of = spans(inside, offsets)
    return lowered(data, inside, starts, ends), of


def counted(owner: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) in order, with how often they occur."""
    pairs, n = np.unique(owner * max(width, 1) + code, return_counts=True)
    return pairs // max(width, 1), pairs % max(width, 1), n


@dataclass
class Queries:
    """A portion of items: item i has terms codes[edges[i]:edges[i + 1]], each counts[...] times."""

    ids: list[int | None]
    vocabulary: pa.Array
    edges: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None]) -> Queries:
        terms, of = terms_of(pa.array(texts, pa.string()))
        encoded = terms.dictionary_encode()
        item, code, n = counted(of, encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary))
        return cls(ids, encoded.dictionary, np.searchsorted(item, np.arange(len(ids) + 1)), code, n.astype(np.int64))


def index_documents(shared):
    """Texts to the number of their terms, and the terms of the vocabulary they have, in order, with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                terms, of = terms_of(piece.column("text"))
                found = pc.index_in(terms, value_set=vocabulary)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                doc, code, n = counted(of[known], found.drop_null().to_numpy().astype(np.int64), len(vocabulary))
                offsets = pa.array(np.searchsorted(doc, np.arange(piece.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (code, n)]
                size = pa.array(np.bincount(of, minlength=piece.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("id"), size, *lists], names=["id", "n", "terms", "tfs"])

    return run


@dataclass
class Best:
    """The best documents of an item so far."""

    scores: np.ndarray
    ids: np.ndarray
    unknown: np.ndarray  # which ids are null

    def kth(self, k: int) -> int:
        return int(self.scores[k - 1]) if len(self.scores) >= k else 0

    def joined(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray, k: int) -> Best:
        mine = scores > 0
        scores, ids, unknown = (np.concatenate([a, b[mine]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.unknown, unknown)))
        order = np.lexsort((ids, unknown, -scores))[:k]
        return Best(scores[order], ids[order], unknown[order])

    @classmethod
    def none(cls) -> Best:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


class Block:
    """Postings of some documents: by document for lookups, by term and falling impact for sorted access."""

    def __init__(self, ids: np.ndarray, unknown: np.ndarray, doc: np.ndarray, code: np.ndarray, impact: np.ndarray, width: int) -> None:
        self.ids, self.unknown, self.width = ids, unknown, width
        self.keys, self.impact = doc * width + code, impact
        order = np.lexsort((-impact, code))
        self.listed, self.heights = doc[order], impact[order]
        self.edges = np.searchsorted(code[order], np.arange(width + 1))
        self.read = 0  # entries that sorted access has taken

    def scores(self, docs: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of docs."""
        wanted = docs[:, None] * self.width + codes
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.impact[at], 0) @ weights

    def search(self, codes: np.ndarray, weights: np.ndarray, k: int, best: Best) -> Best:
        """best, with what this block adds to it."""
        here = (self.edges[codes + 1] > self.edges[codes]) & (weights > 0)
        codes, weights = codes[here], weights[here]
        low, high = self.edges[codes], self.edges[codes + 1]
        seen = np.zeros(len(self.ids), bool)
        depth, step = 0, FIRST
        while len(codes):
            going = low + depth < high
            bound = int(self.heights[low[going] + depth] @ weights[going])  # the next entries; of a list read to its end nothing is left
            if not going.any() or bound < best.kth(k):
                break
            met = np.unique(np.concatenate([self.listed[a + depth : min(a + depth + step, b)] for a, b in zip(low[going].tolist(), high[going].tolist())]))
            self.read += int(np.minimum(step, (high - low - depth)[going]).sum())
            met = met[~seen[met]]
            seen[met] = True
            if len(met):
                best = best.joined(self.scores(met, codes, weights), self.ids[met], self.unknown[met], k)
            depth, step = depth + step, step * 2
        return best


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    """The index's rows in blocks of about BLOCK postings."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("terms").flatten())
        if size >= BLOCK:
            yield block_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)
            held, size = [], 0
    if held:
        yield block_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)


def block_of(rows: pa.RecordBatch, width: int) -> Block:
    numbers = lambda c: rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(rows.num_rows), rows.column("terms").value_lengths().to_numpy(zero_copy_only=False))
    tf, m = numbers("tfs"), rows.column("m").to_numpy(zero_copy_only=False).astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    return Block(pc.fill_null(rows.column("id"), 0).to_numpy(), rows.column("id").is_null().to_numpy(zero_copy_only=False), doc, numbers("terms"), impact, width)


def search_blocks(shared, weights: np.ndarray, k: int):
    """The index's rows to the task's best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        n = len(queries.ids)
        best = [Best.none() for _ in range(n)]
        for block in blocks(batches, len(weights)):
            for i in range(n):
                part = slice(queries.edges[i], queries.edges[i + 1])
                codes = queries.codes[part]
                best[i] = block.search(codes, queries.counts[part] * weights[codes], k, best[i])
        sizes = [len(b.scores) for b in best]
        if sum(sizes):
            item = np.repeat(np.arange(n), sizes)
            ids, unknown, scores = (np.concatenate([getattr(b, c) for b in best]) for c in ("ids", "unknown", "scores"))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, mask=unknown), pa.array(scores)], names=["item", "doc_id", "score"])

    return run


def search_portion(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """item_id, rank, doc_id and score of the items (rows of id and text); None if they have no result."""
    session = docs.sparkSession
    queries = Queries.of([r.id for r in items], [r.text for r in items])
    if not len(queries.vocabulary):
        return None
    shared = session.sparkContext.broadcast(queries)
    index = written(in_batches(docs, index_documents(shared), "id long, n long, terms array<int>, tfs array<int>").filter("n > 0"), "lexical-index")
    whole = index.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    if not whole.n:
        return None
    frequency = np.zeros(len(queries.vocabulary), np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the portion
        frequency[row.term] = row["count"]
    weights = np.array([floor(1000 * log((2 * whole.n + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    length = F.expr(f"{100 - LENGTH} + (cast(n as decimal(38,0)) * {LENGTH * whole.n}) div {whole.terms}")  # the product can pass 64 bits
    measured = index.filter(F.size("terms") > 0).select("id", length.alias("m"), "terms", "tfs")
    found = in_batches(measured, search_blocks(shared, weights, k), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = session.createDataFrame([(i, d) for i, d in enumerate(queries.ids)], "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, equal scores by the smaller id."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("text is not null")
    items = items.select(F.col(item_key).cast("long").alias("id"), F.col(text).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PORTION_BYTES))
    found = None
    for part in range(parts):
        rows = (items if parts == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)).collect()  # about PORTION_BYTES
        one = search_portion(docs, rows, k)
        if one is not None:
            found = one if found is None else found.unionByName(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
WITH counted AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents)
  GROUP BY doc_id, term),
sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term, docs),
asked AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
