"""Exact top-k search by MaxScore over blocks of integer vectors.

The rows are dealt to blocks of about BLOCK rows. A block is an index of its own: a posting list for each component (term) and the term's
largest and smallest value, which bound what the term can add to any score. Every block meets all queries, in portions that stream by.
For each query its terms are ordered by bound. Terms whose bounds together stay below the current k-th score are not essential: a row that
has none of the others can't enter the result. The essential terms' postings are traversed and added up; then the other terms are probed in
order of their bounds, only for rows that can still reach the k-th score, which partial sums raise by no more than is sure: terms still to come can
lower them. Each block gives its k best rows for a query, and those are merged.

Defined results: a component x counts as floor(scale * x), limited to +-2^62, and vectors may have different lengths (missing components are 0);
vectors that are null, or hold null or non-finite components, take no part. A row isn't compared with itself, but rows that share an id are
different rows. A null id makes no query; as a candidate it comes after all others in ties. A score beyond 64 bits is the nearest 64-bit number.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.arrow import in_batches
from quillspark.sources.scratch import written

BLOCK = 8192
#: Rows whose scores are computed first, to have a k-th score to compare bounds with; terms probed at once.
FIRST_ROWS, PROBED = 128, 8
LIMIT = 1 << 62
NO_ID = (1 << 63) - 1


def quantised(vector: Column, scale: float) -> Column:
    """The vector's integer components; null if it takes no part."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    whole = ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    floor = F.transform(numbers, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    return F.when(F.coalesce(whole, F.lit(False)), floor)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition to blocks: ids, which rows are queries, and the matrix in the narrowest integers that hold it."""
    from itertools import count

    number, held, rows = count(TaskContext.get().partitionId() << 32), [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 2 * BLOCK:
            yield packed(next(number), pa.Table.from_batches(held))
            held, rows = [], 0
    if held:
        yield packed(next(number), pa.Table.from_batches(held))


def packed(number: int, table: pa.Table) -> pa.RecordBatch:
    lists = table.column("vector").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    matrix = np.zeros((len(sizes), width), np.int64)
    matrix[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.abs(matrix).max(initial=0) <= np.iinfo(t).max)
    ids = table.column("id").fill_null(NO_ID).to_numpy()
    queries = table.column("is_query").to_numpy()
    row = [[number], [len(sizes)], [width], [np.dtype(kind).str], [ids.tobytes()], [np.flatnonzero(queries).astype(np.int32).tobytes()], [matrix.astype(kind).tobytes()]]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=["block", "n", "width", "kind", "ids", "queries", "matrix"])


PACKED = "block long, n int, width int, kind string, ids binary, queries binary, matrix binary"


class Index:
    """Postings of one block, by term, with their bounds."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray) -> None:
        self.postings, self.ids = np.ascontiguousarray(matrix.T), ids
        self.high, self.low = (f(matrix.astype(object if matrix.dtype == object else np.int64), 0) if matrix.size else np.zeros(matrix.shape[1], np.int64) for f in (lambda m, a: m.max(a), lambda m, a: m.min(a)))
        # a term that every row has adds to any score; its postings are the whole column
        self.dense = (self.postings != 0).mean(1) > 0.5 if matrix.size else np.zeros(0, bool)
        self.as_type: dict[type, np.ndarray] = {}

    def columns(self, kind: type) -> np.ndarray:
        if kind not in self.as_type:
            self.as_type[kind] = self.postings.astype(kind)
        return self.as_type[kind]

    def best(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best rows, ties by id; own: the query's own row, or -1."""
        width = min(len(query), len(self.postings))
        q = query[:width].astype(object)
        ends = [q * x[:width].astype(object) for x in (self.high, self.low)] if width else [np.zeros(0, object)] * 2
        total = sum(abs(int(x)) * max(abs(int(h)), abs(int(lo))) for x, h, lo in zip(q, self.high, self.low))
        kind = np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else object
        postings, q = self.columns(kind)[:width], q.astype(kind)
        bound, loss = np.maximum(np.maximum(*ends), 0).astype(kind), np.minimum(np.minimum(*ends), 0).astype(kind)  # a row without the term adds nothing
        order = np.argsort(-bound, kind="stable")
        order = order[q[order] != 0]
        rest, lost = (np.append(np.cumsum(x[order][::-1])[::-1], 0) for x in (bound, loss))  # the most and the least that the terms from here on can add
        n = len(self.ids)
        rows = np.arange(n)
        if own >= 0:
            rows = np.delete(rows, own)
        least = self.kth(q @ postings[:, rows[:FIRST_ROWS]], k) if width else 0
        essential = int(np.count_nonzero(rest[:-1] >= least)) if least is not None and least > 0 else len(order)
        terms = order[:essential]
        sums = q[terms] @ postings[terms] if essential else np.zeros(n, kind)
        if not self.dense[terms].any():  # rows without an essential term can't reach the k-th score
            rows = rows[(postings[terms][:, rows] != 0).any(0)] if least is not None and least > 0 else rows
        sums = sums[rows]
        for at in range(essential, len(order), PROBED):
            stay = sums + rest[at] >= least
            rows, sums = rows[stay], sums[stay]
            probed = order[at : at + PROBED]
            sums = sums + q[probed] @ postings[np.ix_(probed, rows)]
            kth = self.kth(sums, k)
            least = least if kth is None else max(least, kth + lost[min(at + PROBED, len(order))])
        if len(rows) > k:
            edge = np.partition(sums, len(sums) - k)[len(sums) - k]
            rows, sums = rows[sums >= edge], sums[sums >= edge]
        top = np.lexsort((self.ids[rows], -sums))[:k] if kind is not object else np.array(sorted(range(len(rows)), key=lambda i: (-sums[i], self.ids[rows[i]]))[:k], int)
        return rows[top], sums[top]

    @staticmethod
    def kth(scores: np.ndarray, k: int):
        return None if len(scores) < k else np.partition(scores, len(scores) - k)[len(scores) - k]


def matrix_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["matrix"], row["kind"]).reshape(row["n"], row["width"])


def search(k: int):
    """A block, then all portions of queries, to the block's best rows for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if not row["is_portion"]:
                    index, block = Index(matrix_of(row), np.frombuffer(row["ids"], np.int64)), row["block"]
                    continue
                out: list[list] = [[], [], [], []]
                vectors, ids, at = matrix_of(row), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["queries"], np.int32)
                for vector, query_id, own in zip(vectors, ids, at.tolist()):
                    rows, scores = index.best(vector, k, own if row["portion"] == block else -1)
                    out[0] += [own] * len(rows)
                    out[1] += [int(query_id)] * len(rows)
                    out[2] += index.ids[rows].tolist()
                    out[3] += [max(min(int(s), (1 << 63) - 1), -(1 << 63)) for s in scores.tolist()]
                vec_ids = pa.array([None if x == NO_ID else x for x in out[2]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([row["portion"]] * len(out[0]), pa.int64()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), vec_ids, pa.array(out[3], pa.int64())], names=["portion", "own", "query_id", "vec_id", "score"])

    return run


def only_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to the portions of their query rows."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            at = np.frombuffer(row["queries"], np.int32)
            if len(at):
                row |= {"n": len(at), "ids": np.frombuffer(row["ids"], np.int64)[at].tobytes(), "matrix": matrix_of(row)[at].tobytes()}
                out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row that is a query the k rows with the largest inner products, ties to the smaller id."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), quantised(F.col(vector), scale).alias("vector")).filter("vector is not null")
    blocks = max(1, -(-vectors.count() // BLOCK))
    packed_blocks = written(in_batches(rows.repartition(blocks), pack, PACKED), "topk-blocks")
    portions = written(in_batches(packed_blocks, only_queries, PACKED), "topk-portions").withColumnRenamed("block", "portion")
    numbers = [r.block for r in packed_blocks.select("block").collect()]  # one for BLOCK rows
    if not numbers:
        numbers = [0]
    every = portions.withColumn("block", F.explode(F.lit(numbers))).withColumn("is_portion", F.lit(True))
    both = packed_blocks.withColumn("is_portion", F.lit(False)).unionByName(every, allowMissingColumns=True)
    dealt = both.repartition(len(numbers), "block").sortWithinPartitions("block", "is_portion")
    found = in_batches(dealt, search(k), "portion long, own int, query_id long, vec_id long, score long")
    best = Window.partitionBy("portion", "own").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scores)
WHERE rank <= 20
"""
