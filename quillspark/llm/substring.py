"""Removal of word passages that an earlier document also has.

A window is `window` consecutive words of one document. It is removed if its word sequence also starts in a document
with a smaller id; removed windows of a document merge into maximal intervals.

1. Tasks hash every window of their texts (Rabin-Karp) and settle what they can see: of equal windows in one piece of text all but
   those of the smallest id go, and only that smallest one is sent on. A window that a third of all documents share thus costs one
   entry a piece, not one a document.
2. The entries are dealt to shards by a second, independent hash and packed by shard: 8 bytes of hash and about 2 of document
   for each window. A shard finds the smallest id of each hash, and answers the others.
3. The answers meet the texts again by document, and the tasks remove what is covered.

Equal windows are told by 64 bits of hash and the shard's number, which grows with the data; texts are not compared again.

Defined results: a null or empty text has no words; a null id is larger than every other one; documents that share
an id don't remove from each other; an empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.arrow import in_batches, numbered, renamed
from quillspark.llm.text import SECOND_BASE, binaries, content, pieces, window_hashes, window_starts, word_hashes, word_spans

#: Text of one shard on average.
SHARD_BYTES = 12 << 20
LAST = (1 << 63) - 1
ENTRIES = "shard int, hashes binary, ids binary, counts binary"
ANSWERS = "bucket int, hashes binary, ids binary, counts binary"


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct neighbours and how often each follows itself."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(np.concatenate([first, [len(ids)]])).astype(np.uint32)


def packed(name: str, to: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """One row for each value of to: its hashes, and their ids as runs."""
    order = np.lexsort((ids, to))
    to, hashes, ids = to[order], hashes[order], ids[order]
    rows, sizes = runs(to)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (to[1:] != to[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(ids)]])).astype(np.uint32)
    run_edges = np.searchsorted(at, edges)
    return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), binaries(hashes, edges), binaries(ids[at], run_edges), binaries(counts, run_edges)], names=[name, "hashes", "ids", "counts"])


def unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ids of packed rows."""
    hashes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for h, i, c in zip(table.column("hashes"), table.column("ids"), table.column("counts")):
        hashes.append(np.frombuffer(h.as_buffer(), np.uint64))
        ids.append(np.repeat(np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.uint32)))
    return np.concatenate(hashes), np.concatenate(ids)


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Shifts and exclusive ors only, so that bucket_column gives the same in the JVM."""
    x = ids.view(np.uint64)
    x = x ^ (x << np.uint64(13))
    x = x ^ (x >> np.uint64(7))
    x = x ^ (x << np.uint64(17))
    return ((x & np.uint64(LAST)) % np.uint64(n)).astype(np.int64)


def bucket_column(x: Column, n: int) -> Column:
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    x = x.bitwiseXOR(F.shiftleft(x, 17))
    return (x.bitwiseAND(F.lit(LAST)) % n).cast("int")


def beaten(hashes: np.ndarray, ids: np.ndarray, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal hash with a smaller id; and one entry of the smallest id for each hash."""
    order = np.lexsort((ids, hashes)) if tie is None else np.lexsort((ids, tie, hashes))
    h, i = hashes[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if tie is not None:
        new[1:] |= tie[order][1:] != tie[order][:-1]
    least = i[new][np.cumsum(new) - 1] if len(i) else i
    return order[i > least], order[new]


def find_windows(window: int, shards: int, buckets: int):
    """Texts to packed entries (shard >= 0) and to answers that a piece settles itself (shard -1 - bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = content(piece.column("text"))
                starts, ends, of = word_spans(data, offsets)
                at = window_starts(of, window)
                if not len(at):
                    continue
                words = word_hashes(data, starts, ends)
                hashes, second = window_hashes(words, at, window), window_hashes(words, at, window, SECOND_BASE)
                ids = piece.column("id").to_numpy(zero_copy_only=False)[of[at]]
                gone, first = beaten(hashes, ids, second)
                to = (second[first] % np.uint64(shards)).astype(np.int64)
                yield packed("shard", to, hashes[first], ids[first])
                if len(gone):
                    yield packed("shard", -1 - bucket_of(ids[gone], buckets), hashes[gone], ids[gone])

    return run


def answer(buckets: int):
    """A shard's entries to packed answers: every entry whose hash has a smaller id, by the bucket of its document. What a piece has settled is an answer already."""

    def run(table: pa.Table) -> pa.Table:
        hashes, ids = unpacked(table)
        gone = np.arange(len(ids)) if table.column("shard")[0].as_py() < 0 else beaten(hashes, ids)[0]
        return pa.Table.from_batches([packed("bucket", bucket_of(ids[gone], buckets), hashes[gone], ids[gone])])

    return run


def kept_text(words: list[bytes], gone: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray, layout: bool) -> str:
    """The words that stay: joined by one space, or with the white space of the text where neighbours stay."""
    if not layout:
        return b" ".join(compress(words, (~gone).tolist())).decode()
    if not gone.any():
        return data.decode()
    stay = np.flatnonzero(~gone)
    breaks = np.flatnonzero(np.diff(stay) > 1)
    firsts, lasts = stay[np.concatenate([[0], breaks + 1])] if len(stay) else [], stay[np.concatenate([breaks, [len(stay) - 1]])] if len(stay) else []
    return b" ".join(data[starts[a] : ends[b]] for a, b in zip(firsts, lasts)).decode()


def remove(window: int, shards: int, layout: bool, carried: pa.Schema):
    """Answers and texts of a bucket, answers first, to the texts' rows with what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, known = None, [], (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for batch in batches:
            for piece in pieces(batch, "text"):
                is_text = piece.column("is_text").to_numpy(zero_copy_only=False)
                buckets = piece.column("bucket").to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero((buckets[1:] != buckets[:-1]) | (is_text[1:] != is_text[:-1])) + 1).tolist(), len(buckets)]
                for a, b in zip(edges, edges[1:]):
                    part = piece.slice(a, b - a)
                    if buckets[a] != bucket:
                        bucket, waiting, known = buckets[a], [], (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                    if not is_text[a]:
                        waiting.append(unpacked(part))
                        continue
                    if waiting:
                        hashes, ids = (np.concatenate(x) for x in zip(*waiting))
                        order = np.argsort(ids, kind="stable")
                        waiting, known = [], (ids[order], hashes[order])
                    yield cut(part, known)

    def cut(part: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        data, offsets = content(part.column("text"))
        starts, ends, of = word_spans(data, offsets)
        at = window_starts(of, window)
        hashes = window_hashes(word_hashes(data, starts, ends), at, window)
        ids = part.column("id").to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(known[0], ids, "left"), np.searchsorted(known[0], ids, "right")
        edge = np.searchsorted(of[at], np.arange(len(ids) + 1))
        hit = np.zeros(len(at), bool)
        for i in np.flatnonzero(high > low):
            hit[edge[i] : edge[i + 1]] = np.isin(hashes[edge[i] : edge[i + 1]], known[1][low[i] : high[i]])
        change = np.zeros(len(starts) + window + 1, np.int32)
        np.add.at(change, at[hit], 1)
        np.add.at(change, at[hit] + window, -1)
        gone = np.cumsum(change)[: len(starts)] > 0
        word_edge = np.searchsorted(of, np.arange(len(ids) + 1))
        kept, spans, raw = [], [], data.tobytes()
        for i, (a, b) in enumerate(zip(word_edge[:-1].tolist(), word_edge[1:].tolist())):
            text, removed = raw[offsets[i] : offsets[i + 1]], gone[a:b]
            kept.append(kept_text(text.split(), removed, text, starts[a:b] - offsets[i], ends[a:b] - offsets[i], layout))
            turns = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]]))).tolist() if removed.any() else []
            spans.append([{"first": x, "past": y} for x, y in zip(turns[::2], turns[1::2])])
        sums = np.concatenate([[0], np.cumsum(gone)])
        out = [part.column("carried"), np.diff(word_edge), sums[word_edge[1:]] - sums[word_edge[:-1]], kept, spans]
        return pa.RecordBatch.from_arrays([out[0], *(pa.array(x, t) for x, t in zip(out[1:], carried.types))], names=["carried", *carried.names])

    return run


def dedup_passages(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", layout: bool = False) -> DataFrame:
    """Every row of docs without its text column, with n_words, n_removed, kept (the text that stays) and spans (intervals of removed words).

    An added column takes the place of a carried one of the same name.
    """
    plain, names = numbered(docs)
    at = dict(zip(docs.columns, names))
    found = _dedup(plain, window, at[key], at[text], layout)
    kept = [c for c in docs.columns if c != text]
    return renamed(found.select(*[F.col("carried")[at[c]] for c in kept], "n_words", "n_removed", "kept", "spans"), kept, 4)


def without_passages(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with its text, and its size if there is such a column, without the passages; the white space of what stays is kept. A text without words becomes empty."""
    plain, names = numbered(docs)
    at = dict(zip(docs.columns, names))
    found = _dedup(plain, window, at[key], at[text], layout=True)
    left = F.when(F.col("n_words") > 0, F.col("kept")).otherwise(F.lit(""))
    new = {text: left, size: F.length(left).cast("long")}
    return found.select(*[new[c] if c in new else F.col("carried")[at[c]] for c in docs.columns]).toDF(*docs.columns)


def _dedup(docs: DataFrame, window: int, key: str, text: str, layout: bool) -> DataFrame:
    """carried (the other columns), n_words, n_removed, kept and spans of every row of docs."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    id_ = F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shards, parts)  # of documents; every partition has some
    entries = in_batches(docs.select(id_, F.col(text).alias("text")), find_windows(window, shards, buckets), ENTRIES)
    answers = entries.groupBy("shard").applyInArrow(answer(buckets), ANSWERS).withColumn("is_text", F.lit(False))
    carried = F.struct(*[c for c in docs.columns if c != text]).alias("carried")
    texts = docs.select(id_, F.col(text).alias("text"), carried).withColumn("bucket", bucket_column(F.col("id"), buckets)).withColumn("is_text", F.lit(True))
    both = texts.unionByName(answers, allowMissingColumns=True)
    dealt = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "is_text")
    out = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))])
    spans = T.ArrayType(T.StructType().add("first", "integer").add("past", "integer"))
    schema = T.StructType([texts.schema["carried"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string").add("spans", spans)
    return in_batches(dealt, remove(window, shards, layout, out), schema)


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM texts)),
firsts AS (
  SELECT seq, min(doc_id) AS least FROM windows GROUP BY seq),
gone AS (
  SELECT DISTINCT doc_id, p + i AS q FROM windows JOIN firsts USING (seq), range(13) AS r(i) WHERE doc_id > least),
positions AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM texts),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY q) AS body
  FROM positions ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
