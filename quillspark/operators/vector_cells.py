"""Scores of many queries against many vectors, in cells of some rows and some queries: vectors meet in a cell, so no pair of a row and a query carries one.

Rows have a group (a document, a cluster, a source), and a query asks for groups. Rows of a group are dealt to portions of about ROWS, so a large group is many cells;
queries are dealt to portions of about QUERIES. Each portion of rows goes to all portions of queries, once each.

ranked() takes a source of documents whole instead, with their chunks, to portions of questions: places and best chunks are known in the cell, and no pair of a question and a document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and queries of a cell, and scores that are computed at once.
ROWS, QUERIES, AT_ONCE = 2048, 256, 1 << 16
#: Of ranked(): questions of a cell; components of a source's vectors in one (8 bytes each); scores that are computed at once; rows that are handed on at once.
ASKED, COMPONENTS, SCORES, OUT = 512, 1 << 24, 1 << 20, 1 << 15


def components(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(values, there, known): component by vector, 0 where there is none; which there are, if any is missing; which vectors aren't null."""
    whole = vectors.combine_chunks()
    known = whole.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(int)
    flat = whole.flatten().cast(pa.float64())
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    at = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values, there = np.zeros((width, len(sizes))), np.zeros((width, len(sizes)), bool)
    values[place, at] = np.where(missing, 0.0, flat.to_numpy(zero_copy_only=False))
    there[place, at] = ~missing
    return values, None if there.all() else there, known


def lengths(values: np.ndarray) -> np.ndarray:
    total = np.zeros(values.shape[1])
    for component in values:
        total += component * component
    return np.sqrt(total)


def products(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Inner products of vectors i of a and j of b, added up in the order of the components."""
    total = np.zeros(len(i))
    for d in range(min(len(a[0]), len(b[0]))):
        product = a[0][d][i] * b[0][d][j]
        for there, at in ((a[1], i), (b[1], j)):
            product = product if there is None else np.where(there[d][at], product, 0.0)
        total += product
    return total


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Halves of the written decimals away from zero, as SQL rounds."""
    scale, finite = 10.0**digits, np.isfinite(values)
    size = np.abs(np.where(finite, values, 0.0)) * scale
    found = np.copysign(np.floor(size + 0.5) / scale, values) + 0.0  # no negative zero
    close = np.flatnonzero(finite & (np.abs(size - np.floor(size) - 0.5) < 1e-6))
    found[close] = [float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in values[close]]
    return np.where(finite, found + 0.0, values)


def parts_of(rows: DataFrame, group: str) -> DataFrame:
    """Groups of more than ROWS rows with their number of portions: at most one of ROWS rows of the table."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > ROWS)
    return sizes.select(F.col(group).alias("large_group"), F.ceil(F.col("n_rows") / ROWS).cast("int").alias("parts"))


def scored(rows: DataFrame, vector: str, group: str, key: str, queries: DataFrame, query: str, query_vector: str, pairs: DataFrame, digits: int, k: int | None = None, unit: bool = False) -> DataFrame:
    """query, the columns of rows without the vector, and score: the cosine (unit: the inner product) of each query and the rows of the groups that it asks for.

    rows: group, key, vector, ...; queries: query (each once), query_vector; pairs: query, group. With k, the k best of each pair at least (ties to the smaller key) and none without a score:
    all rows of a small group's pairs are ranked together, those of a large one by portions. Sums are those of a plain scan, in its order.
    """
    n_rows, n_queries = rows.count(), queries.count()
    buckets, portions = max(1, -(-n_rows // ROWS)), max(1, -(-n_queries // QUERIES))
    large = F.broadcast(parts_of(rows, group))
    parts = F.coalesce("parts", F.lit(1))
    bucket = F.pmod(F.xxhash64(group, "cell_part"), F.lit(buckets)).cast("int").alias("cell_bucket")
    portion = F.pmod(F.xxhash64(query), F.lit(portions)).cast("int").alias("cell_portion")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda table: table.join(large, F.col(group) == F.col("large_group"), "left")
    left = dealt(rows.filter(F.col(group).isNotNull())).withColumn("cell_part", F.pmod(F.xxhash64(key), parts).cast("int"))
    left = left.select(*rows.columns, "cell_part", bucket, every(portions, "cell_portion"))
    asked = dealt(pairs.select(query, group)).withColumn("cell_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    asked = asked.select(query, group, "cell_part", F.lit(None).cast(queries.schema[query_vector].dataType).alias(query_vector), bucket, portion)
    vectors = queries.select(query, F.lit(None).cast(rows.schema[group].dataType).alias(group), F.lit(None).cast("int").alias("cell_part"), query_vector, every(buckets, "cell_bucket"), portion)
    names = [c for c in rows.columns if c != vector]
    schema = T.StructType([queries.schema[query], *[rows.schema[c] for c in names]]).add("score", "double")

    def cell(mine: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(found(mine, right))
        return pa.concat_tables(parts) if parts else pa.table({f: [] for f in [query, *names, "score"]}, schema=target(mine, right))

    def target(mine: pa.Table, right: pa.Table) -> pa.Schema:
        return pa.schema([right.schema.field(query), *[mine.schema.field(c) for c in names], pa.field("score", pa.float64())])

    def found(mine: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        here = right.column("cell_part").is_valid()
        wanted, own = right.filter(here), right.filter(pc.invert(here))
        if not (mine.num_rows and wanted.num_rows and own.num_rows):
            return
        mine = mine.take(pc.sort_indices(mine, [(c, "ascending") for c in (group, "cell_part", key)], null_placement="at_start"))
        groups = mine.select([group, "cell_part"]).append_column("row", pa.array(np.arange(mine.num_rows))).group_by([group, "cell_part"]).aggregate([("row", "min"), ("row", "count")])
        wanted = wanted.select([query, group, "cell_part"]).append_column("query_row", pc.index_in(wanted.column(query), value_set=own.column(query).combine_chunks())).join(groups, [group, "cell_part"], join_type="inner")
        first, sizes, of = (wanted.column(c).to_numpy().astype(int) for c in ("row_min", "row_count", "query_row"))
        a, b = components(mine.column(vector)), components(own.column(query_vector))
        length = None if unit else (lengths(a[0]), lengths(b[0]))
        plain, ask = mine.select(names), own.column(query)
        upto = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] - sizes[start] + AT_ONCE, "right")))
            pair = np.repeat(np.arange(start, end), sizes[start:end])
            row = np.arange(len(pair)) - (upto[pair] - sizes[pair] - (upto[start] - sizes[start])) + first[pair]
            asker = of[pair]
            score, known = products(a, row, b, asker), a[2][row] & b[2][asker]
            if length is not None:
                size = length[0][row] * length[1][asker]
                known &= ~(size <= 0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = score / size
            score = rounded(score, digits)
            if k is not None:
                kept = np.flatnonzero(known)
                order = kept[np.lexsort((row[kept], np.where(np.isnan(score[kept]), -np.inf, -score[kept]), pair[kept]))]
                sorted_pair = pair[order]
                order = order[np.arange(len(order)) - np.searchsorted(sorted_pair, sorted_pair) < k]
                row, asker, score, known = row[order], asker[order], score[order], known[order]
            out = plain.take(pa.array(row))
            yield pa.Table.from_arrays([ask.take(pa.array(asker)), *out.columns, pa.array(score, mask=~known)], schema=target(mine, right))
            start = end

    n = min(buckets * portions, 4096)
    cells = ["cell_bucket", "cell_portion"]  # a fixed number of tasks: few bytes in a cell are much work
    own = lambda table: table.select(*[F.col(c).alias(c) for c in table.columns]).repartition(n, *cells)  # noqa: E731  # columns of its own: both sides may come of one table
    mine, right = own(left), own(asked.unionByName(vectors))
    return mine.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(cell, schema)


def scores_of(rows: tuple, row_lengths: np.ndarray, asked: tuple, asked_lengths: np.ndarray, digits: int) -> np.ndarray:
    """Cosines of each asked vector (a row) and all rows (columns), NaN too where there is none. They are products of matrices; where the order of adding could change a rounded digit, they are added up as a scan does."""
    width = min(len(rows[0]), len(asked[0]))
    size = row_lengths[None, :] * asked_lengths[:, None]
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        plain = (asked[0][:width].T @ rows[0][:width]) / size
        part = np.abs(plain) * 10.0**digits
        unsure = ~(np.abs(part - np.floor(part) - 0.5) > 1e-5) | ~((size > 1e-200) & (size < 1e200))
        j, i = np.nonzero(unsure)
        if len(i):
            plain[j, i] = products(rows, i, asked, j) / size[j, i]
    return rounded(plain.ravel(), digits).reshape(plain.shape)


def whole_sources(documents: DataFrame, chunks: DataFrame | None, source: str, vector: str, chunk_vector: str) -> DataFrame:
    """Sources with whether their vectors, and those of their documents' chunks, have more than COMPONENTS: source, large."""
    sizes = documents.select(source, F.coalesce(F.size(vector), F.lit(0)).alias("n"))
    if chunks is not None:
        sizes = sizes.unionByName(chunks.select(source, F.coalesce(F.size(chunk_vector), F.lit(0)).alias("n")))
    return sizes.filter(F.col(source).isNotNull()).groupBy(source).agg((F.sum(F.greatest("n", F.lit(1))) > COMPONENTS).alias("large"))


def ranked(documents: DataFrame, vector: str, source: str, key: str, questions: DataFrame, question: str, question_vector: str, digits: int, chunks: DataFrame | None = None, chunk_key: str = "chunk_id", chunk_vector: str = "embedding", n: int = 0) -> DataFrame:
    """Each question's documents of the sources that it asks for: question, the columns of documents without the vector, similarity, document_index (from 1, best first, ties by key, without a vector last), and best.

    best: the n best of the document's chunks (chunk_key, score), ties to the smaller key, none without a score. questions: question, source, question_vector; chunks: source, key, chunk_key, chunk_vector.
    A source's vectors are in one task for ASKED questions at a time, so a source is to have COMPONENTS at most.
    """
    n_questions = questions.select(question).distinct().count()
    portions = max(1, -(-n_questions // ASKED))
    portion = F.pmod(F.xxhash64(question), F.lit(portions)).cast("int").alias("cell_portion")
    every = F.explode(F.sequence(F.lit(0), F.lit(portions - 1))).alias("cell_portion")
    names = [c for c in documents.columns if c != vector]
    nothing = lambda table, c: F.lit(None).cast(table.schema[c].dataType).alias(c)
    floats = lambda x: F.col(x).cast("array<double>").alias("cell_vector") if any(t.schema[c].dataType != T.ArrayType(T.FloatType()) for t, c in vectors) else F.col(x).alias("cell_vector")
    vectors = [(documents, vector), (questions, question_vector)] + ([] if chunks is None else [(chunks, chunk_vector)])
    of_chunk = T.LongType() if chunks is None else chunks.schema[chunk_key].dataType
    no_chunk, no_question = F.lit(None).cast(of_chunk).alias("cell_chunk"), F.lit(None).cast(questions.schema[question].dataType).alias("cell_question")
    rows = documents.filter(F.col(source).isNotNull()).select(F.lit(0).alias("cell_kind"), *names, no_chunk, no_question, floats(vector), every)
    if chunks is not None:
        carried = [c if c in (source, key) else nothing(documents, c) for c in names]
        rows = rows.unionByName(chunks.filter(F.col(source).isNotNull() & F.col(chunk_vector).isNotNull()).select(F.lit(1).alias("cell_kind"), *carried, F.col(chunk_key).alias("cell_chunk"), no_question, floats(chunk_vector), every))
    asked = questions.filter(F.col(source).isNotNull()).dropDuplicates([question, source])
    rows = rows.unionByName(asked.select(F.lit(2).alias("cell_kind"), *[F.col(c) if c == source else nothing(documents, c) for c in names], no_chunk, F.col(question).alias("cell_question"), floats(question_vector), portion))
    best = T.ArrayType(T.StructType().add(chunk_key, of_chunk).add("score", "double"))
    schema = T.StructType([T.StructField(question, questions.schema[question].dataType), *[documents.schema[c] for c in names]]).add("similarity", "double").add("document_index", "long").add("best", best)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        docs, parts, questions = (whole.filter(pc.equal(whole.column("cell_kind"), kind)) for kind in range(3))
        if not (docs.num_rows and questions.num_rows):
            return
        docs = docs.take(pc.sort_indices(docs, [(key, "ascending")], null_placement="at_start"))
        plain = docs.select(names).combine_chunks()
        sides = [components(t.column("cell_vector")) for t in (docs, parts, questions)]
        sizes = [lengths(x[0]) for x in sides]
        # chunks by the place of their document, then by their key; a document that occurs twice has them twice
        owner = parts.select([key, "cell_chunk"]).append_column("part", pa.array(np.arange(parts.num_rows))).join(docs.select([key]).append_column("doc", pa.array(np.arange(docs.num_rows))), key, join_type="inner")
        owner = owner.take(pc.sort_indices(owner, [("doc", "ascending"), ("cell_chunk", "ascending")], null_placement="at_start"))
        part, doc = (owner.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(int) for c in ("part", "doc"))
        keep = sides[1][2][part]
        part, doc, chunk_ids = part[keep], doc[keep], owner.column("cell_chunk").combine_chunks().filter(pa.array(keep))
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
        mine = (sides[1][0][:, part], None if sides[1][1] is None else sides[1][1][:, part])
        runs = np.diff(np.r_[starts, len(doc)])
        types = pa.schema([pa.field(question, questions.schema.field("cell_question").type), *[plain.schema.field(c) for c in names], pa.field("similarity", pa.float64()), pa.field("document_index", pa.int64()), pa.field("best", pa.list_(pa.struct([pa.field(chunk_key, chunk_ids.type), pa.field("score", pa.float64())])))])
        step = max(1, SCORES // max(docs.num_rows, len(doc), 1))
        for start in range(0, questions.num_rows, step):
            at = slice(start, start + step)
            asks = (sides[2][0][:, at], None if sides[2][1] is None else sides[2][1][:, at])
            similar = scores_of(sides[0], sizes[0], asks, sizes[2][at], digits)
            scores = scores_of(mine, sizes[1][part], asks, sizes[2][at], digits) if n and len(doc) else None
            for j in range(len(similar)):
                size = sizes[2][start + j]
                there = sides[0][2] & sides[2][2][start + j] & ~(sizes[0] * size <= 0)
                order = np.argsort(np.where(there, np.where(np.isnan(similar[j]), -np.inf, -similar[j]), np.inf), kind="stable")
                taken, of, upto = np.zeros(0, int), np.zeros(0), np.zeros(docs.num_rows + 1, int)
                if scores is not None and sides[2][2][start + j]:
                    taken, upto = best_of(np.where(sizes[1][part] * size <= 0, -np.inf, scores[j]), starts, runs, doc, docs.num_rows, n)
                    of = scores[j][taken]
                for first in range(0, len(order), OUT):
                    some = order[first : first + OUT]
                    counts = upto[some + 1] - upto[some]
                    ends = np.cumsum(counts)
                    chosen = np.repeat(upto[some] - ends + counts, counts) + np.arange(ends[-1])
                    listed = pa.StructArray.from_arrays([chunk_ids.take(pa.array(taken[chosen])), pa.array(of[chosen])], names=[chunk_key, "score"])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), listed)
                    out = plain.take(pa.array(some)).combine_chunks()
                    said = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out.columns]
                    ask = questions.column("cell_question").take(pa.array(np.full(len(some), start + j))).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ask, *said, pa.array(similar[j][some], mask=~there[some]), pa.array(first + 1 + np.arange(len(some))), lists], schema=types)

    n_tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(portions * 8, 4096))
    dealt = rows.select(*[F.col(c).alias(c) for c in rows.columns]).withColumn("cell_source", F.col(source)).repartition(n_tasks, "cell_portion", "cell_source")
    return dealt.groupBy("cell_portion", "cell_source").applyInArrow(cell, schema)


def best_of(scores: np.ndarray, starts: np.ndarray, runs: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(taken, upto): the places of the n best scores of each run, best first and of equal ones the first, NaN before all, minus infinity never; document d has taken[upto[d]:upto[d + 1]]."""
    left = np.where(np.isnan(scores), np.inf, scores)
    found = []
    for _ in range(min(n, int(runs.max(initial=0)))):
        top = np.maximum.reduceat(left, starts)
        hits = np.flatnonzero(left == np.repeat(top, runs))
        place = hits[np.searchsorted(hits, starts)]
        found.append(place[top > -np.inf])
        left[place] = -np.inf
    taken = np.concatenate(found)
    turns = np.repeat(np.arange(len(found)), [len(x) for x in found])
    taken = taken[np.lexsort((turns, doc[taken]))]
    return taken, np.searchsorted(doc[taken], np.arange(n_docs + 1))
