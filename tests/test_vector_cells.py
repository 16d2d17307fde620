import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine
from quillspark.operators import two_stage, vector_cells


def test_rounding_is_that_of_sql(spark):
    rng = random.Random(1)
    values = [0.5, -0.5, 1.0, 0.0, 0.1234565, -0.1234565, 0.0000005, 0.9999995, 2.5e-7, float("nan"), float("inf")] + [rng.randrange(-(10**7), 10**7) / 10**7 for _ in range(2000)] + [rng.uniform(-1, 1) for _ in range(2000)]
    want = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double").orderBy("i").select(F.round("x", 6).alias("x")).collect()]
    assert [repr(x) for x in vector_cells.rounded(np.array(values), 6).tolist()] == [repr(x) for x in want]
    assert want[4] == float(Decimal("0.1234565").quantize(Decimal("1e-6"), ROUND_HALF_UP))


@pytest.mark.parametrize("size", [7, 2048])
def test_cells_against_the_cosine_of_each_pair(spark, monkeypatch, size):
    """Documents of very different sizes, in cells of a few rows; vectors that are null, zero, ragged, with null and NaN components."""
    monkeypatch.setattr(vector_cells, "ROWS", size)
    monkeypatch.setattr(vector_cells, "QUERIES", 3)
    monkeypatch.setattr(vector_cells, "AT_ONCE", 50)
    rng = random.Random(3)
    vector = lambda: rng.choice([None, [0.0] * 4, [1.0, None, 2.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 0.0, 0.0]]) if rng.random() < 0.2 else [float(rng.randrange(-2, 3)) for _ in range(4)]
    rows = [(0 if rng.random() < 0.5 else rng.randrange(9) if rng.random() < 0.95 else None, i, f"t{i}", vector()) for i in range(150)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_id long, note string, embedding array<float>")
    questions = spark.createDataFrame([(f"q{i}", vector()) for i in range(8)], "question_id string, query_embedding array<float>")
    pairs = questions.select("question_id").crossJoin(spark.range(12).select(F.col("id").alias("document_id"))).filter((F.col("document_id") + F.crc32("question_id")) % 5 != 0)
    met = chunks.filter("embedding is not null").join(pairs, "document_id").join(questions, "question_id").withColumn("score", F.round(cosine(F.col("embedding"), F.col("query_embedding")), 6)).filter("score is not null").collect()
    best = {}
    for r in sorted(met, key=lambda r: (0 if math.isnan(r.score) else 1, -r.score if not math.isnan(r.score) else 0, r.chunk_id)):
        own = best.setdefault((r.question_id, r.document_id), [])
        if len(own) < 3:
            own.append((r.chunk_id, r.note, repr(r.score)))
    found = {}
    for r in sorted(two_stage.best_chunks(chunks, questions, pairs, 3).collect(), key=lambda r: r["rank"]):
        found.setdefault((r.question_id, r.document_id), []).append((r.chunk_id, r.note, repr(r.score)))
    assert found == best and max(map(len, best.values())) == 3


def test_no_pair_carries_a_vector(spark):
    """Before, each pair of a question and a document was shuffled with the question's vector."""
    chunks = spark.range(50).select((F.col("id") % 5).alias("document_id"), F.col("id").alias("chunk_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    questions = spark.range(4).select(F.col("id").alias("question_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("query_embedding"))
    pairs = questions.select("question_id").crossJoin(spark.range(5).select(F.col("id").alias("document_id")))
    plan = two_stage.best_chunks(chunks, questions, pairs, 2)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "CoGroup" in plan and all("large_group" in line or "Cross" in line for line in joins)


def test_documents_without_a_vector_come_last(spark):
    documents = spark.createDataFrame([(1, "s", None), (2, "s", [1.0, 0.0]), (3, "s", [0.0, 1.0]), (4, "t", [1.0, 0.0]), (5, None, [1.0, 0.0])], "document_id long, data_source string, summary_embedding array<double>")
    questions = spark.createDataFrame([(1, "s", [0.0, 2.0]), (1, "t", [0.0, 2.0]), (2, "u", [1.0, 1.0])], "question_id long, data_source string, query_embedding array<double>")
    rows = two_stage.ranked_documents(documents, questions, 2).collect()
    assert sorted((r.question_id, r.data_source, r.document_index, r.document_id, r.similarity, r.batch) for r in rows) == [(1, "s", 1, 3, 1.0, 0), (1, "s", 2, 2, 0.0, 0), (1, "s", 3, 1, None, 1), (1, "t", 1, 4, 0.0, 0)]


def above_cells(df):
    """The plan above the cells."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    return plan[: plan.index("FlatMapGroupsInArrow")]


def test_sources_in_one_cell_and_by_pairs(spark, monkeypatch):
    """Before, every pair of a question and a document was moved several times: to its cell, to be sorted, numbered and joined with its chunks. Sources that are too large for a cell still are."""
    for name, value in (("ASKED", 3), ("SCORES", 300), ("OUT", 7)):
        monkeypatch.setattr(vector_cells, name, value)
    rng = random.Random(5)
    vector = lambda: rng.choice([None, [0.0] * 4, [1.0, None, 2.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 0.0, 0.0]]) if rng.random() < 0.2 else [float(rng.randrange(-2, 3)) for _ in range(4)]
    source = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    documents = spark.createDataFrame([(i, source(), vector(), f"d{i}") for i in range(60)], "document_id long, data_source string, summary_embedding array<float>, name string")
    chunks = spark.createDataFrame([(rng.randrange(70), f"c{i}", vector()) for i in range(150)], "document_id long, chunk_id string, embedding array<float>")
    questions = spark.createDataFrame([(f"q{i}", s, v) for i in range(8) for v in [vector()] for s in "abx"[: 1 + i % 3]], "question_id string, data_source string, query_embedding array<float>")
    found = {}
    for components in (1 << 24, 400, 0):  # all sources in cells, the largest by pairs, all by pairs
        monkeypatch.setattr(vector_cells, "COMPONENTS", components)
        rows = two_stage.ranked_documents(documents, questions, 4, chunks=chunks, n=3)
        found[components] = sorted((r.question_id, r.data_source, r.document_index, r.document_id, r.name, repr(r.similarity), r.batch, [(x.chunk_id, repr(x.score)) for x in r.best]) for r in rows.collect())
        if components > 400:
            assert not any(x in above_cells(rows) for x in ("Exchange", "Join", "Sort"))
    assert found[1 << 24] == found[400] == found[0]
    assert max(len(x[-1]) for x in found[0]) == 3 and min(len(x[-1]) for x in found[0]) == 0 and {x[1] for x in found[0]} == {"a", "b"}
    whole = two_stage.ranked_documents(documents, questions, 4)
    assert sorted((r.question_id, r.document_id, r.document_index) for r in whole.collect()) == sorted((x[0], x[3], x[2]) for x in found[0]) and "best" not in whole.columns


def test_decisions_in_place_are_those_of_a_join(spark):
    ranked = spark.createDataFrame([("q", "s", i, 10 + i, 0) for i in range(1, 8)], "question_id string, data_source string, document_index long, document_id long, batch long")
    said = [(1, 2, "answered", " x ", 3), (1, 1, "unknown", None, 1), (2, 1, "irrelevant", " ", 4), (3, 1, "answered", "\t", 4), (4, 5, "answered", "y", 2), (4, 6, "irrelevant", "z", 2), (6, 1, None, "w", 1)]
    proposals = spark.createDataFrame([("q", "s", *x) for x in said], "question_id string, data_source string, document_index long, at int, status string, finding string, page int")
    lists = proposals.groupBy("question_id", "data_source", "document_index").agg(F.collect_list(F.struct("at", "status", "finding", "page")).alias("proposals"))
    names = ["question_id", "data_source", "document_index", "document_id", "status", "finding", "page"]
    rows = two_stage.decided_in_place(ranked.join(lists, ["question_id", "data_source", "document_index"], "left"))
    assert sorted(map(str, rows.select(names).collect())) == sorted(map(str, two_stage.decided(ranked, proposals).select(names).collect())) and "batch" in rows.columns
