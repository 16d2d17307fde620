import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    """Every document's score for every item."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for d, c, n in counts:
            m = 25 + 75 * n * n_docs // total
            score = sum(q * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def corpus():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "e", "İ", "x_y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(None, docs[3][1])] * 2 + [(3, docs[3][1])] + [(2000, None), (2001, ""), (2002, "?! --"), (2003, "w1 " * 50_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 20])))) for i in range(25)] + [(50, docs[3][1]), (50, "W1 w1 W2"), (51, None), (52, ""), (53, "unheardof"), (None, "w7 ünï")]
    return docs, items


@pytest.mark.parametrize("portion", [8 << 20, 600])
def test_against_every_score(spark, monkeypatch, portion):
    monkeypatch.setattr(lexical, "PORTION_BYTES", portion)
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"id": F.lit(1), "n": F.lit("x"), "score": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(9))
    got = lexical.ranked_documents(table, asked, k=10)
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got.collect()) == ranked(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "w1")], "doc_id long, text string"), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert [(r.doc_id, r["rank"]) for r in lexical.ranked_documents(docs, items).collect()] == [(1, 1)]
    assert lexical.ranked_documents(docs.limit(0), items).count() == lexical.ranked_documents(docs, items.limit(0)).count() == 0


def test_reads_few_entries_where_impacts_differ():
    rng = np.random.default_rng(1)
    n, width = 20_000, 3
    doc, code = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
    impact = (1e6 / rng.integers(1, 10_000, n * width)).astype(np.int64)
    block = lexical.Block(np.arange(n), np.zeros(n, bool), doc, code, impact, width)
    weights = np.array([5, 3, 2])
    best = block.search(np.arange(width), weights, 10, lexical.Best.none())
    whole = impact.reshape(n, width) @ weights
    assert best.ids.tolist() == np.lexsort((np.arange(n), -whole))[:10].tolist() and block.read < n


def test_equal_scores_are_all_met():
    n = 1000
    ids = np.arange(n)[::-1].copy()
    block = lexical.Block(ids, np.zeros(n, bool), np.arange(n), np.zeros(n, np.int64), np.full(n, 7), 1)
    assert block.search(np.array([0]), np.array([2]), 10, lexical.Best.none()).ids.tolist() == list(range(10))
