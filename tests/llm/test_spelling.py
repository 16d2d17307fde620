import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quillspark.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows, least, support, drop_every):
    n = Counter()
    for doc_id, text in rows:
        for run in map(lower, RUN.findall(text or "")):
            h = crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    return {w: c for w, c in n.items() if c >= support}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    return a[start + (len(a) >= len(b)) :] == b[start + (len(b) >= len(a)) :]


def grouped(words, ratio=2):
    found = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        found[w] = (best if best and words[best] >= ratio * n else None, len(near))
    rows = set()
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.add((w, form, root, words[w], n_near, words[form] if form else None))
    return rows


def corpus():
    rng = random.Random(11)
    stems = ["house", "mouse", "hausé", "maison", "maisön", "aaaaab", "aaaab", "aaaaa", "chains", "chain", "chainsx", "œuvre", "÷signs×"]
    rows = [(i, " ".join(w[: (k := rng.randrange(len(w)))] + w[k + rng.randrange(2) :] if rng.random() < 0.4 else w.title() for w in rng.choices(stems, [2**j for j in range(len(stems))], k=60))) for i in range(60)]
    long = "".join(rng.choice("abc") for _ in range(4000))
    rows += [(i, f"{long} {long[:2000]}{long[2001:]} {long[:100]}é{long[100:]} {long[:48]} {long[:49]}") for i in range(100, 104)]
    return rows + [(200, None), (201, ""), (202, "1 2 3 ?"), (None, "house house chain"), (7, "again " * 5), (7, "again " * 5)]


@pytest.mark.parametrize("drop_every", [None, 7])
def test_against_every_pair(spark, drop_every):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"id": F.lit(1), "word": F.lit("x"), "n": F.lit(None).cast("int")})
    words = counted(rows, 5, 3, drop_every)
    found = spelling.variants(spelling.word_counts(docs, drop_every=drop_every)).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == grouped(words)
    assert len(found) == len(words)


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 50), (300, 301)], "id long, form long")
    assert {r.id: r.root for r in spelling.roots(links).collect()} == {i: 100 for i in range(100)} | {200: 100, 300: 301}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_report(docs).count() == 0
    assert spelling.variant_report(spark.createDataFrame([(1, None)], docs.schema)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
