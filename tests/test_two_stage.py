import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunk_store, two_stage, vector_index
from quillspark.plans import two_stage as plans

CHUNK = "document long, chunk long, page long, section long, subsection long, section_pages long, subsection_pages long, content string"


def corpus(seed=4, documents=30):
    rng, rows = random.Random(seed), []
    for d in range(documents):
        page = 0
        for c in range(rng.randrange(1, 40)):
            page += rng.choice([0, 1, 1, 1, 3])
            rows.append([d, c, page, c // 7 + 1, (c % 7) // 3])
    sections = lambda r: len({x[2] for x in rows if x[0] == r[0] and x[3] == r[3]})
    subs = lambda r: len({x[2] for x in rows if x[0] == r[0] and x[3:5] == r[3:5]})
    chunks = [(*r, None if rng.random() < 0.05 else sections(r), subs(r), f"text {r[1]} <b>") for r in rows]
    pages = [(d, None if d % 11 == 5 else max(r[2] for r in rows if r[0] == d)) for d in range(documents)]
    seeds = [(r[0], r[1]) for r in rows if rng.random() < 0.08]
    return chunks, pages, seeds


def expanded(chunks, pages, seeds, full, section, subsection, around, gap):
    """By definition, document after document."""
    found = {}
    for d, count in pages:
        own, asked = [c for c in chunks if c[0] == d], {s for x, s in seeds if x == d}
        if asked and count is not None and count <= full:
            found |= {(d, c[1]): "full" for c in own}
            continue
        level = {}
        for s in (c for c in own if c[1] in asked):
            if s[5] is not None and s[5] <= section:
                took, name = [c for c in own if c[3] == s[3]], 2
            elif s[6] <= subsection and s[4] > 0:
                took, name = [c for c in own if c[3:5] == s[3:5]], 3
            else:
                took, name = [c for c in own if c[3] == s[3] and abs(c[1] - s[1]) <= around], 4
            for c in took:
                level[c[1]] = min(name, level.get(c[1], 9))
        at = sorted({c[2] for c in own if c[1] in level})
        missing = {p for a, b in zip(at, at[1:]) if b - a - 1 <= gap for p in range(a + 1, b)}
        for c in own:
            if c[1] in level or c[2] in missing:
                found[d, c[1]] = {2: "primary", 3: "subsection", 4: "neighbor", 5: "gap"}[level.get(c[1], 5)]
    return found


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    chunks, pages, seeds = corpus()
    rows = spark.createDataFrame(chunks + [(50, 0, 1, None, None, None, None, "loose"), (50, 1, 2, 1, None, 1, None, "x")], CHUNK)
    return chunk_store.write_store(rows, str(tmp_path_factory.mktemp("store") / "chunks"), buckets=4), chunks, pages, seeds


@pytest.mark.parametrize("limits", [{"full": 4, "section": 5, "subsection": 2, "around": 1, "gap": 2}, {"full": 0, "section": 0, "subsection": 3, "around": 2, "gap": 3}])
def test_expansion_against_definition(spark, stored, limits):
    store, chunks, pages, seeds = stored
    documents, asked = spark.createDataFrame(pages, "document long, page_count long"), spark.createDataFrame(seeds, "document long, chunk long")
    want = expanded(chunks, pages, seeds, **limits)
    found = chunk_store.expanded(store.rows(), documents, asked, **limits)
    assert {(r.document, r.chunk): r.expansion_level for r in found.collect()} == want and found.count() == len(want)
    some = seeds[::2]
    both = asked.withColumn("question_id", F.lit("a")).unionByName(spark.createDataFrame(some, "document long, chunk long").withColumn("question_id", F.lit("b")))
    rows = two_stage.read_in_context(store, documents, both, **limits).collect()
    for question, part in (("a", seeds), ("b", some)):
        assert {(r.document, r.chunk): r.expansion_level for r in rows if r.question_id == question} == expanded(chunks, pages, part, **limits)


def moved_chunks(df):
    """Whether the plan shuffles or broadcasts the store's rows: an exchange above a scan of the store."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    depth = lambda line: len(re.match(r"[\s:|+-]*(?:\*\(\d+\) )?[\s:|+-]*", line).group())
    above = []
    for line in plan.splitlines():
        above = [(d, x) for d, x in above if d < depth(line)] + [(depth(line), line)]
        if "Scan parquet spark_catalog.default.store_" in line:
            return any("Exchange" in x for _, x in above[:-1])
    raise AssertionError(f"no scan of the store in\n{plan}")


def test_chunks_stay_where_they_are(spark, stored):
    store, _, pages, seeds = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wanted = spark.createDataFrame([(1, 1, 0, 2, 5)], "document long, section long, subsection long, first long, last long").repartition(3)
        for read in (chunk_store.of_documents, chunk_store.of_pages, chunk_store.of_sections, chunk_store.of_subsections, chunk_store.neighbours):
            assert not moved_chunks(read(store, wanted)), read.__name__
        documents, asked = spark.createDataFrame(pages, "document long, page_count long").repartition(3), spark.createDataFrame(seeds, "document long, chunk long").repartition(3)
        assert not moved_chunks(chunk_store.expanded(store.rows(), documents, asked))
        assert not moved_chunks(two_stage.read_in_context(store, documents, asked.withColumn("question_id", F.lit(1))))
        assert moved_chunks(store.rows().repartition(5, "page"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_null_safe_requests(spark, stored):
    store = stored[0]
    ask = lambda read, rows, schema: sorted((r.document, r.chunk) for r in read(store, spark.createDataFrame(rows, schema)).filter("document = 50").collect())
    assert ask(chunk_store.of_sections, [(50, None), (50, None)], "document long, section long") == [(50, 0)]
    assert ask(chunk_store.of_subsections, [(50, 1, None)], "document long, section long, subsection long") == [(50, 1)]
    assert ask(chunk_store.of_subsections, [(50, None, 1)], "document long, section long, subsection long") == []
    assert ask(chunk_store.neighbours, [(50, None, 0, 9), (50, 1, 1, 1)], "document long, section long, first long, last long") == [(50, 0), (50, 1)]
    assert ask(chunk_store.of_pages, [(50, 2, 2), (50, 1, 2)], "document long, first long, last long") == [(50, 0), (50, 1)]
    assert ask(chunk_store.of_documents, [(None,)], "document long") == []


def test_reopened_store(spark, stored):
    store = stored[0]
    again = chunk_store.open_store(spark, store.path, store.rows().schema, store.buckets)
    assert again.rows().count() == store.rows().count() and "SelectedBucketsCount" in again.rows().join(again.rows().groupBy("document").count(), "document")._jdf.queryExecution().executedPlan().toString()


def test_lookups_of_regions(spark, tmp_path):
    rows = [(1, "r2", "S", 9, "a"), (1, "r2", "S", 4, "b"), (1, "r10", "S", 5, "c"), (1, "r2", "T", 1, "d"), (2, None, "S", 6, "e")]
    store = chunk_store.write_store(spark.createDataFrame(rows, "document long, region_id string, sheet_name string, dense_table_id long, raw string"), str(tmp_path / "r"), 2, ("document", "region_id"))
    wanted = spark.createDataFrame([(1, "r2", "S"), (1, "r2", "U"), (2, None, "S"), (9, "r1", "S"), (1, "r2", "S")], "document long, region_id string, sheet_name string")
    found = [(r.document, r.sheet_name, r.found.raw if r.found else None) for r in chunk_store.found_regions(store, wanted).collect()]
    assert sorted(found) == [(1, "S", "b"), (1, "S", "b"), (1, "U", None), (2, "S", None), (9, "S", None)]
    assert {r.document: r.found.raw if r.found else None for r in chunk_store.found_regions(store, wanted.select("document", "region_id"), by_sheet=False).collect()} == {1: "d", 2: None, 9: None}
    assert [r.raw for r in chunk_store.regions_of_documents(store, wanted).filter("document = 1").orderBy("place").collect()] == ["c", "d", "b", "a"]


def clustered(rng, n, groups=40, size=16):
    middle = rng.normal(size=(groups, size))
    return middle[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, size))


def test_index_equals_a_scan_and_prunes(spark, tmp_path):
    rng = np.random.default_rng(8)
    points = clustered(rng, 4000)
    points[100:120] = points[7]  # ties
    rows = [(i, [float(np.float32(x)) for x in p], i % 3) for i, p in enumerate(points)] + [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(4)
    index = vector_index.build_index(vectors, str(tmp_path / "index"), "id", clusters=40)
    ids = [7, 100, 555, 3999]
    found, work = vector_index.search(index, vectors.filter(F.col("id").isin(ids)), 25, "id")
    unit = np.array([r[1] for r in rows[:4000]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    got = {}
    for r in found.collect():
        got.setdefault(r.query, {})[r["rank"]] = (r.id, r.score)
    for q in ids:
        scores = np.round(unit @ unit[q], 6)
        best = sorted(range(4000), key=lambda i: (-scores[i], i))[:25]
        assert [got[q][i + 1][0] for i in range(25)] == best
    read = work.collect()
    assert len(read) == 4 and all(r.total == 4000 and r["read"] < 1000 for r in read)


def test_small_and_empty_indexes(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    index = vector_index.build_index(vectors, str(tmp_path / "a"), "id", clusters=8)
    assert [(r.id, r.score) for r in vector_index.nearest(index, vectors.filter("id = 2"), 10, "id").orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert vector_index.nearest(index, vectors.limit(0), 10, "id").count() == 0


def test_numbers_within_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(500)]
    found = two_stage.numbered_in(spark.createDataFrame(rows, "g string, x int, i int").repartition(5), ["g"], [F.desc("x"), "i"], "n").collect()
    for g in ("a", "b", None):
        own = sorted((r for r in found if r.g == g), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1, len(own) + 1)) and [(r.x, r.i) for r in own] == sorted(((x, i) for h, x, i in rows if h == g), key=lambda t: (-t[0], t[1]))


def test_texts_of_batches_and_contexts(spark):
    ranked = spark.createDataFrame([(1, "s", 7, 1, 0, "A & B", "pdf", 3, "sum <x>"), (1, "s", 8, 2, 0, "C", None, None, "")], "question_id int, data_source string, document_id long, document_index long, batch long, document_name string, document_type string, page_count long, summary string")
    excerpts = spark.createDataFrame([(1, 7, 2, None, None, "two"), (1, 7, 1, 4, "Part > Sub", "one < two")], "question_id int, document_id long, rank long, page long, location string, content string")
    texts = {r.document_index: r.text for r in two_stage.batch_texts(ranked, excerpts, spark.createDataFrame([(1, 8)], "question_id int, document_id long")).collect()}
    assert texts[1] == (
        '<document index="1">\n  <document_id>7</document_id>\n  <document_name>A &amp; B</document_name>\n  <type>pdf</type>\n  <pages>3</pages>\n  <summary>sum &lt;x&gt;</summary>\n  <excerpts>\n'
        '    <excerpt page="4" location="Part &gt; Sub">\n      one &lt; two\n    </excerpt>\n    <excerpt page="?" location="">\n      two\n    </excerpt>\n  </excerpts>\n</document>'
    )
    assert texts[2].startswith('<document index="2" [TOP SUMMARY MATCH]>') and "<pages>Unknown</pages>" in texts[2]
    chunks = [(1, 0, 1, 2, "Two", 0, None, "a\nb"), (1, 1, 1, 2, None, 1, "Sub", "c"), (1, 2, None, None, None, None, None, None), (1, 3, 2, 1, "", 3, None, "d&e")]
    row = two_stage.context_texts(spark.createDataFrame(chunks, "document long, chunk long, page long, section long, section_name string, subsection long, subsection_name string, content string"), ["document"]).first()
    assert row.n_chunks == 4 and row.text.split("\n") == [
        '<document document="1">', "  <primary_section>", '    <subsection name="Subsection 3">', '      <chunk page="2">', "        d&amp;e", "      </chunk>", "    </subsection>", "  </primary_section>",
        '  <primary_section name="Two">', '    <subsection name="Sub">', '      <chunk page="1">', "        c", "      </chunk>", "    </subsection>", '    <chunk page="1">', "      a", "      b", "    </chunk>", "  </primary_section>",
        "  <primary_section>", '    <chunk page="unknown">', "      ", "    </chunk>", "  </primary_section>", "</document>",
    ]


def test_findings_of_decisions(spark):
    decisions = spark.createDataFrame([(1, "s", 1, 7, "answered", "yes", 3), (1, "s", 2, 8, "needs_deep_research", "", None), (1, "s", 3, 9, "irrelevant", "no", None), (1, "s", 4, 99, "answered", "lost", 1)], "question_id int, data_source string, document_index long, document_id long, status string, finding string, page long")
    documents = spark.createDataFrame([(7, "D", ""), (8, "E", "e.pdf"), (9, "F", None)], "document_id long, document_name string, file_name string")
    assert [(r.document_id, r.file_name, r.file_link, r.page, r.source) for r in two_stage.metadata_findings(decisions, documents).collect()] == [(7, "D", "", 3, "metadata")]
    assert [r.document_id for r in two_stage.to_research(decisions).collect()] == [8]
    assert two_stage.outcome(decisions).first()[2:] == (2, 1, 1)


def test_buckets_of_lines_grow_with_the_texts(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(plans, "BUCKET", 20_000)
    kept = plans.store(spark, sf)
    size = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert kept.buckets == -(-size // 20_000) > 8
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk", "content"))
    got = kept.rows().select("document", F.col("chunk").cast("int"), "content")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
