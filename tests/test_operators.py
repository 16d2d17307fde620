import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import citations, dates, text
from quillspark.functions.vectors import cosine
from quillspark.operators import catalog, chunk_store, dense, extraction, findings, flatten, payloads, registry, retrieval, structure, tables
from quillspark.sources import store
from quillspark.streaming import citations as stream


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "kind", "number"),
    [("(1,234)", "numeric", -1234.0), ("$5.20", "numeric", 5.2), ("12%", "numeric", 12.0), ("TRUE", "boolean", None), ("2024-01-15", "date", None), ("2024-01-15 10:00:00", "date", None), ("", "null", None), (None, "null", None), ("-", "text", None), ("nan", "text", None), ("inf", "text", None), ("1d", "text", None), ("1_000", "text", None), (".5", "numeric", 0.5), ("5.", "numeric", 5.0), ("( 3 )", "text", None)],
)
def test_types(spark, value, kind, number):
    assert one(spark, text.value_type(F.col("v")), value) == kind
    assert one(spark, text.numeric(F.col("v")), value) == number


def test_text_functions(spark):
    assert one(spark, text.truncated(F.col("v"), 8), "abcdefghij") == "abcde..."
    assert one(spark, text.tail(F.col("v"), 5), "abcdef\nxyz") == "xyz"
    assert one(spark, text.tail(F.col("v"), 50), "a\nb") == "a\nb"
    assert one(spark, text.breadcrumb(F.col("v"), F.lit("")), "A") == "A"
    assert one(spark, text.value_shape(F.col("v")), " AB-12  cd ") == "A-0 A"
    assert one(spark, text.is_boilerplate(F.col("v")), "1.2 Table of Contents:") is True
    assert one(spark, text.xml_escaped(F.col("v")), '<a b="c&d">') == "&lt;a b=&quot;c&amp;d&quot;&gt;"
    assert one(spark, text.template(F.col("v"), {"x": "1"}), "{{x}}-{x}-{y}") == "1-1-{y}"
    assert one(spark, text.word_tokens(F.col("v")), "") == 1
    assert [one(spark, text.column_letters(F.col("v")), n, "long") for n in (1, 26, 27, 52, 53, 702, 703, 18278)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ"]
    assert one(spark, text.stable_id(F.col("v"), F.lit("b")), None) == one(spark, text.stable_id(F.col("v"), F.lit("b")), "")


def test_fiscal_and_dates(spark):
    for day, year, quarter in ((dt.date(2024, 10, 31), 2024, 4), (dt.date(2024, 11, 1), 2025, 1), (dt.date(2025, 2, 1), 2025, 2)):
        assert one(spark, dates.fiscal_year(F.col("v")), day, "date") == year
        assert one(spark, dates.fiscal_quarter(F.col("v")), day, "date") == quarter
    assert one(spark, dates.first_date(F.col("v")), "FY 2024, on 2023-01-02") == "2023-01-02"
    assert one(spark, dates.first_date(F.col("v")), "none") is None


def test_vectors(spark):
    assert one(spark, cosine(F.col("v"), F.lit([3.0, 4.0])), [3.0, 4.0], "array<float>") == pytest.approx(1)
    assert one(spark, cosine(F.col("v"), F.lit([3.0, 4.0])), [0.0, 0.0], "array<float>") is None
    assert one(spark, cosine(F.col("v"), F.lit([3.0, 4.0])), None, "array<float>") is None


def test_citations(spark):
    for marker, want in (("[REF:1]", [1]), ("[ref:1,3-5]", [1, 3, 4, 5]), ("[REF:5-3]", [3, 4, 5]), ("[REF: 2 ]", [2]), ("none", []), ("[REF:-]", [])):
        assert one(spark, citations.cited(F.col("v")), f"x {marker} y") == want
    links = F.create_map(F.lit(1), F.lit("<one>"), F.lit(2), F.lit("<one>"))
    assert one(spark, citations.replaced(F.col("v"), links), "a [REF:1,2,9] b [REF:9] c") == "a <one> b  c"
    assert stream.take("see [RE", "F:1] and [") == ("see [REF:1] and ", "[")
    assert stream.resolved("a [REF:3-1]", {1: "x", 2: "y"}) == "a x y"


def test_citation_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, 0, "see [RE"), (1, 1, "F:1,2]."), (1, 2, ""), (2, 0, "open ["), (2, 1, "REF:9] end"), (2, 2, "")]
    spark.createDataFrame(rows, "run_uuid long, at long, text string").coalesce(1).write.json(str(source))
    pieces = spark.readStream.schema("run_uuid long, at long, text string").json(str(source))
    query = stream.resolved_stream(pieces, {1: "<1>", 2: "<2>"}).writeStream.format("memory").queryName("cited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert {r.run_uuid: r.text for r in spark.table("cited").collect()} == {1: "see <1> <2>.", 2: "open  end"}


FILE = "file_path string, file_size long, date_last_modified double, file_hash string"


def test_diff(spark):
    old = spark.createDataFrame([("same", 1, 1.0, "a"), ("touched", 1, 1.0, "a"), ("edited", 1, 1.0, "a"), ("grown", 1, 1.0, "a"), ("gone", 1, 1.0, "a")], FILE)
    new = spark.createDataFrame([("same", 1, 1.0, "b"), ("touched", 1, 2.0, "a"), ("edited", 1, 2.0, "b"), ("grown", 2, 1.0, "a"), ("fresh", 1, 1.0, "a")], FILE)
    changes = {r.file_path: r.change for r in catalog.diff(new, old).collect()}
    assert changes == {"same": "unchanged", "touched": "unchanged", "edited": "modified", "grown": "modified", "gone": "deleted", "fresh": "new"}
    assert catalog.diff(new, old.limit(0)).filter("change <> 'new'").count() == 0


def test_merge_and_versions(spark):
    rows = "file_path string, x int"
    old = spark.createDataFrame([("a", 1), ("b", 1), ("stale", 1)], rows)
    new = spark.createDataFrame([("b", 2)], rows)
    current = spark.createDataFrame([("a",), ("b",)], "file_path string")
    assert sorted(catalog.merge_snapshot(old, new, current).collect()) == [("a", 1), ("b", 2)]
    assert sorted(catalog.newest([old, new]).collect()) == [("a", 1), ("b", 2), ("stale", 1)]
    assert [r[0] for r in catalog.missing(current, new).collect()] == ["a"]


def test_scan_files(spark, tmp_path):
    for name in ("root.pdf", "src/2024/bank/x/y/deep.PDF", "src/.hidden", "src/.dir/a.pdf", "src/noext"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    found = {r.filename: r for r in catalog.scan_files(spark, str(tmp_path)).collect()}
    assert set(found) == {"deep.PDF", "noext"}
    deep = found["deep.PDF"]
    assert (deep.data_source, deep.filter_1, deep.filter_2, deep.filter_3, deep.filetype) == ("src", "2024", "bank", "x/y", "pdf")
    assert deep.file_size == 26 and len(deep.file_hash) == 64 and found["noext"].filetype == ""


def test_ranges_and_gaps(spark):
    ranges = spark.createDataFrame([("d", 1, 3), ("d", 2, 5), ("d", 6, 7), ("d", 9, 9), ("e", 1, 1)], "doc string, start long, end long")
    assert sorted(retrieval.merged_ranges(ranges, ["doc"]).collect()) == [("d", 1, 7), ("d", 9, 9), ("e", 1, 1)]
    pages = spark.createDataFrame([("d", 1), ("d", 4), ("d", 8), ("d", 4)], "doc string, page long")
    assert sorted(retrieval.gap_pages(pages, ["doc"], "page", 2).collect()) == [("d", 2), ("d", 3)]


def test_neighbours_keep_the_first_chunk(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(6)], "doc string, chunk long")
    hits = spark.createDataFrame([("d", 0)], "doc string, chunk long")
    assert sorted(r.chunk for r in retrieval.neighbours(chunks, hits, ["doc"], "chunk", 2).collect()) == [0, 1, 2]


def test_top_k_ties(spark):
    rows = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 1.0), ("a", 2, None), ("b", 9, 0.5)], "doc string, id long, score double")
    assert [r.id for r in retrieval.top_k(rows, 9, "id").collect()] == [1, 3, 9]
    assert sorted((r.doc, r.id) for r in retrieval.top_k_by(rows, "doc", 1, "id").collect()) == [("a", 1), ("b", 9)]
    assert retrieval.filtered(rows, {"doc": "a", "id": None}).count() == 3


def test_boundaries(spark):
    pages = spark.createDataFrame([(1, 1, ""), (1, 2, "A"), (1, 3, "a"), (1, 4, ""), (1, 5, "A"), (1, 6, "B")], "doc long, page long, title string")
    starts = structure.heading_boundaries(pages, ["doc"])
    assert sorted(r.page for r in starts.collect()) == [1, 2, 6]
    parts = structure.intervals(starts, ["doc"], F.lit(6).cast("long"))
    assert sorted((r.page_start, r.page_end) for r in parts.collect()) == [(1, 1), (2, 5), (6, 6)]
    inside = structure.section_of_pages(pages, parts, ["doc"])
    assert [r.section for r in inside.orderBy("page").collect()] == [1, 2, 2, 2, 2, 3]
    items = spark.createDataFrame([(1, "x", 9, 1), (1, "y", 4, 2), (1, "z", 4, 3), (1, "w", -2, 4)], "doc long, title string, start long, at long")
    fixed = structure.normalised_boundaries(items, ["doc"], F.lit(2).cast("long"), F.lit(6).cast("long"))
    assert sorted((r.page_start, r.title) for r in fixed.collect()) == [(2, "w"), (4, "y"), (6, "x")]


def test_context_chains(spark):
    sheets = spark.createDataFrame([(1, i, needs) for i, needs in enumerate([True, True, True, True, True, False, True], 1)], "doc long, page long, needs_context boolean")
    chains = {r.page: list(r.chain) for r in structure.context_chains(sheets, ["doc"]).collect()}
    assert chains == {1: [], 2: [1], 3: [1, 2], 4: [1, 2, 3], 5: [2, 3, 4], 6: [], 7: [6]}


def test_profile_edges(spark):
    rows = [("n", "1"), ("n", "2"), ("n", None), ("m", "1"), ("m", "x"), ("e", None), ("e", " ")]
    found = {r.name: r for r in tables.profile(spark.createDataFrame(rows, "name string, value string")).collect()}
    assert (found["n"].dtype, found["n"].null_count, found["n"].mean) == ("numeric", 1, 1.5)
    assert (found["m"].dtype, found["e"].dtype, found["e"].unique_count) == ("mixed", "text", 0)
    assert tables.profile(spark.createDataFrame([], "name string, value string")).count() == 0


def test_header_mode(spark):
    def mode(rows):
        cells = [("t", i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row, 1)]
        return tables.header_mode(spark.createDataFrame(cells, "t string, row long, col long, value string"), ["t"]).first().mode

    assert mode([("Name", "Amount"), ("a", "1"), ("b", "2")]) == "header"
    assert mode([("1", "2"), ("3", "4")]) == "headerless"
    assert mode([("a", "1", "x"), ("a", "2", "x")]) == "headerless"
    assert mode([("only", "row")]) == "header"


def test_regions_and_scores(spark):
    cells = [("s", r, c, f"v{r}{c}") for r in (1, 2, 3) for c in (1, 2)] + [("s", r, c, "w") for r in (5, 6) for c in (1, 2, 4, 5)]
    df = spark.createDataFrame(cells, "sheet string, row long, col long, value string")
    found = tables.regions(df, ["sheet"])
    sizes = sorted((r["region"], r["count"]) for r in found.groupBy("region").count().collect())
    assert sizes == [(1, 6), (2, 4), (3, 4)]
    scores = {r.region: r for r in tables.region_scores(found, ["sheet", "region"]).collect()}
    assert scores[1].used_range == "A1:B3" and scores[1].region_type == "dense_table" and scores[1].score > 0.8
    assert tables.best_region(tables.region_scores(found, ["sheet", "region"]), ["sheet"]).first().region == 1


def test_regions_equal_splitting_by_hand_without_moving_cells(spark):
    def by_hand(cells):
        for axis in (0, 1):
            used = sorted({c[axis] for c in cells})
            for a, b in zip(used, used[1:]):
                if b > a + 1:
                    return by_hand({c for c in cells if c[axis] <= a}) + by_hand({c for c in cells if c[axis] >= b})
        return [cells]

    draw = random.Random(3)
    sheets = {s: {(draw.randrange(-2, 12), draw.randrange(14)) for _ in range(draw.choice((5, 12, 20, 40)))} for s in range(60)}
    spiral = ["#######", "......#", "#####.#", "#...#.#", "#.#...#", "#.#####", "#......"]
    sheets[60] = {(r, c) for r, line in enumerate(spiral) for c, x in enumerate(line) if x == "#"}  # no line is blank: one region
    sheets[61] = {(8 * r + 2 * i, 8 * c + 2 * j) for r in range(2) for c in range(2) for i in range(3) for j in range(3)}
    rows = [(s, *c, f"{s}.{c}") for s, cells in sheets.items() for c in cells]
    df = spark.createDataFrame([*rows, rows[0], (0, None, 1, "no row")], "sheet long, row long, col long, value string")  # a cell that comes twice stays twice
    before = {(s, *c): n for s, cells in sheets.items() for n, cells in enumerate(sorted(by_hand(cells), key=lambda g: (min(c[0] for c in g), min(c[1] for c in g))), 1) for c in cells}
    found = tables.regions(df, ["sheet"])
    assert sorted((r.sheet, r.row, r.col, r.value, r.region) for r in found.collect()) == sorted((*r, before[r[:3]]) for r in [*rows, rows[0]])
    runs = tables.region_runs(df, ["sheet"])
    assert runs.agg(F.sum("n")).first()[0] == len(rows) + 1 and runs.count() < len(rows)
    for df in (found, runs):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_dense_filter(spark):
    rows = spark.createDataFrame([("A", 1), ("b", 2)], "Name string, n int")
    assert tables.dense_filter(rows, {"NAME": "a", "nope": "z"}).count() == 1
    assert tables.dense_filter(rows, {}).count() == 2
    assert tables.dense_filter(rows, {"name": "q"}).count() == 0


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "x\n| a | b\\|c |\n|---|:-:|\n| 1 | |")], "id int, text string")
    assert [(r.line_number, r.col, r.value) for r in tables.markdown_cells(docs, ["id"], "text").orderBy("line_number", "col").collect()] == [(2, 1, "a"), (2, 2, "b|c"), (4, 1, "1"), (4, 2, "")]


def test_metrics(spark):
    said = "CET1 ratio at 13.4%; Revenue: $1,234; Total: 5; Count 1: 2,3,4; Incident count: 12; Employees: 12\n- net income reported = $3 mm; Row height: 4 pt; net income: €5; Base: 3%; Total assets: 7, Open Cases at 3"
    found = {r.label: r.value for r in extraction.text_metrics(spark.createDataFrame([(1, said)], "id int, text string"), ["id"], "text").collect()}
    assert found == {"CET1 ratio": "13.4%", "Revenue": "$1,234", "Incident count": "12", "Net income": "€5", "Total assets": "7", "Open Cases": "3"}
    cells = [(1, 1, 1, "Notes"), (1, 2, 1, "Metric"), (1, 2, 3, "Current value"), (1, 3, 1, "Profit"), (1, 3, 3, "$5."), (1, 4, 1, "Narrative note 1"), (1, 4, 3, "$6"), (1, 5, 1, "Sheet name"), (1, 5, 3, "$7"), (1, 6, 1, "Profit measured"), (1, 6, 3, "$8")]
    df = spark.createDataFrame(cells, "id int, row long, col long, value string")
    assert [(r.label, r.value) for r in extraction.region_metrics(df, ["id"]).collect()] == [("Profit", "$8")]
    assert extraction.region_metrics(df, ["id"], search=1).count() == 0
    other = spark.createDataFrame([(1, "Profit", "$9"), (2, "Loss", "$1")], "id int, label string, value string")
    merged = extraction.merged_metrics([extraction.region_metrics(df, ["id"]), other], ["id"])
    assert sorted((r.id, r.label, r.value) for r in merged.collect()) == [(1, "Profit", "$9"), (2, "Loss", "$1")]
    assert one(spark, extraction.looks_like_sequence(F.col("v")), "$1,234") is False
    assert one(spark, extraction.looks_like_sequence(F.col("v"), strict=True), "$1,234") is True


def test_decisions(spark):
    batch = spark.createDataFrame([(i, f"d{i}") for i in range(5)], "document_index long, document_id string").withColumn("s", F.lit("x"))
    made = [(0, "answered", "yes", 3, 1), (0, "irrelevant", "no", 1, 2), (1, "answered", " ", 2, 1), (2, "irrelevant", None, 4, 1), (3, "bad", "text", 5, 1), (77, "answered", "lost", 1, 1)]
    decisions = spark.createDataFrame(made, "document_index long, status string, finding string, page long, at int").withColumn("s", F.lit("x"))
    found = {r.document_index: (r.status, r.finding, r.page) for r in findings.validated(batch, decisions, ["s"]).collect()}
    assert found == {0: ("answered", "yes", 3), 1: ("needs_deep_research", "", None), 2: ("irrelevant", findings.IRRELEVANT, None), 3: ("needs_deep_research", "text", None), 4: ("needs_deep_research", "", None)}


def test_numbering_is_consecutive(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 9), (None, 1), ("b", 1)], "part string, x long")
    assert [(r.ref_id, r.part, r.x) for r in findings.numbered(rows, ["part", "x"]).orderBy("ref_id").collect()] == [(1, None, 1), (2, "a", 9), (3, "b", 1), (4, "b", 2)]


def test_history_and_versions(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", None), (1, 3, "user", "r"), (1, 4, "assistant", "t")]
    found = registry.history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 2).orderBy("turn").collect()
    assert [(r.turn, r.dropped, r.had_system) for r in found] == [(3, 3, True), (4, 3, True)]
    prompts = spark.createDataFrame([("p", "9.0.0"), ("p", "10.0.0"), ("p", "2")], "name string, version string")
    assert registry.latest(prompts, ["name"], registry.version_parts(F.col("version"))).first().version == "10.0.0"


def test_flatten_and_store(spark, tmp_path):
    summary = {"overview": "o", "key_topics": ["k"], "key_metrics": {}, "key_findings": [], "notable_facts": [], "is_fallback": True}
    section = {"section_number": 1, "title": "T", "page_start": 1, "page_end": 2, "page_count": 2, "summary": summary, "subsections": [{"subsection_number": 1, "title": "U", "page_start": 1, "page_end": 2, "summary": summary}]}
    doc = {"file_path": "/a", "file_name": "a", "filetype": "pdf", "sections": [section], "chunks": [{"chunk_number": 0, "page_number": 1, "content": 'x "q"\nline', "embedding": [1.0, 2.0]}], "metrics": [{"metric_name": "m", "page_number": 1, "region_id": "r"}] * 2}
    made = flatten.tables(spark.createDataFrame([doc], flatten.DOCUMENT))
    counts = {name: df.count() for name, df in made.items()}
    assert counts["documents"] == counts["document_sections"] == counts["document_subsections"] == counts["document_chunks"] == counts["document_metrics"] == 1
    assert made["documents"].first().subsection_count == 1 and counts["document_keywords"] == 0
    chunks = made["document_chunks"].select("chunk_id", "content", "embedding", F.lit(None).cast("string").alias("nothing"), F.lit(True).alias("flag"))
    store.write_csv(chunks, str(tmp_path / "csv"))
    back = store.read_csv(spark, str(tmp_path / "csv"), chunks.schema).first()
    assert (back.content, list(back.embedding), back.nothing, back.flag) == ('x "q"\nline', [1.0, 2.0], None, True)
    root = str(tmp_path / "store")
    assert store.read_current(spark, root, "documents", made["documents"].schema).count() == 0
    store.publish(spark, {"documents": made["documents"]}, root, "001")
    store.publish(spark, {"documents": made["documents"].limit(0)}, root, "002")
    assert store.current_version(spark, root) == "002"
    store.publish(spark, {"documents": made["documents"]}, str(tmp_path / "other"), "9")
    store.publish(spark, {"documents": made["documents"]}, str(tmp_path / "other"), "10")
    assert store.current_version(spark, str(tmp_path / "other")) == "10"
    assert store.read_current(spark, root, "documents", made["documents"].schema).count() == 0


def test_discovery_stream(spark, tmp_path):
    from quillspark.streaming import discovery

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"1")
    query = discovery.new_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [(r.filetype, r.supported) for r in spark.table("found").collect()] == [("pdf", True)]


def test_expansion_against_brute_force(spark):
    chunks = [("d", i, i + 1, i // 4 + 1, (i % 4) // 2, 4, 2) for i in range(16)] + [("short", 0, 1, 1, 0, 1, 1), ("unknown", 0, 1, 1, 0, 1, 1)]
    df = spark.createDataFrame(chunks, "document string, chunk long, page long, section long, subsection long, section_pages long, subsection_pages long")
    documents = spark.createDataFrame([("d", 16), ("short", 1), ("unknown", None)], "document string, page_count long")
    seeds = spark.createDataFrame([("d", 2), ("d", 9), ("short", 0), ("unknown", 0)], "document string, chunk long")
    found = {(r.document, r.chunk): r.expansion_level for r in chunk_store.expanded(df, documents, seeds, full=3, section=3, subsection=3, around=1, gap=3).collect()}
    assert found == {("short", 0): "full", ("unknown", 0): "primary", ("d", 2): "subsection", ("d", 3): "subsection", ("d", 8): "neighbor", ("d", 9): "neighbor", ("d", 10): "neighbor"}


def test_schema_of_documents():
    assert T.StructType.fromDDL(flatten.DOCUMENT).fieldNames()[0] == "file_path"


def halves(text, most):
    """Parts of a text by definition: cut at the blank line nearest to the middle, the later one of two, until no part has too many words."""
    lines = [x for x in text.split("\n")]
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    if max(1, len(text.split())) <= most or len(lines) <= 1:
        return [text]
    middle = len(lines) // 2
    blank = [i for i in range(1, len(lines)) if not lines[i].strip()]
    cut = min(blank, key=lambda i: (abs(i - middle), -i)) if blank else middle
    parts = ["".join(lines[:cut]).rstrip(), "".join(lines[cut:]).rstrip()]
    return [found for part in parts if part.strip() for found in halves(part, most)]


def test_split_at_blank_lines_against_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = ["", "one line only", "a b c d e f", "a b\n\nc d\n\ne f\n"] + ["\n".join(rng.choice(["", " ", "w w w", "x y", "z " * 9]) for _ in range(n)) for n in (2, 3, 7, 30, 200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {}
    for r in structure.split_at_blank_lines(spark.createDataFrame([*rows, (99, None)], "id int, text string"), "text", 5).orderBy("id", "part").collect():
        found.setdefault(r.id, []).append(r.content)
    assert found == {i: halves(t, 5) for i, t in rows} | {99: [""]}


def test_pairs_of_a_row_shuffle_nothing_and_are_worked_out_once(spark):
    """Labels and values were put together again for each condition that names them, and each clause, card and cell was a row of its own, sorted and joined."""
    said = "Revenue: $5; revenue = $6, Cases at 7"
    cards = "  - Value: 9%\n- Revenue\n\n  - Trend: up\n  - Value: $1\n  - Value: $2\n- Total: x\n  - Value: 3%\nEnd\n  - Value: 4%\n- open share\n  - value : 5%\n- Empty"
    cells = [(3, 2, "$8"), (1, 1, "Note"), (2, 1, "Metric"), (2, 2, " Current value"), (3, 1, "Profit"), (4, 1, "Loss"), (5, 2, "$9"), (6, 1, "Narrative note"), (6, 2, "$1"), (7, 1, "revenue"), (7, 2, "$4")]
    df = spark.createDataFrame([(1, said, cards, cells), (None, said, None, None)], "id int, said string, cards string, cells array<struct<row:long,col:long,value:string>>")
    rows = lambda pairs: sorted((r.id or 0, r.label, r.value) for r in extraction.pair_rows(df, ["id"], pairs).collect())
    prose, listed, region = extraction.text_pairs(F.col("said")), extraction.bullet_pairs(F.col("cards")), extraction.region_pairs(F.col("cells"))
    assert rows(prose) == [(0, "Cases", "7"), (0, "Revenue", "$6"), (1, "Cases", "7"), (1, "Revenue", "$6")]
    assert rows(listed) == [(1, "Open share", "5%"), (1, "Revenue", "$1")]
    assert rows(region) == [(1, "Profit", "$8"), (1, "Revenue", "$4")]
    assert rows(extraction.region_pairs(F.col("cells"), search=1)) == []
    assert rows(extraction.merged_pairs([region, listed])) == [(1, "Open share", "5%"), (1, "Profit", "$8"), (1, "Revenue", "$1")]
    for found in (extraction.text_metrics(df, ["id"], "said"), extraction.bullet_metrics(df, ["id"], "cards")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan and plan.count("Generate") == 1


def test_texts_of_chunks_are_cut_before_they_move_and_not_sorted(spark):
    """Whole contents went through the sort of a merge join with their sections."""
    chunks = spark.createDataFrame([(1, 0, 2, "Body", "x" * 5000), (1, 1, 3, "Body", "y"), (1, 2, None, "Body", "z"), (1, 3, 2, "References", "-"), (1, 4, 2, None, "-")], "id int, chunk int, section int, section_name string, content string")
    sections = spark.createDataFrame([(1, 2, " about\n"), (1, 4, "other")], "id int, section int, overview string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = payloads.chunk_payloads(chunks, sections, ["id"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.chunk, r.section_title, r.section_overview, len(r.content)) for r in found.collect()) == [(0, "Body", "about", 4000), (1, "Body", "", 1), (2, "Body", "", 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Sort" not in plan and "3997" in plan.split("Exchange", 1)[1].split("Exchange")[0]


def test_chunks_of_groups_move_once(spark):
    """Chunks were shuffled for their turns, their groups, the names of sections and those of subsections, and these again to be joined."""
    rows = [(1, "a", 1, 0, 1, "", None, None, ""), (1, "a", 2, 1, 1, "S", None, None, "p"), (1, "b", 2, 2, 1, "T", 1, "U", "q"), (1, "", 3, 3, 2, "V", None, None, "r"), (1, "c", 4, 4, 2, "", 2, "", ""), (1, "b", None, 5, 1, None, 1, "W", "s"), (None, "d", 1, 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc int, chunk_id string, page int, chunk int, section int, section_name string, subsection int, subsection_name string, path string")
    found = retrieval.chunk_groups(df, ["doc"])
    got = {(r.doc, r.section, r.subsection): (r.section_name, r.subsection_name, r.path, r.level, r.place, r.chunk_ids) for r in found.collect()}
    assert got == {(1, 1, None): ("S", None, "s", "document_full", 1, ["a"]), (1, 1, 1): ("S", "W", "s", "subsection", 2, ["b"]), (1, 2, 2): ("V", None, None, "subsection", 3, ["c"]), (None, None, None): (None, None, None, "document_full", 1, ["d"])}
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def first_row_cells(spark):
    rows = [("a", 3, 1, "Name"), ("a", 3, 2, "Name"), ("a", 3, 3, " "), ("a", 4, 1, "x"), ("a", 4, 2, "y"), ("b", 7, 1, "only")]
    return spark.createDataFrame(rows, "t string, row long, col long, value string")


def test_column_names_without_a_window_over_the_cells(spark):
    named = tables.column_names(first_row_cells(spark), ["t"], F.col("t") == "b")
    assert sorted(tuple(r) for r in named.collect()) == [("a", 1, "Name_1"), ("a", 2, "Name_2"), ("a", 3, "C"), ("b", 1, "A")]
    assert "min(row" not in "".join(line for line in named._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition" in line)


def test_headed_cells_without_a_window_over_the_cells(spark):
    found = dense.headed(first_row_cells(spark), ["t"])
    assert sorted((r.t, r.row, r.col, r.value, r["name"]) for r in found.collect()) == [("a", 4, 1, "x", "Name"), ("a", 4, 2, "y", "Name")]
    assert "windowspecdefinition" not in found._jdf.queryExecution().optimizedPlan().toString()
