import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, html_text, langid, lz, mixing, neardup, queries, substring, topk, toxicity
from tests.against import assert_same, database
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Nulls, empty and long texts, copies, near copies, repeated rows and ties."""
    rng = random.Random(5)
    base, shared = prose(rng, 80, 4000), prose(rng, 30, 4000)
    rows = [(0, base), (1, base), (2, base.replace("w1", "v1", 1)), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "One"), (8, "two words"), (9, "x" * 300_000), (10, prose(rng, 40_000, 30_000))]
    rows += [(20 + i, prose(rng, 20, 4000) + " " + shared + "\n" + prose(rng, 20, 4000)) for i in range(6)]
    rows += [(40, base + " tail"), (40, base + " tail"), (None, base), (41, shared + " " + shared)]
    return [(d, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).withColumns({"id": F.lit("clash"), "size": F.lit(1), "text2": F.lit(None).cast("string"), "carried": F.lit(2)}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), database(SF).sql(queries.SQL[name]))


def test_mixing(spark, docs, none):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].size == by[4].size == by[5].size == 0 and by[9].size == 1
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6 for r in rows)
    assert sum({(r.source_size, r.target) for r in rows} and [t for _, t in {(r.source_size, r.target) for r in rows}]) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_report(none).count() == mixing.mix(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 40)), "en", rng.choice("abc"), 0) for i in range(600)]
    found = mixing.mix_report(spark.createDataFrame(rows, DOCS)).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 20 for r in found)


def test_passages(docs, none):
    found = substring.dedup_passages(docs, window=13)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect())
    want = Counter((d, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)) for d, ws, gone in brute.passages([(r.doc_id, r.text) for r in docs.collect()], 13))
    assert got == want
    assert found.columns == [c for c in docs.columns if c != "text"] + ["n_words", "n_removed", "kept", "spans"]
    assert substring.dedup_passages(none).count() == 0


def test_passages_keep_the_layout(spark):
    passage = "\n".join(f"p{i}" for i in range(13))
    rows = spark.createDataFrame([(1, passage), (2, "start\t here\n" + passage + "  the\nend"), (3, "a  b\nc")], "doc_id long, text string")
    found = {r.doc_id: (r.kept, [tuple(s) for s in r.spans]) for r in substring.dedup_passages(rows, layout=True).collect()}
    assert found == {1: (passage, []), 2: ("start\t here the\nend", [(2, 15)]), 3: ("a  b\nc", [])}


def test_buckets_agree(spark):
    ids = [0, 1, -1, 5, (1 << 63) - 1, -(1 << 63), 123456789]
    got = [r.b for r in spark.createDataFrame([(i,) for i in ids], "i long").select(substring.bucket_column(F.col("i"), 97).alias("b")).collect()]
    assert got == substring.bucket_of(np.array(ids, np.int64), 97).tolist()


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.components(rows, k, percent)
    got = neardup.near_duplicates(docs, k, percent).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert neardup.near_duplicates(none).count() == 0


def test_a_family_without_a_centre(spark):
    """Near copies in a chain, each similar to its neighbours only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 200])) for i in range(17)] + [(100 + i, " ".join(f"z{i}-{j}" for j in range(50))) for i in range(5)]
    want = brute.components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want and len(set(want.values())) == 6


def test_rounds_settle_large_buckets(spark, monkeypatch):
    """With one hub at a time, the further rounds must find what the first one leaves."""
    monkeypatch.setattr(neardup, "HUBS", 1)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute.components(rows, 3, 85)


def test_dedup_keeps_one_of_each_group(docs):
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids
    assert {0} == {0, 1, 2, 40} & set(ids)


def test_sketches_fill_every_coordinate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sets = [np.unique(a[:900]), np.unique(a[100:]), a[:1], a[:5]]
    edges = np.cumsum([0, *map(len, sets)])
    found = neardup.sketches(np.concatenate(sets), edges)
    assert (found != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((found[0] == found[1]).mean() - 0.8) < 0.15


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 37 if i < 60 else i, [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    rows += [(100, None), (101, [1.0, float("nan")]), (102, [1.0, None]), (103, [float("inf")]), (104, []), (105, [0.0] * 6), (106, [1e30, -1e30]), (None, [0.5] * 6), (120, [0.5] * 9), (140, [0.5] * 6), (141, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]

    def whole(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        return [int(np.floor(min(max(64 * x, -(2.0**62)), 2.0**62))) for x in v]

    live = [(d, whole(v)) for d, v in rows if whole(v) is not None]
    want = Counter()
    for i, (q, x) in enumerate(live):
        if q is None or q % 20:
            continue
        scores = [(max(min(sum(a * b for a, b in zip(x, y)), (1 << 63) - 1), -(1 << 63)), d) for j, (d, y) in enumerate(live) if j != i]
        best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:5]
        want.update((q, rank, d, s) for rank, (s, d) in enumerate(best, 1))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_in_sparse_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_ROWS", 30)
    rng = np.random.default_rng(3)
    matrix = (rng.random((400, 30)) < 0.1) * rng.integers(1, 50, (400, 30))
    index = topk.Index(matrix.astype(np.int64), np.arange(400))
    for q in range(0, 400, 7):
        rows, scores = index.best(matrix[q].astype(np.int64), 10, q)
        every = matrix @ matrix[q]
        want = sorted((-int(every[i]), i) for i in range(400) if i != q)[:10]
        assert [(-int(s), int(r)) for r, s in zip(rows, scores)] == want


def test_top_k_with_terms_that_lower_scores():
    a, b, c = [10, *[0] * 8, -10], [9, *[0] * 8, 0], [0, *[1] * 8, 0]
    index = topk.Index(np.array([a] * 20 + [b] * 20 + [c]), np.arange(41))
    rows, scores = index.best(np.array([10, *[1] * 8, 5]), 20, -1)
    assert list(rows) == list(range(20, 40)) and set(scores) == {90}
    rng = np.random.default_rng(4)
    for n in range(60):
        sign = np.where(rng.random(40) < 0.4, -1, 1)
        matrix = (rng.random((300, 40)) < rng.choice([0.1, 0.5])) * rng.integers(1, 60, (300, 40)) * sign * np.where(np.arange(40) < 3, 20, 1) * (1 << 50 if n % 5 == 0 else 1)
        query = rng.integers(0, 30, 40) * (np.arange(40) < 3) * 20 + rng.integers(0, 4, 40)
        rows, scores = topk.Index(matrix, np.arange(300)).best(query, 10, -1)
        want = sorted((-int(x), i) for i, x in enumerate(matrix.astype(object) @ query.astype(object)))[:10]
        assert [(-int(s), int(r)) for r, s in zip(rows, scores)] == want


PAGES = {
    "": "",
    "<p>": "",
    "plain &amp; text": "plain & text",
    "<article><h1>T</h1><p>One <b>bo</b>ld.<br>Two<p>Three</article><footer>f</footer>": "T One bold. Two Three",
    "<nav><a href=x>Home</a><a href=y>News</a></nav><article><p>Body&nbsp;text&eacute;.</p><div class=\"comments\"><p>I disagree</p></div></article>": "Body texté.",
    "<script>var a='<p>no</p>';</script><main><p>Yes &lt;b&gt;</p><aside>see also</aside></main>": "Yes <b>",
    "<article><p>Open text<script>never closed <p>gone": "Open text",
}


def test_html(spark):
    rows = [(i, "u", html) for i, html in enumerate([*PAGES, None])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.page_texts(df).collect()}
    assert got == {i: (text, len(text)) for i, text in enumerate([*PAGES.values(), ""])}
    assert html_text.page_texts(df.limit(0)).count() == 0


def test_html_without_an_article():
    body = "".join(f"<p>{'A sentence of the story that goes on for a while. ' * 4}</p>" for _ in range(5))
    page = f"<body><div id='header'><a href=a>Home</a></div><ul class='menu'>{'<li><a href=x>Link</a></li>' * 9}</ul><div id='c'><h2>Title</h2>{body}<p>Short.</p></div><div class='sidebar'><p>{'word ' * 80}</p></div><div>© 2024</div></body>"
    text = html_text.main_text(page)
    assert text.startswith("Title A sentence") and text.endswith("Short.") and text.count("A sentence") == 20
    assert len(html_text.main_text("<article>" + "<p>x y</p>" * 50_000 + "</article>")) == 4 * 50_000 - 1


def test_html_keeps_all_content_of_a_page():
    story = [f"<p>{i} {'a sentence of the story that goes on for a while ' * 4}</p>" for i in range(20)]
    numbers = lambda page: [int(w) for w in html_text.main_text(page).split() if w.isdigit()]
    assert numbers(f"<body><div>{''.join(story[:17])}</div><div>{''.join(story[17:])}</div></body>") == list(range(20))
    assert numbers(f"<body><div>{''.join(story[:17])}</div><div><div>{story[17]}</div><div>{story[18]}</div></div>{story[19]}</body>") == list(range(20))
    linked = f"<p>100 <a href=x>{'words of a link ' * 9}</a></p>"
    assert numbers(f"<body><div>{''.join(story[:9])}{linked}{''.join(story[9:])}</div></body>") == [*range(9), 100, *range(9, 20)]
    text = html_text.main_text(f"<article><section class='post-header'><h1>Name</h1></section>{''.join(story)}<h2 id='related-work'>Works</h2><p class='toc'>End</p></article>")
    assert text.startswith("Name 0 a") and text.endswith("Works End")


def test_language(spark, docs, none):
    words = {"en": "the of and this that with people house".split(), "fr": "le la les des une maison avec être".split(), "de": "der die das und nicht eine haus schön".split()}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "s", 0) for i, lang in enumerate(list(words) * 60)]
    train = spark.createDataFrame(rows, DOCS)
    model = langid.fit(train)
    cases = [(1, "The people, of this house!", "en"), (2, "LES MAISONS DES", "fr"), (3, "schöne häuser", "de"), (4, "", "und"), (5, None, "und"), (6, "123 -- ½", "und"), (7, "das " * 50_000 + "the", "de")]
    df = spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id long, text string").withColumn("score2", F.lit(1)).withColumn("lang", F.lit("xx"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(df, model).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: want for i, _, want in cases}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[4][1] == 0
    report = langid.language_report(train)
    joined = report.join(train, "doc_id")
    assert joined.filter("held_out and lang <> lang_pred").count() == 0 and joined.filter("held_out").count() > 20
    assert langid.language_report(docs).count() == docs.count()
    assert langid.language_report(none).count() == 0
    assert {r.lang_pred for r in langid.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.recognised(docs).columns == docs.columns


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    extra = [(200, "a  b \n\n c\t <|endoftext|>d's we'll", "en", "s", 0), (201, "é́ 中文 \U0001f600 ½Ⅷ ​ x\x1c y\x85z  ", "en", "s", 0), (202, "-=" * 5000, "en", "s", 0), (203, " " * 3000 + "x", "en", "s", 0)]
    rows = docs.select(*DOCS.replace(" long", "").replace(" string", "").split(", "), "id").unionByName(spark.createDataFrame(extra, DOCS).withColumn("id", F.lit("x")))
    got = Counter(tuple(r) for r in bpe.token_report(rows, TOKENIZER).collect())
    want = Counter()
    for r in rows.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.token_report(none, TOKENIZER).count() == 0
    assert bpe.tokenized(docs, TOKENIZER).columns == [*docs.columns, "ids", "decoded"]


def test_bpe_in_portions():
    with open(TOKENIZER, "rb") as file:
        tables = bpe.Bpe(file.read())
    rng = random.Random(6)
    for _ in range(20):
        piece = "".join(rng.choice("aeiourstnlé") for _ in range(3000)).encode()
        portions = [piece[i : i + 7] for i in range(0, len(piece), 7)]
        machine = bpe.Transducer(tables)
        found = [i for p in portions for i in machine.feed(p)] + machine.finish()
        assert found == np.frombuffer(tables.alone(piece), np.int32).tolist() == np.frombuffer(tables.abreast([piece, b"x"])[0], np.int32).tolist()
        machine = bpe.Transducer(tables)
        for p in portions:
            machine.feed(p)
            assert len(machine.last) < 40 * tables.lookahead  # what is kept doesn't grow with the piece
    decoder = bpe.Decoder(tables)
    ids = np.frombuffer(tables.encode(["hé \U0001f600!"])[0], np.int32).tolist()
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], True) == "hé \U0001f600!"
    assert bpe.decode(tables, np.array([tables.ids[b"\xf0"], tables.ids[b"a"]])) == "�a"


def test_fingerprints(spark, docs, none):
    report = lz.fingerprint_report(docs)
    got = report.collect()
    ordered = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want = Counter()
    for (d, t), (_, following) in zip(ordered, [*ordered[1:], ordered[0]]):
        t, following = t or "", following or ""
        n = len(t) // 2
        edited = t[: len(t) - n] + following[:n]
        prints = [lz.fingerprint(x) for x in (t, edited, following)]
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[0].tobytes().hex(), round(lz.likeness(prints[0], prints[1]), 9), round(lz.likeness(prints[0], prints[2]), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert lz.fingerprint_report(none).count() == 0
    single = lz.fingerprint_report(docs.filter("doc_id = 0")).first()
    assert single.near_next == 1.0
    column = {r.doc_id: r.fingerprint for r in lz.fingerprints(docs.filter("doc_id in (0, 1, 3)")).collect()}
    assert column[0] == column[1] != column[3] == ""


def test_likeness_follows_the_phrases():
    rng = random.Random(8)
    a, b = prose(rng, 3000, 2000), prose(rng, 3000, 2000)
    half = a[: len(a) // 2] + b[: len(a) // 2]
    near, far = lz.likeness(lz.fingerprint(a), lz.fingerprint(half)), lz.likeness(lz.fingerprint(a), lz.fingerprint(b))
    assert 0 <= far < near < 1 and lz.likeness(lz.fingerprint(a), lz.fingerprint(a)) == 1


def toxic_corpus(n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(500)}" for _ in range(rng.randrange(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["numbskull", "dimwit", "vermin", "kroolast", "kroolix", "kroolum"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs, none):
    rows, labels = toxic_corpus()
    df, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.toxicity_report(df, known).join(known, "doc_id").filter("held_out").collect()
    assert len(found) > 80 and all(r.predicted == r.toxic for r in found)
    model = toxicity.fit(df, known)
    assert "dimwit" in model.lexicon.words and "krool" in " ".join(model.lexicon.stems)
    matcher = toxicity.Matcher(model.lexicon)
    assert [np.sign(matcher.add(w)) for w in ("numbskull", "numbskul,", "nunbskull", "\"dimwit\"", "hello", "", "d1mwit", "kroolish")] == [1, -1, -1, 1, 0, 0, -1, 1]
    plain, quoted = matcher.features("you are a dimwit and that is all"), matcher.features('he said "what a dimwit" and left')
    assert plain[0] > quoted[0] and quoted[2] > 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000 + "dimwit vermin dimwit")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    scores = {r.doc_id: r.score for r in toxicity.scored(odd, model).collect()}
    assert scores[1] == scores[2] < 0.3 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.toxicity_report(none, known).count() == 0
    assert {r.score for r in toxicity.toxicity_report(docs, known.limit(0)).collect()} == {0.0}


def test_a_dense_passage_counts_wherever_it_stands():
    matcher = toxicity.Matcher(toxicity.Lexicon({"dimwit": 1.0}, {}))
    gap, scattered, passage = "plain " * 20, ("dimwit " + "plain " * 20) * 250, "dimwit " * 8
    first, last = matcher.features(passage + gap + scattered), matcher.features(scattered + gap + passage)
    assert first == last and first[3] == np.log(1 + 8)
    mixed = "".join(random.Random(2).choices(["dimwit ", "plain "], [1, 3], k=3000)).split()
    at = [i for i, w in enumerate(mixed) if w == "dimwit"]
    assert matcher.features(" ".join(mixed))[3] == np.log(1 + max(sum(i <= j <= i + toxicity.WINDOW for j in at) for i in at))


def edit_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_automaton_against_edit_distances():
    terms, stems = ["scum", "idiot", "moron", "worthless", "disgusting"], ["lostra", "veju"]
    automaton = toxicity.Automaton(toxicity.Lexicon(dict.fromkeys(terms, 1.0), dict.fromkeys(stems, 1.0)))
    rng = random.Random(10)
    for _ in range(3000):
        word = list(rng.choice(terms + stems) + rng.choice(["", "", "x", "ing"]))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randrange(2)] = rng.choice(["", "a", "z"])
        word = "".join(word)
        near = [d for t in terms if (d := edit_distance(word, t)) <= toxicity.edits_allowed(t)]
        near += [d for s in stems if (d := min(edit_distance(word[:n], s) for n in range(len(word) + 1))) <= toxicity.edits_allowed(s)]
        assert automaton.edits(word) == min(near, default=-1), word


def test_chat(spark):
    text = "System: be brief\nUser: hi\nhow are you?\n### Assistant\nFine.\n\n[user] ok\n<|im_start|>assistant bye<|im_end|>"
    model = chat.tables({})
    assert chat.turns(model, text) == [("system", "be brief"), ("user", "hi\nhow are you?"), ("assistant", "Fine."), ("user", "ok"), ("assistant", "bye")]
    assert chat.turns(model, None) == chat.turns(model, "") == [] and chat.render([]) == ""
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "User: " + "long line\n" * 5000)], "conv_id long, transcript string").withColumn("role", F.lit("clash"))
    found = {r.conv_id: r for r in chat.parsed(df, model).collect()}
    assert len(found[1].turns) == 5 and found[2].rendered == found[3].rendered == "" and len(found[4].turns) == 1
    assert chat.render([("user", "a")]) == "<|user|>\na\n<|end|>\n"


def test_viterbi_against_all_paths():
    from itertools import product

    model = chat.tables({("move", 1, 4): 5, ("ending", 3, 1): 7})
    lines = ["User: a?", "b", "c.", "Bot: d"]
    seen = chat.observe(lines)
    emit = sum(t[:, seen[:, i]] for i, t in enumerate(model.emit)).T

    def score(path):
        return model.begin[path[0]] + emit[0][path[0]] + sum(model.move[a, b] + emit[i][b] for i, (a, b) in enumerate(zip(path, path[1:]), 1))

    best = max(product(range(chat.STATES), repeat=4), key=score)
    assert score(tuple(model.roles(lines))) == pytest.approx(score(best))


def test_conversations(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(6)] + [(2, 0, None, "x"), (2, 1, "user", None), (3, None, "user", "y"), (4, 0, "user", "z"), (4, 0, "user", "z"), (None, 0, "user", "a"), (None, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    rows = chat.chat_report(df).collect()
    found = {r.conv_id: r for r in rows}
    assert set(found) == {1, 2, 3, 4, None} and found[1].n_turns == 6 and found[4].n_turns == 1 and len(rows) == 6
    assert found[2].n_turns == 2 and found[3].n_turns == 1  # a null role, a null text and a null turn have turns too
    assert sum(r.n_turns for r in rows) == df.select("conv_id", "turn", "role", "text").distinct().count()
    assert chat.chat_report(df.limit(0)).count() == 0


def test_automaton_forgets(monkeypatch):
    lexicon = toxicity.Lexicon({"nasty": 1.0, "horrible": 1.0}, {"scum": 0.5})
    words = ["nasty", "nasti", "horible", "horrrible", "scummy", "scam", "kind", "", "naste", "nasty"]
    want = [toxicity.Automaton(lexicon).edits(w) for w in words]
    monkeypatch.setattr(toxicity, "KEPT_STATES", 1)
    automaton = toxicity.Automaton(lexicon)
    assert [automaton.edits(w) for w in words] == want
    assert len(automaton.states) < 50
