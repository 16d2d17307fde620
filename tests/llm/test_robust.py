"""Columns of any name in every stage, odd rows, and operators against independent versions."""

import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, chat, html_text, langid, lz, neardup, substring, toxicity
from tests.llm import brute

#: Names that the operators add or use inside, names with dots and backticks, and a map.
CLASHES = "lang_pred score kept n_words n_removed spans carried bucket is_text id size copies place mix_source ids decoded n_tokens component_id component n_shingles roles team row at c0 c1 turns rendered a.b x`y".split()


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)], F.create_map(F.lit("k"), "doc_id").alias("map"))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = {"en": "the of and this that with people house".split(), "fr": "le la les des une maison avec être".split()}
    rows = []
    for i in range(40):
        lang = ["en", "fr"][i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(60)), lang, "s", 0))
    rows += [(50, rows[0][1], "en", "s", 0), (50, rows[0][1], "en", "t", 0), (51, None, None, None, None), (52, "", "en", "s", 0), (53, "1 2 3", "en", "s", 0), (None, rows[1][1], "fr", "s", 0), (54, "y" * 200_000, "en", "s", 0)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)).cache()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_carry_any_column(spark, docs, name, stage):
    found = stage(spark, docs, "")
    assert found.columns == docs.columns
    at = {c: i for i, c in enumerate(docs.columns)}
    before = {r[at["doc_id"]]: r for r in docs.collect()}
    rows = found.collect()
    assert rows and all(r[at[c]] == before[r[at["doc_id"]]][at[c]] for r in rows for c in (*CLASHES, "map", "lang"))
    assert stage(spark, docs.limit(0), "").count() == 0


def test_last_stage_with_any_column(spark, docs):
    assert corpus_pipeline.bpe_stage(spark, docs, "").filter("not round_trip").count() == 0


def test_added_columns_replace_carried_ones(spark, docs):
    model = langid.fit(docs)
    found = langid.predicted(docs, model)
    assert found.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    assert found.filter("lang_pred = 'und'").count() == 3
    found = substring.dedup_passages(docs)
    assert found.columns[-4:] == ["n_words", "n_removed", "kept", "spans"] and len(set(found.columns)) == len(found.columns) == len(docs.columns) - 1
    assert bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json")).select("ids").count() == docs.count()
    assert toxicity.scored(docs, None).columns.count("score") == 1
    pages = docs.select("doc_id", F.col("text").alias("html"), *[F.col(f"`{c}`") for c in CLASHES if c != "x`y"])
    assert html_text.extracted(pages).count() == docs.count()
    said = docs.select("doc_id", F.col("text").alias("transcript"), "turns", "rendered", F.col("`a.b`"))
    assert chat.parsed(said, chat.tables({})).columns == ["doc_id", "a.b", "turns", "rendered"]


def test_long_unbroken_words(spark):
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(2_000_000))
    df = spark.createDataFrame([(1, word, "en", "s", len(word)), (2, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.bpe_stage(spark, df, "").filter("round_trip").count() == 2
    assert langid.recognised(df).count() == 2
    assert neardup.dedup(df).count() == substring.without_passages(df).count() == 2
    assert lz.fingerprint_report(df).count() == 2


def phrases_of(text):
    """LZ78 over words cut after 24 code points, from its definition: the longest known phrase and one more symbol."""
    symbols = [w[i : i + 24] for w in text.split() for i in range(0, len(w), 24)]
    known, at = set(), 0
    while at < len(symbols):
        n = 1
        while at + n <= len(symbols) and tuple(symbols[at : at + n]) in known:
            n += 1
        known.add(tuple(symbols[at : at + n]))
        at += n
    return known


def test_fingerprints_against_the_definition():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 40) for _ in range(n)) for n in (0, 1, 5, 60, 400, 3000)]
    prints = []
    for text in texts:
        hashes = sorted({xxhash.xxh32_intdigest(" ".join(p)) for p in phrases_of(text)})[:128]
        assert lz.fingerprint(text).tolist() == hashes
        prints.append(hashes)
    for a, x in zip(prints, texts):
        for b, y in zip(prints, texts):
            both = sorted(set(a) | set(b))[:128]
            want = float(a == b) if not a or not b else sum(h in a and h in b for h in both) / len(both)
            assert lz.likeness(lz.fingerprint(x), lz.fingerprint(y)) == pytest.approx(want)


def test_near_duplicate_recall_on_planted_pairs(spark):
    """Pairs just above the threshold: none of 400 may be lost, nor a clean text be linked."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(50_000)}" for _ in range(200)]
        changed = list(words)
        for at in rng.sample(range(10, 190, 14), 6):  # each change loses five shingles on either side: a similarity of 0.86
            changed[at] = f"v{rng.randrange(50_000)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    a, b = (brute.shingles(rows[i][1], 3) for i in (0, 1))
    assert 0.8 <= len(a & b) / len(a | b) <= 0.9
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=80).collect()
    assert {r.doc_id: r.component_id for r in found} == {r[0]: r[0] // 2 * 2 for r in rows}


STYLES = [
    "<body><div class='content with-sidebar'>{}</div></body>",
    "<body><div class='page has-header no-footer'><div class='header'><a href=a>Home</a></div>{}</div></body>",
    "<body><form id='aspnetForm'><nav><a href=a>Home</a></nav>{}<input><div id='footer'><p>foot</p></div></form></body>",
    "<body><header><h1>Site</h1></header><main>{}</main><footer><p>About us</p></footer></body>",
    "<body><div id=wrap><ul class='main-nav'><li><a href=x>One</a><li><a href=y>Two</a></ul><div class='post'>{}</div><aside><p>Read also this long teaser of another story</p></aside></div></body>",
    "<body><article>{}<section class='discussion-thread'><p>I disagree with all of this</p></section></article></body>",
    "<body><article>{}</article><div class='comment-list'><article class='comment'><p>First reader says something long enough to be text</p></article></div></body>",
    "<body><table><tr><td class='sidebar'><a href=x>Menu</a></td><td>{}</td></tr></table></body>",
    "<body><div class='cookie-notice'><p>We use cookies and ask you to agree to all of them</p></div><div>{}</div><script>var x = '<p>no</p>'</script></body>",
    "<body><section>{}</section><div class='ad-slot'><p>Buy this now, it is the best that you can buy</p></div><noscript><p>Enable scripts</p></noscript></body>",
]


@pytest.mark.parametrize("style", STYLES)
def test_page_styles(style):
    said = [f"Paragraph {i} says a good deal about the matter, and it goes on for a while so that it is prose &amp; nothing else." for i in range(6)]
    page = style.format("<h2>The title</h2>" + "".join(f"<p>{s}</p>" for s in said))
    assert html_text.main_text(page) == " ".join(["The title", *said]).replace("&amp;", "&")


def test_a_byline_is_text_and_furniture_alone_is_none():
    story = "".join(f"<p>{'A sentence of the story that goes on. ' * 4}</p>" for _ in range(3))
    assert "By A. Writer" in html_text.main_text(f"<article><header><h1>T</h1><p class='byline'>By A. Writer</p></header>{story}</article>")
    assert html_text.main_text(f"<body><footer>{story}</footer></body>") == html_text.main_text("<body><nav><a href=x>Home</a></nav><div class='footer'><p>short</p></div></body>") == ""


def test_arrow_batches_are_bounded(spark, docs):
    from quillspark.llm.arrow import BATCH_BYTES, in_batches

    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    long = docs.select(F.repeat("text", 2000).alias("text")).filter("text is not null").coalesce(1)
    rows = in_batches(long, sizes, "n long").collect()
    assert len(rows) > 1 and BATCH_BYTES == int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    assert np.array([r.n for r in rows]).sum() == long.count()
