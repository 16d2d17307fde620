import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
    before, after = seen["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, after = seen["near_dedup"]
    want = brute.components([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == set(want.values())
    before, after = seen["substring_dedup"]
    kept = {d: [w for w, g in zip(ws, gone) if not g] for d, ws, gone in brute.passages([(r.doc_id, r.text) for r in before], 13)}
    assert {r.doc_id: brute.WORD.findall(r.text) for r in after} == kept
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["mixing"]
    words = lambda rows: sum(len(brute.WORD.findall(r.text)) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)
    before, after = seen["bpe"]
    assert len(after) == len(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
