import corpus_pipeline
import sentencepiece
from glyphmill.llm import mixing, secrets_scan, toxicity
from glyphmill.llm.sentencepiece_tok import MODEL

from .test_ngram_join import brute
from .test_secrets import base


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, sf)
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    before = docs.collect()
    assert sorted(kept.collect()) == sorted(r for r in before if scores[r.doc_id] < 0.5)
    assert kept.columns == docs.columns

    one = stages["near copies"](spark, docs, sf)
    groups = brute([(r.doc_id, r.text) for r in before], 5, 4, 5)
    assert sorted(one.collect()) == sorted(r for r in before if groups[r.doc_id][1] == r.doc_id)

    clean = {r.doc_id: r for r in stages["secrets"](spark, docs, sf).collect()}
    assert len(clean) == len(before)
    for r in before:
        spans = secrets_scan.scan(r.text)
        assert (clean[r.doc_id].text == r.text) == (not spans)
        assert not base(clean[r.doc_id].text) and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)

    copies = {r.doc_id: r.copies for r in mixing.with_copies(docs).collect()}
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns
    assert sorted(mixed.collect()) == sorted(r for r in before for _ in range(copies[r.doc_id]))

    other = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in before}
    for r in stages["sentencepiece"](spark, docs, sf).collect():
        assert r.ids == other.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]
    assert out.count() > 100 and out.where("not round_trip").count() == 0


def test_stages_keep_extra_columns_nulls_and_repeated_rows(spark, sf):
    rows = [(1, None, "en", "a", 0, 1.5, "s"), (2, "", "en", None, 0, 2.5, "t"), (None, "some words here", None, "a", 15, 3.5, "u"), (3, "one two three four five six", "en", "a", 27, 4.5, "v"), (3, "one two three four five six", "en", "a", 27, 4.5, "v"), (4, "one two three four five six", "de", "b", 27, 5.5, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, size string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        found = {tuple(r) for r in out.collect()}
        assert found <= set(rows), name
        if name == "near copies":
            assert found == set(rows) - {rows[5]} and out.count() == 5
        if name in ("toxicity", "secrets"):
            assert found == set(rows) and out.count() == 6
        assert stage(spark, docs.limit(0), sf).collect() == []
    assert corpus_pipeline.tokenize(spark, docs, sf).count() == 6
