import bisect
import math
import zlib

import numpy as np
import pytest

from glyphmill.llm import quality, toxicity
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("name", "label", "threshold", "least", "right"), [("op3_toxicity", "toxic", 0.5, 0.97, 0.97), ("op6_quality", "quality", 0.3, 0.95, 0.93)])
def test_held_out_accuracy(spark, name, label, threshold, least, right):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    kept = [r for r in rows if r.held_out and r.doc_id in labels]
    y, score = np.array([labels[r.doc_id] for r in kept]), np.array([r.score for r in kept])
    print(name, auc(score, y), ((score >= threshold) == y).mean())
    assert auc(score, y) > least and ((score >= threshold) == y).mean() > right


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_edges(spark, module, label):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "", 2.0), (None, "abc", 0.0), (3, "word " * 50_000, 0.0)], "doc_id long, text string, score double")
    score = getattr(module, f"{label if label == 'quality' else 'toxicity'}_scores")
    schema = f"doc_id long, {label} int"
    for labels in ([], [(1, 1), (2, None)], [(i, i % 2) for i in range(6)] + [(3, 0), (None, 1)]):
        rows = score(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert score(docs.limit(0), spark.createDataFrame([(1, 1)], schema)).collect() == []


def test_held_out_labels_have_no_part(spark):
    docs = spark.createDataFrame([(i, f"{'vile scum ' if i % 3 == 0 else ''}text number {i} of the fixture") for i in range(200)], "doc_id long, text string")
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)]
    plain = [(i, int(i % 3 == 0)) for i in range(200)]
    turned = [(i, 1 - y if out[i] else y) for i, y in plain]
    one, two = (toxicity.toxicity_scores(docs, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect() for x in (plain, turned))
    assert one == two
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in one)


def test_bounded_sample_keeps_the_class_shares(spark, monkeypatch):
    """Borderline texts, a quarter of them toxic, score a quarter however few of each class are learnt from."""
    docs = spark.createDataFrame([(i, "grey borderline words" if i % 5 == 0 else "plain usual talk") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(2000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "POSITIVE", 60)
    monkeypatch.setattr(toxicity, "NEGATIVE", 120)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert not any(r.predicted for r in rows)
    grey, plain = ({round(r.score, 6) for r in rows if (r.doc_id % 5 == 0) == x} for x in (True, False))
    assert len(grey) == len(plain) == 1 and 0.15 < min(grey) < 0.4 and max(plain) < 0.05


def slow_cells(text):
    """The n-grams' cells in whole numbers, one by one."""
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & mask
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    salt = mixed(mixed((0x9E3779B97F4A7C15 + 11) & mask))
    chars, out = [], set()
    for c in f" {text.lower()} ":
        c = " " if ord(c) < 128 and not c.isalnum() else c
        if not (c == " " and chars and chars[-1] == " "):
            chars.append(c)
    for n in toxicity.ORDERS:
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + mixed(ord(c) + salt & mask)) & mask
            out.add(mixed(h) >> 64 - toxicity.BITS)
    return out


def test_toxicity_scores_by_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    weights = dict(zip(model.cells.tolist(), model.weights.tolist()))
    for r in toxicity.with_scores(docs.where("length(text) < 3000"), model).collect():
        logit = model.bias + sum(weights.get(c, 0.0) for c in slow_cells(r.text or ""))
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-6


def test_quality_scores_by_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    for r in quality.with_scores(docs, model).collect():
        x = quality.features(r.text)
        logit = model.bias + sum(t[bisect.bisect_right(e.tolist(), v)] for v, e, t in zip(x, model.edges, model.tables))
        logit += sum(t[bisect.bisect_right(model.coarse[i].tolist(), x[i]), bisect.bisect_right(model.coarse[j].tolist(), x[j])] for i, j, t in model.pairs)
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-9
        words = (r.text or "").split()
        if words:
            own = dict(zip(quality.FEATURES, x))
            assert own["mean_word"] == sum(map(len, words)) / len(words) and own["digits"] == sum(c in "0123456789" for c in r.text) / len(r.text)
            assert own["distinct_words"] == len({w.lower() for w in words}) / len(words) and own["pipes"] == r.text.count("|") / len(words)


def test_texts_to_learn_from_are_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * 1000) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    whole = toxicity.labelled_sample(docs, labels, "toxic", {1: 1000, 0: 1000})
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 50_000)
    rows = toxicity.labelled_sample(docs, labels, "toxic", {1: 1000, 0: 1000})
    assert 45 <= len(rows) < 50 < len(whole) and rows["text"].tolist() == whole["text"].tolist()[: len(rows)]
    for y in (0, 1):
        assert abs((rows["y"] == y).sum() - rows[rows["y"] == y]["share"].iloc[0] * (whole["y"] == y).sum()) < 1e-9
    assert set(whole["share"]) == {1.0}


def test_lookup_tables_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert model.pairs[0][:2] == (1, 0)
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
