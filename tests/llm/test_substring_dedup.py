import hashlib
import random
import re

import pytest

import numpy as np

from glyphmill.llm import substring_dedup
from glyphmill.llm.queries import QUERIES
from glyphmill.llm.shared import complete_tables
from glyphmill.llm.substring_dedup import FingerprintIndex, cut_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    """(doc_id, kept words joined, words, removed) of each row."""
    first, out = {}, []
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in texts:
        for k in range(len(words) - n + 1) if i is not None else ():
            key = tuple(words[k : k + n])
            first[key] = min(first.get(key, i), i)
    for i, words in texts:
        gone = [False] * len(words)
        for k in range(len(words) - n + 1) if i is not None else ():
            if first[tuple(words[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, kept, len(words), sum(gone)))
    return out


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "日本", "a", "The", "the"]
    make = lambda k: [r.choice(words) for _ in range(k)]
    passages = [make(r.choice((12, 13, 14, 30, 60))) for _ in range(12)]
    rows, texts = [], []
    for i in range(n):
        text = make(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(text))
            text[at:at] = r.choice(passages)
        if texts and r.random() < 0.25:
            text = list(r.choice(texts))
            if text and r.random() < 0.6:
                text[r.randrange(len(text))] = r.choice(words)
        texts.append(text)
        rows.append((i * 3, "".join(w + r.choice((" ", "\n", "  ", "\t")) for w in text)))
    return rows


@pytest.mark.parametrize(("seed", "batches", "heavy"), [(1, 3, 48), (2, 5, 6), (3, 1, 2)])
def test_against_brute_force(spark, monkeypatch, seed, batches, heavy):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rows = corpus(seed) + [(None, corpus(seed)[5][1]), (33, "x " * 30), (33, corpus(seed)[7][1]), (901, None), (902, "x " * 30)]
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, n_words int, kept string").repartition(5)
    found = [tuple(r) for r in cut_repeats(docs, batches).collect()]
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, k, n, g in brute(rows))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op4_substring_dedup"](spark, sf).collect()) == expected
    assert any(g for _, _, g, _ in expected)


def test_no_rows(spark):
    assert cut_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("heavy", [48, 4])
def test_index_opens_again_and_takes_batches(spark, monkeypatch, tmp_path, heavy):
    """Each batch against all before it, each time through an index that is opened anew; one folder is left unfinished."""
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rows, root = corpus(4, 120), str(tmp_path / "index")
    expected = {i: g for i, _, _, g in brute(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    bounds, found = (0, 90, 180, 270, 360), {}
    for low, high in zip(bounds, bounds[1:]):
        (tmp_path / "index" / "run-77-77-4").mkdir(parents=True, exist_ok=True)
        index = FingerprintIndex(spark, root)
        assert len(index.runs) <= 2
        for r in index.add(docs.where(f"doc_id >= {low} and doc_id < {high}"), docs.where(f"doc_id < {low}")).collect():
            assert low <= r.doc_id < high
            found[r.doc_id] = sum(int(e - s) for s, e in np.frombuffer(r.spans, "<i4").reshape(-1, 2))
        index.close()
    assert found == {i: g for i, g in expected.items() if g}
    left = complete_tables(spark, root)
    assert sum(x.startswith("run-") for x in left) <= 2 and any(x.startswith("hot-") for x in left) == (heavy == 4)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


def test_words_that_powers_of_an_odd_base_confuse(spark):
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in cut_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}
