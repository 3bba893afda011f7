import random
import re
from itertools import combinations

import pytest

from glyphmill.llm import ngram_join
from glyphmill.llm.ngram_join import similar_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows, n, p, q):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and q * len(x & y) >= p * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, groups=25):
    """Families of near copies around the threshold, chains of edits, short texts and shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeABé") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(30)]
    texts = ["", None, " \n", "one", "ONE", "one two", "One Two three four", "one two three four"]
    for g in range(groups):
        base = [word() for _ in range(r.choice((3, 6, 12, 30, 80, 300)))]
        if g % 3 == 0:
            base[2:2] = passage
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            edited = list(base)
            for _ in range(max(1, int(len(base) * r.choice((0.005, 0.01, 0.02, 0.03, 0.05))))):
                edited[r.randrange(len(edited))] = word()
            texts.append("\n".join(edited) if r.random() < 0.5 else " ".join(edited))
            if r.random() < 0.5:
                base = edited
    r.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "n", "p", "q", "heavy"), [(1, 4, 85, 100, 48), (2, 5, 4, 5, 48), (3, 4, 85, 100, 2), (4, 2, 7, 10, 3)])
def test_against_brute_force(spark, monkeypatch, seed, n, p, q, heavy):
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, size string, key int").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, n, p, q).collect()}
    assert found == brute(rows, n, p, q)


def test_sf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, 4, 85, 100).collect()}
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85, 100)


def test_signatures_lose_no_pair():
    """Every similar pair shares a key, whatever is heavy."""
    import numpy as np

    from glyphmill.llm.arrays import U

    r = random.Random(5)
    scheme = ngram_join.Scheme(4, 85, 100)
    for trial in range(300):
        size = r.choice((6, 9, 20, 60, 200))
        x = {r.getrandbits(64) for _ in range(size)}
        y = set(x)
        while True:
            z = set(y)
            z.discard(r.choice(sorted(z))) if r.random() < 0.6 else z.add(r.getrandbits(64))
            if 100 * len(x & z) < 85 * len(x | z):
                break
            y = z
        both = [np.array(sorted(s), U) for s in (x, y)]
        tokens, first = np.concatenate(both), np.cumsum([0, len(x), len(y)])
        _, keys = ngram_join._keys(tokens, first, scheme, np.zeros(0, U))
        heavy = np.sort(np.array(r.sample(keys.tolist(), int(len(keys) * r.choice((0, 0.1, 0.5)))), U))
        rows, keys = ngram_join._keys(tokens, first, scheme, heavy)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()), trial


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert similar_groups(spark.createDataFrame([], schema)).collect() == []
    rows = similar_groups(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (5, "x")], schema)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("3", 3), ("5", 3), ("5", 3), ("None", None)]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 1, 0, 3), (0, 2, 3, 1)])
def test_null_id_stands_for_no_set(spark, order):
    """A null id, an equal set and a near one in one task, whichever comes first."""
    words = [f"w{i}" for i in range(60)]
    base, near = " ".join(words), " ".join(words[:-1])
    rows = [(None, base), (None, base), (7, base), (8, near)]
    docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").coalesce(1)
    found = sorted((str(r.doc_id), r.component_id) for r in similar_groups(docs, 5, 4, 5).collect())
    assert found == [("7", 7), ("8", 7), ("None", None), ("None", None)]
