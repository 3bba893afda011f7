import hashlib
import random
import re

from glyphmill.llm import iblt
from glyphmill.llm.queries import QUERIES

UNIT = re.compile(r"(?:[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*){1,32}")


def units(text):
    return {u.rstrip(" ") for u in UNIT.findall(text or "")}


def near(x, y):
    x, y = units(x), units(y)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_likeness_is_that_of_the_sets(spark):
    r = random.Random(1)
    line = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 50)))
    pairs = [("", ""), (None, "a"), (None, None), ("a\nb", "b\na\n\na")]
    for size in (1, 5, 20, 60, 150):
        for share in (0, 0.3, 0.9, 1):
            both = [line() for _ in range(int(size * share))]
            pairs.append(("\n".join(both + [line() for _ in range(size - len(both))]), "\n".join(both + [line() for _ in range(size - len(both))])))
    rows = iblt.differences(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    for row in rows:
        assert abs(row.near - near(row.a, row.b)) < 1e-12
        assert (len(row.only_left), len(row.only_right)) == (len(units(row.a) - units(row.b)), len(units(row.b) - units(row.a)))


def test_recovered_digests_are_those_of_the_units_that_differ(spark):
    frame = spark.createDataFrame([("a\nb\nc d\ne", "b\nx\na\ny z", 1, 2)], "a string, b string, _a int, near int")
    row = iblt.differences(frame, "a", "b").first()
    digest = lambda u: spark.sql(f"SELECT xxhash64('{u}')").first()[0]
    assert row.only_left == sorted(map(digest, ("c d", "e"))) and row.only_right == sorted(map(digest, ("x", "y z")))
    assert row._a == 1 and abs(row.near - 2 / 6) < 1e-12


def test_long_texts_of_lines(spark):
    n = 10_000
    lines = [f"line {i}" for i in range(n)]
    edited = lines[:5] + [f"new {i}" for i in range(700)] + lines[900:]
    pairs = [("\n".join(lines), "\n".join(edited)), ("\n".join(lines), "\n".join(f"other {i}" for i in range(n)))]
    rows = iblt.differences(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert sorted((len(r.only_left), len(r.only_right)) for r in rows) == [(895, 700), (n, n)]


def test_base_sketch_peels_small_differences(spark):
    """Without retries: the differing digests come out of the fingerprint's own cells."""
    docs = spark.range(300).selectExpr("id", "transform(sequence(1, 40), i -> xxhash64(id, i)) AS a").selectExpr("id", "a", "concat(slice(a, 3, 38), array(xxhash64(id, -1), xxhash64(id, -2))) AS b")
    docs = docs.selectExpr("id", f"{iblt._sketch('a', '8')} AS s", f"{iblt._sketch('b', '8')} AS t")
    found = [r.d and (len(r.d.left), len(r.d.right)) for r in docs.selectExpr(f"{iblt._peeled(iblt._less('s', 't'), '8')} AS d").collect()]
    assert set(found) <= {(2, 2), None} and found.count((2, 2)) > 290


def test_expected_number_of_differences(spark):
    docs = spark.range(200).selectExpr("id", "transform(sequence(1, 400), i -> xxhash64(id, i)) AS a").selectExpr("a", "concat(slice(a, 101, 300), transform(sequence(1, 60), i -> xxhash64(id, -i))) AS b")
    docs = docs.selectExpr("a", "b", f"{iblt._less(iblt._sketch('a', '8'), iblt._sketch('b', '8'))} AS s")
    found = sorted(r.n for r in docs.selectExpr(f"{iblt._expected('s', 'a', 'b')} AS n").collect())
    assert 120 < found[100] < 200 and 60 < found[20] and found[180] < 300


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    frame = QUERIES["op7_iblt_fingerprints"](spark, sf)
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())
    rows, prints = frame.collect(), {}
    assert len(rows) == len(texts)
    for r in rows:
        text, other = texts[r.doc_id], texts[following[r.doc_id]]
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near(text, edited)) < 1e-12 and abs(r.near_next - near(text, other)) < 1e-12
        assert (r.removed.count(",") + bool(r.removed), r.added.count(",") + bool(r.added)) == (len(units(text) - units(edited)), len(units(edited) - units(text)))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(prints.values())) == len({frozenset(units(t)) for t in prints})


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "é" * 10, 6), (None, "abcdef", 7), (9, "x", 8), (9, "y " * 3000, 9)], "doc_id long, text string, n_chars int")
    rows = {(r.doc_id, r.n_chars): r for r in iblt.edited_fingerprints(docs).collect()}
    assert len(rows) == 5
    assert rows[2, 10].edited_sha256 == hashlib.sha256(("é" * 7).encode()).hexdigest()
    assert rows[9, 6000].edited_sha256 == hashlib.sha256(("y " * 2000 + "é" * 10).encode()).hexdigest()
    assert rows[1, 0].near_next == 0 and rows[1, 0].near_edited == 1 and rows[None, 6].near_next == 0
    assert iblt.edited_fingerprints(docs.limit(0)).collect() == []
    lone = iblt.edited_fingerprints(docs.where("doc_id = 2")).collect()
    assert [r.near_next for r in lone] == [1.0]
