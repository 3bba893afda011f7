import struct

import pandas as pd
from pyspark.sql import functions as F

from glyphmill.functions import text as fx
from glyphmill.functions import udfs
from glyphmill.parse import anvil


def test_exploded_hands_rows_on_in_pieces(spark):
    frame = spark.createDataFrame([(1, "a", 5000), (2, None, 3), (3, "c", 0)], "id long, t string, n int").coalesce(1)
    rows = udfs.exploded(frame, lambda t, n: ({"i": i, "x": None if i % 2 else [t]} for i in range(n)), "i int, x array<string>", "t", "n").collect()
    assert [(r.id, r.i) for r in rows] == [(1, i) for i in range(5000)] + [(2, i) for i in range(3)]
    assert rows[0].x == ["a"] and rows[1].x is None and rows[5000].x == [None] and rows[0].asDict().keys() == {"id", "t", "n", "i", "x"}
    assert udfs.exploded(frame.limit(0), lambda t: [{"i": 1}], "i int", "t").collect() == []


def test_found_ranges_against_find(spark):
    texts = [None, "", "aaa", "a.b.", "x\\Ey\\E", "日a本a", "$1 (a|b) $1"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for part in ("a", "aa", ".", "\\E", "$1", "(a|b)", ""):
        expected = []
        for i, t in enumerate(texts):
            at = (t or "").find(part) if part else -1
            while at >= 0:
                expected.append((i, at, at + len(part) - 1))
                at = t.find(part, at + len(part))
        assert sorted((r.id, r.start, r.end) for r in udfs.found_ranges(frame, "t", part).collect()) == expected, part


def test_paths_and_code_points(spark):
    paths = {"a/b": "a/b", "./a//b/": "a/b", "a/../b": "b", "..": None, "a/../../b": None, "": "", "a/b/../../c": "c"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", fx.normal_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == paths
    points = [0x41, 0x65E5, 0x1F600, 0xD800, 0x110000, -1]
    rows = spark.createDataFrame([(c,) for c in points], "c int").select("c", fx.code_point(F.col("c")).alias("s")).collect()
    assert [r.s for r in rows] == ["A", "日", "😀", None, None, None]


def test_chunk_places_are_those_of_the_writer(spark):
    chunks = [anvil.Chunk(i, anvil.PLAIN, b"x" * size, 0) for i, size in ((3, 10), (9, 5000), (1000, 70_000))]
    raw = anvil.write(chunks)
    entries = [e for e in struct.unpack_from(">1024I", raw) if e]
    frame = spark.createDataFrame([(e,) for e in entries], "e long")
    first, count = fx.chunk_place(F.col("e"))
    assert [tuple(r) for r in frame.select(first, count).collect()] == [(2, 1), (3, 2), (5, 18)]
    assert frame.agg(fx.necessary_sectors(F.col("e"))).first()[0] * anvil.SECTOR == len(raw)
    assert spark.createDataFrame([(0,)], "e long").agg(fx.necessary_sectors(F.col("e"))).first()[0] == 2


def test_exploded_leaves_columns_out(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, ""), (3, "c" * 100)], "k int, t string")
    found = udfs.exploded(frame, lambda t: ({"c": c} for c in t), "c string", "t", drop=["t"])
    assert found.columns == ["k", "c"]
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (1, "b"), *[(3, "c")] * 100]


def test_scalar_hands_large_values_on_in_pieces(spark, monkeypatch):
    values = ["a", None, "b" * 3, "c"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "i int, t string").coalesce(1)
    large = lambda t: t.encode() * udfs.PIECE
    found = frame.select("i", udfs.scalar(large, "binary", "t").alias("x")).selectExpr("i", "length(x) AS n", "decode(substring(x, 1, 1), 'UTF-8') AS c").collect()
    assert sorted(map(tuple, found)) == [(i, t and len(t) * udfs.PIECE, t and t[0]) for i, t in enumerate(values)]
    monkeypatch.setattr(udfs.F, "pandas_udf", lambda kind: lambda f: lambda *columns: f)
    pieces = udfs.scalar(large, "binary", "t")(iter([pd.Series(values)]))
    assert [len(x) for x in pieces] == [1, 2, 1, 0]
