import random
import re
from collections import defaultdict

from glyphmill.llm import mixing
from glyphmill.llm.queries import ORACLE_SQL, QUERIES

from .oracle import same


def shares(sizes):
    """Targets by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_oracle(spark, sf):
    for d in (sf, sf.replace("0.001", "0.01")):
        same(QUERIES["op10_mix_sources"](spark, d), ORACLE_SQL["op10_mix_sources"], d)


def test_targets_and_takes(spark):
    r = random.Random(3)
    for trial in range(4):
        rows = [(i, " ".join("w" * r.randint(0, 40)), r.choice([None, "a", "B", "é", "zz", "", "hot", "hot", "hot"][: 3 + 2 * trial])) for i in range(3000)]
        rows += [(None, None, "nul"), (7, "x\ty", "nul"), (7, "x\ty", "nul")]
        docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, target int")
        out = mixing.with_copies(docs).collect()
        sizes, took = defaultdict(int), defaultdict(int)
        for _, text, source in rows:
            sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        expected = shares(sizes)
        assert len(out) == len(rows)
        for x in out:
            assert x.source_size == sizes[x.source] and abs(x.target - expected[x.source]) < 1e-6 * max(1, expected[x.source])
            assert x.copies <= 3
            took[x.source] += x.size * x.copies
        for s in sizes:
            if sizes[s] > 5000:
                assert abs(took[s] - expected[s]) < 0.15 * expected[s] + 50
        assert sorted(map(str, out)) == sorted(map(str, mixing.with_copies(docs.repartition(7)).collect()))
        assert mixing.mix_sources(docs).count() == sum(x.copies for x in out)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.with_copies(docs).collect() == []
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(x.size, x.target, x.copies) for x in mixing.with_copies(empty).collect()] == [(0, 0.0, 0)] * 2
