import random

import pytest

from glyphmill.llm.components import components
from glyphmill.llm.shared import Workspace


def brute(links):
    root = {x: x for ab in links for x in ab if None not in ab and ab[0] != ab[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a in root and b in root and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graph(kind):
    r = random.Random(7)
    if kind == "path":
        order = list(range(200))
        r.shuffle(order)
        return list(zip(order, order[1:]))
    if kind == "star":
        return [(500, i) for i in range(300)] + [(i, 500) for i in range(0, 300, 7)]
    if kind == "sparse":
        return [(r.randrange(400), r.randrange(400)) for _ in range(300)]
    return [(1, 1), (None, 2), (3, None), (4, 5), (4, 5), (5, 4), (-7, 4), (2**60, 9)]


@pytest.mark.parametrize("kind", ["path", "star", "sparse", "edges"])
def test_against_union_find(spark, kind):
    links = graph(kind)
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    found = components(frame, Workspace(spark, "test"), "cc").collect()
    assert {r.node: r.component for r in found} == brute([x for x in links if None not in x]) and len(found) == len({r.node for r in found})


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).collect() == []
