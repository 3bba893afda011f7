"""Connected components of a links table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import Workspace


def components(links: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node reachable.

    Every step is a partial aggregation and an equi-join over the links. The aggregate is written before
    it is joined, so a hub of any degree is pre-aggregated per task, and in the join, which has an exchange
    of the links to itself, AQE can split its links between tasks. Links are never gathered on
    the driver; each round is written to the shared folder. Null ends and loops are ignored.
    The number of rounds grows with the logarithm of a component's diameter.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, step = work.save(edges, f"{name}-0"), 0
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.save(large.where("u <> v").distinct(), f"{name}-large")
        lower = work.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-lower")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(lower, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v")
        edges, step = work.save(small.where("u <> v").distinct(), f"{name}-{step + 1}"), step + 1
        before, state = state, _state(edges)
        work.drop(f"{name}-{step - 1}", f"{name}-least", f"{name}-large", f"{name}-lower")
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges; it stays the same only when a round changes nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
