import re

import pytest

from glyphmill.parse import anvil
from glyphmill.queries import ORACLE_SQL, QUERIES, region_files

from .oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_its_sqls_rows(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_region_roundtrip_writes_every_part(spark):
    sf = "/root/testdata/sf0.1"
    found = [c.tree()["id"].value for r in region_files(spark, sf).collect() for c in anvil.read(bytes(r.content))]
    assert sorted(found) == sorted(r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect())
    same(QUERIES["region_roundtrip"](spark, sf), ORACLE_SQL["region_roundtrip"], sf)


def test_back_fills_broadcast_no_files(spark, sf):
    """Spark's estimate of a made region is 100 bytes, so it would broadcast all of them, or all their texts."""
    for name in ("region_backfill", "region_replaced", "pack_backfill", "archive_rewrite"):
        assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), name


def test_chunks_dont_carry_their_region(spark, sf):
    """Each row of a chunk had all bytes of its region until it was back in the JVM."""
    for name in ("region_chunks", "region_roundtrip"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        given = re.findall(r"MapInArrow .*?, \[([^\]]*)\], (?:true|false)", plan)
        assert given and "content" not in given[0] and "chunk_index" in given[0], name
