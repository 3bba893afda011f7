"""Mixing sources to target weights, by repetition rates and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import Workspace, running

WEIGHTS, MOST = (5, 2, 1), 3
#: A table of sources up to this size is broadcast (about 100 bytes a row); a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000
_SIZE = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def source_rates(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, work: Workspace | None = None) -> DataFrame:
    """(source, source_size, target, rate) of every source.

    Sources by code point, null last, take the weights in turn and share 100 % of all sizes; none has
    more than ``most`` times its own size, and what it can't take goes to the others by weight. With
    sources in the order of most * size / weight, those capped are a prefix of it: with C the caps before
    a source and W the weights from it on, it is the first for which weight * (total - C) / W is within
    its cap. Places and sums before a source come from distributed sorts, so sources may be many.
    """
    work = work or Workspace(documents.sparkSession, "mix")
    sizes = documents.groupBy("source").agg(F.sum(F.expr(_SIZE)).cast("long").alias("source_size"))
    placed = running(sizes, work, "placed", [F.col("source").isNull(), F.col("source")], {})
    turn = "CASE " + " ".join(f"WHEN place % {len(weights)} = {k} THEN {w}" for k, w in enumerate(weights)) + " END"
    weighed = placed.selectExpr("source", "source_size", "place", f"CAST({turn} AS BIGINT) AS weight", f"{most} * source_size AS cap")
    summed = running(weighed.withColumnRenamed("place", "first"), work, "summed", [F.col("cap") / F.col("weight"), F.col("first")], {"before": "cap", "lighter": "weight"})
    whole = summed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all"))
    share = F.expr("CAST(total - before AS DOUBLE) / (all - lighter)")
    summed = work.save(summed.crossJoin(F.broadcast(whole)).withColumn("share", share), "shares")  # one row of totals
    free = summed.where("weight * share <= cap").agg(F.min(F.struct("place", "share")).alias("free"))
    target = F.expr("CASE WHEN free IS NULL OR place < free.place THEN CAST(cap AS DOUBLE) ELSE weight * free.share END")
    rates = summed.crossJoin(F.broadcast(free)).select("source", "source_size", target.alias("target"))
    return rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def with_copies(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The documents with size, source_size, target and copies.

    copies is floor(rate) and one more with the rate's fraction as its probability, drawn by the MD5 of
    seed and doc_id: reruns agree, and rows that share a doc_id (or have none) are drawn alike. A null
    text has size 0. A source without words has rate 0. Names that clash with documents' own columns
    replace those.
    """
    work = Workspace(documents.sparkSession, "mix")
    rates = source_rates(documents, weights, most, work)
    key = [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source")]
    rates = work.save(rates.select(*key, "source_size", "target", "rate"), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    plain = documents.drop("size", "source_size", "target", "rate", "copies", "_none", "_source")
    draw = f"CAST(conv(substring(md5(concat('{seed}|', coalesce(CAST(doc_id AS STRING), ''))), 1, 12), 16, 10) AS DOUBLE) / 281474976710656D"
    joined = plain.withColumns({"size": F.expr(_SIZE).cast("long"), "_none": key[0], "_source": key[1]}).join(rates, ["_none", "_source"])
    copies = F.floor("rate") + F.expr(f"{draw} < rate - floor(rate)").cast("long")
    return joined.withColumn("copies", copies.cast("long")).drop("_none", "_source", "rate")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The documents with all their columns, each row as often as the mix takes it."""
    rows = documents.select("doc_id", "text", "source", F.struct(*(documents[c] for c in documents.columns)).alias("row"))
    taken = with_copies(rows, weights, most, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


#: DuckDB SQL for the rows of op10.
ORACLE = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
placed AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sizes),
weighed AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, 3 * source_size AS cap FROM placed),
summed AS (
    SELECT *, sum(source_size) OVER () AS total,
           coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
           row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place) AS step FROM weighed),
free AS (SELECT step AS first, CAST(total - before AS DOUBLE) / rest AS share FROM summed
         WHERE weight * (CAST(total - before AS DOUBLE) / rest) <= cap ORDER BY step LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN first IS NULL OR step < first THEN CAST(cap AS DOUBLE) ELSE weight * share END AS target FROM summed LEFT JOIN free ON TRUE),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST(CAST('0x' || substring(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM docs JOIN rates ON docs.source IS NOT DISTINCT FROM rates.source
"""
