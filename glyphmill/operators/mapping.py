"""Mappings source -> target, where a null target says "known, not to be translated" and a missing key "unknown"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(leaves: DataFrame, mapping: DataFrame, text: str = "content") -> DataFrame:
    """Leaves with a replacement; those without a target go. The smaller side is broadcast by its measured size."""
    to = mapping.where(F.col("target").isNotNull()).select(F.col("source").alias(text), F.col("target").alias("replacement"))
    return leaves.join(to, text)


def replace_all(leaves: DataFrame, replacement: str = '"TEXT"') -> DataFrame:
    """Every text replaced by a constant."""
    return leaves.withColumn("replacement", F.lit(replacement))


def merged(*mappings: DataFrame) -> DataFrame:
    """One mapping of several, the later ones winning, also with a null target."""
    tagged = [m.select("source", F.struct(F.lit(i).alias("rank"), F.col("target")).alias("v")) for i, m in enumerate(mappings)]
    return reduce(DataFrame.unionByName, tagged).groupBy("source").agg(F.max_by("v", F.col("v.rank")).alias("v")).select("source", F.col("v.target").alias("target"))


def counts(pool: DataFrame, mapping: DataFrame, *keys: str) -> DataFrame:
    """translated, untranslatable and missing texts of a pool, by its key columns."""
    joined = pool.join(mapping.select(F.col("source").alias("text"), "target", F.lit(True).alias("known")), "text", "left")
    return joined.groupBy(*keys).agg(
        F.count_if(F.col("target").isNotNull()).alias("translated"),
        F.count_if(F.col("known") & F.col("target").isNull()).alias("untranslatable"),
        F.count_if(F.col("known").isNull()).alias("missing"),
    )


def language_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """From two (ord, key, value) language tables: source's text of each of target's keys (or the key itself) -> target's text; the last key of equal texts wins."""
    joined = target.join(source.select("key", F.col("value").alias("own")), "key", "left").select(F.coalesce("own", "key").alias("source"), F.col("value").alias("target"), "ord")
    return joined.groupBy("source").agg(F.max_by("target", "ord").alias("target"))


def last_group_per_path(groups: DataFrame) -> DataFrame:
    """Of replacement groups (source, path, ord, ...) with one path, the last."""
    w = Window.partitionBy("source", "path").orderBy(F.desc("ord"))
    return groups.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlapping(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans (start, end; closed) that begin before the one before them in their file ends."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return spans.withColumn("_before", F.lag("end").over(w)).where(F.col("start") <= F.col("_before")).drop("_before")


def in_display_order(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans with ``place``: their number by start, then end, in their file."""
    return spans.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")))
