"""Pools of distinct texts, and the joins that tell which of them are still to be translated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import not_blank


def text_pool(leaves: DataFrame, text: str = "content") -> DataFrame:
    """(text): the distinct texts. Nulls have no part."""
    return leaves.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()


def simplified(leaves: DataFrame, text: str = "content") -> DataFrame:
    """The leaves with components in their shortest form, so that equal texts pool."""
    from glyphmill.functions.udfs import scalar
    from glyphmill.parse import component, njson, snbt

    def short(value: str) -> str:
        tree = component.read_json(value)
        writer = njson.write
        if tree is njson.JsonError or not component.is_text(tree):
            tree, writer = component.read_snbt(value) if value[:1] in ("{", "[", '"', "'") else None, snbt.write
        if not component.is_text(tree):
            return value
        try:
            return writer(component.simplify(tree))
        except (ValueError, TypeError):
            return value

    return leaves.withColumn(text, scalar(short, "string", text))


def missing_pool(pool: DataFrame, mapping: DataFrame) -> DataFrame:
    """Texts whose key the mapping(source, target) doesn't have; a null target counts as had."""
    return pool.join(mapping.select(F.col("source").alias("text")), "text", "left_anti")


def to_translate(pool: DataFrame, caches: DataFrame) -> DataFrame:
    """Distinct (format, text) that aren't blank and that no cache(format, source) has, per format."""
    known = caches.select("format", F.col("source").alias("text"))
    return pool.where(not_blank(F.col("text"))).select("format", "text").distinct().join(known, ["format", "text"], "left_anti")
