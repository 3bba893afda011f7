"""Incremental pools: texts of arriving batches that no earlier batch had, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import not_blank, readable


def new_texts(stream: DataFrame, text: str = "text") -> DataFrame:
    """Readable texts, each the first time it comes: state is one hash-keyed entry per distinct text."""
    c = F.col(text)
    return stream.where(not_blank(c) & readable(c)).select(c.alias("text")).dropDuplicates(["text"])


def run_to(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends what arrives as Parquet, exactly once, and ends when all input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
