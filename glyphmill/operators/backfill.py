"""Back-fill: files rewritten with the replacements of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glyphmill.functions.udfs import scalar
from glyphmill.parse import backfill, njson, snbt
from glyphmill.parse.commands import OverlapError


def filled_commands(frame: DataFrame, text: str, spans: str, column: str = "filled") -> DataFrame:
    """With ``column``: each text with its array of spans (start, end closed in UTF-16 units, replacement, syntax) replaced.

    Overlapping spans give null; string syntaxes are quoted again with double quotes.
    """

    def run(value: str, items) -> str | None:
        try:
            return backfill.spans_file(value, [(int(s["start"]), int(s["end"]) + 1, s["replacement"], s["syntax"]) for s in items])
        except OverlapError:
            return None

    return frame.withColumn(column, scalar(run, "string", text, spans))


def filled_trees(frame: DataFrame, text: str, replacements: str, kind: str = "json", column: str = "filled") -> DataFrame:
    """With ``column``: each JSON or SNBT text with its array of (pointer, format, replacement) put in; null where it doesn't parse."""

    def run(value: str, items) -> str | None:
        new = [(r["pointer"], r["format"], r["replacement"]) for r in items]
        try:
            if kind == "json":
                return njson.write(backfill.fill(njson.parse(value, njson.FILE), new, "json_obj"))
            return snbt.write(backfill.fill(snbt.to_tree(snbt.parse(value)), new, "nbt_obj"))
        except ValueError:
            return None

    return frame.withColumn(column, scalar(run, "string", text, replacements))
