"""Extraction of texts from command files, JSON and NBT: one row per text, with where it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glyphmill.functions.udfs import exploded
from glyphmill.parse import extract, nbt
from glyphmill.plans.catalog import builtin
from glyphmill.plans.patterns import Patterns

SPANS = "ordinal int, start int, end int, content string, syntax string, format string"
LEAVES = "ordinal int, outer_pointer string, inner_pointer string, format string, content string, syntax string, error string"


def parsed_commands(frame: DataFrame, text: str) -> DataFrame:
    """One row per command: name, its arguments' texts and closed spans, whether it's a macro."""
    from glyphmill.parse.commands import parse_commands, utf16

    def run(value: str | None):
        for i, c in enumerate(parse_commands(value or "")):
            spans = utf16(value, [(a.start, a.end) for a in c.args])
            yield {"ordinal": i, "name": c.name, "raw": c.raw, "args": [a.content for a in c.args], "starts": [s for s, _ in spans], "ends": [e - 1 for _, e in spans], "is_macro": c.macro}

    return exploded(frame, run, "ordinal int, name string, raw string, args array<string>, starts array<int>, ends array<int>, is_macro boolean", text)


def command_spans(frame: DataFrame, text: str, patterns: Patterns | None = None) -> DataFrame:
    """One row per text of the commands in a column; spans are closed and in UTF-16 units."""
    catalog = patterns or builtin()

    def run(value: str | None):
        for i, s in enumerate(extract.command_texts(value or "", catalog)):
            yield {"ordinal": i, "start": s.start, "end": s.end - 1, "content": s.content, "syntax": s.syntax, "format": s.format}

    return exploded(frame, run, SPANS, text)


def _leaves(found) -> list[dict]:
    rows = [leaf for f in found for leaf in f.leaves()]
    return [{"ordinal": i, "outer_pointer": o, "inner_pointer": n, "format": f, "content": c, "syntax": s, "error": None} for i, (o, n, f, c, s) in enumerate(rows)]


def _error(e: Exception) -> list[dict]:
    return [dict.fromkeys(("ordinal", "outer_pointer", "inner_pointer", "format", "content", "syntax")) | {"error": str(e)}]


def json_leaves(frame: DataFrame, text: str, patterns: Patterns | None = None) -> DataFrame:
    """One row per text of the JSON files in a column; a file that doesn't parse gives one row with ``error``."""
    catalog = patterns or builtin()

    def run(value: str | None):
        try:
            return _leaves(extract.json_texts(value or "", catalog))
        except ValueError as e:
            return _error(e)

    return exploded(frame, run, LEAVES, text)


def nbt_leaves(frame: DataFrame, content: str, patterns: Patterns | None = None) -> DataFrame:
    """As json_leaves, of gzipped NBT."""
    catalog = patterns or builtin()

    def run(value: bytes | None):
        try:
            return _leaves(extract.nbt_texts(nbt.read_gzip(bytes(value or b"")), catalog))
        except ValueError as e:
            return _error(e)

    return exploded(frame, run, LEAVES, content)
