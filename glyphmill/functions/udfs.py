"""Arrow-batched functions for what built-in expressions can't say: recursive parsing and spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that get lost on the way through a model: controls other than LF and CR,
# private use, zero-width and byte-order marks, lone surrogates.
_SPECIAL = re.compile("[\x00-\x09\x0b\x0c\x0e-\x1f-\U000f0000-\U000ffffd\U00100000-\U0010fffd​-‏﻿\ud800-\udfff]")
_ESCAPED = re.compile(r"\$UNICODE_([0-9a-zA-Z]{1,6})\$")


def escape_special(text: str) -> str:
    return _SPECIAL.sub(lambda m: f"$UNICODE_{ord(m[0]):04X}$", text)


def unescape_special(text: str) -> str:
    def back(m: re.Match) -> str:
        try:
            return chr(int(m[1], 16))
        except (ValueError, OverflowError):
            return m[0]

    return _ESCAPED.sub(back, text)


#: Rows, and bytes of texts and files in them, that are handed on together at most (but for one row that is larger).
ROWS, PIECE = 2048, 4 << 20

#: Rows of a batch that are read together.
READ = 64


def _bytes(values: Iterable) -> int:
    return sum(len(x) for x in values if isinstance(x, (bytes, str)))


def scalar(function: Callable, kind: str, *columns: Column | str) -> Column:
    """A column of function(row's values); a row with a null input gives null. Values are handed on every PIECE bytes, so they may be files."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch if isinstance(batch, tuple) else (batch,)), strict=True):
                out.append(None if any(x is None for x in row) else function(*row))
                size += _bytes(out[-1:])
                if size >= PIECE:
                    yield pd.Series(out, dtype=object)
                    out, size = [], 0
            yield pd.Series(out, dtype=object)

    return run(*columns)


def exploded(frame: DataFrame, function: Callable[..., Iterable[dict]], schema: str, *columns: str, drop: Iterable[str] = ()) -> DataFrame:
    """The rows with the columns of each dict that function yields for them; a row that yields none goes.

    What function yields is handed on every ROWS rows or PIECE bytes, so a row may have any number of results.
    Columns in ``drop`` are read and not handed on: a file's bytes aren't copied for each of its results.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL(schema)
    kinds = to_arrow_schema(added)
    kept = [i for i, c in enumerate(frame.columns) if c not in drop]
    whole = T.StructType([*(frame.schema.fields[i] for i in kept), *added.fields])
    places = [frame.columns.index(c) for c in columns]

    def run(batches: Iterable) -> Iterable:
        for batch in batches:
            index, rows, size = [], [], 0

            def done():
                at = pa.array(index, pa.int64())
                new = [pa.array([r.get(f.name) for r in rows], f.type) for f in kinds]
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in kept), *new], names=whole.names)

            for first in range(0, batch.num_rows, READ):
                inputs = [batch.column(i).slice(first, READ).to_pylist() for i in places]
                for i, row in enumerate(zip(*inputs, strict=True), first):
                    for found in function(*row):
                        index.append(i)
                        rows.append(found)
                        size += _bytes(found.values())
                        if len(rows) == ROWS or size >= PIECE:
                            yield done()
                            index, rows, size = [], [], 0
            if rows:
                yield done()

    return frame.mapInArrow(run, whole)


def found_ranges(frame: DataFrame, text: str, part: str) -> DataFrame:
    """One row per non-overlapping occurrence of a literal in a text: closed range start, end (code points)."""
    if not part:
        return frame.select(*frame.columns, F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    before = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda s, n: F.struct((s["at"] + n + len(part)).alias("at"), F.concat(s["all"], F.array(s["at"] + n)).alias("all"))
    starts = F.aggregate(before, start, step, lambda s: s["all"])
    return frame.select(*frame.columns, F.explode(starts).alias("start")).withColumn("end", F.col("start") + (len(part) - 1))
