"""Batches of texts by a budget of tokens, and the terms that apply to them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import token_estimate

BUDGET = 2048


def greedy_chunks(texts: DataFrame, group: str, order: str, text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(group, order, tokens, chunk): texts in order, a new chunk where the budget would be passed; a larger text stands alone.

    The rule depends on all texts before, so a group is gone through in order; rows stream through the task
    that has the group with a state of two numbers, however many there are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    rows = texts.select(group, order, token_estimate(F.col(text)).cast("long").alias("tokens"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, total = object(), 0, 0
        for part in parts:
            out = []
            for g, t in zip(part[group], part["tokens"], strict=True):
                if g != now:
                    now, chunk, total = g, 0, 0
                elif total > 0 and total + t > budget:
                    chunk, total = chunk + 1, 0
                total += t
                out.append(chunk)
            yield part.assign(chunk=out)

    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, tokens long, chunk long")


def chunk_totals(chunks: DataFrame, group: str) -> DataFrame:
    return chunks.groupBy(group, "chunk").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))


def usage(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Texts and their estimated tokens by the key columns; null texts have none."""
    return texts.groupBy(*keys).agg(F.count("*").alias("texts"), F.coalesce(F.sum(token_estimate(F.col(text)).cast("long")), F.lit(0)).alias("tokens"))


def applicable_terms(texts: DataFrame, terms: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, term): the terms that a text contains, whatever the case. One pass over a text finds all terms.

    The term table belongs to a project and is bounded; it travels with the task.
    """
    import ahocorasick

    from glyphmill.functions.udfs import exploded

    wanted = sorted(set(filter(None, terms)))

    def found(value: str | None):
        own = getattr(found, "automaton", None)
        if own is None:
            own = ahocorasick.Automaton()
            by_lower: dict[str, list[str]] = {}
            for t in wanted:
                by_lower.setdefault(t.lower(), []).append(t)
            for low, names in by_lower.items():
                own.add_word(low, names)
            own.make_automaton()
            found.automaton = own
        if not value or not wanted:
            return []
        return [{"term": t} for t in sorted({t for _, names in own.iter(value.lower()) for t in names})]

    return exploded(texts.select(key, text), found, "term string", text).select(key, "term")
