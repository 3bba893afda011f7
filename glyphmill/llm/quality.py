"""Quality: a generalised additive model with pairwise interactions on statistics of the text.

Each feature is cut into quantile bins and has a lookup table of log-odds. Boosting goes round the
features, each time fitting a shallow tree on one feature's bins to the gradient and adding a small
part of it to its table. Then the pairs of features that explain most of what is left get tables of
their own, boosted in the same way with trees on two features. A score is a sum of table entries.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrays import released
from glyphmill.llm.toxicity import held_out, labelled_sample

#: Training takes at most so many labelled texts of either class, those with the least hash of their id.
SAMPLE = 6000
BINS, COARSE, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 300, 80, 0.08, 4, 20
FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "top_pair", "distinct_lines",
    "log_lines", "words_per_line", "upper_words", "upper_chars", "digits", "symbols", "pipes", "marks_per_word", "stops",
    "commas", "ends", "capital_starts", "non_ascii", "compression", "repeated_words", "lone_symbols", "log_chars",
)
_CLASSES = np.zeros(129, np.uint8)
_CLASSES[[9, 10, 11, 12, 13, 32]] = 1
_CLASSES[48:58] = 2
_CLASSES[65:91] = 3
_CLASSES[97:123] = 4
_CLASSES[128] = 5


def features(text: str | None) -> np.ndarray:
    """The values of FEATURES for one whole text; null counts as empty, and an empty text has zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return np.zeros(len(FEATURES))
    n, chars = len(words), len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_CLASSES[np.minimum(points, 128)], minlength=6)
    count = lambda c: text.count(c)
    sizes = np.array([len(w) for w in words])
    lower = [w.lower() for w in words]
    by_word = Counter(lower)
    pairs = Counter(zip(lower, lower[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, kinds[3] + kinds[4] + kinds[5])
    raw = text.encode("utf-8", "surrogatepass")
    same = sum(a == b for a, b in zip(lower, lower[1:], strict=False))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    return np.array([
        np.log1p(n), sizes.mean(), (sizes > 12).mean(), (sizes < 3).mean(), len(by_word) / n, by_word.most_common(1)[0][1] / n,
        (pairs.most_common(1)[0][1] if pairs else 0) / n, len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines), upper / n,
        kinds[3] / letters, kinds[2] / chars, kinds[0] / chars, count("|") / n, kinds[0] / n, (count(".") + count("!") + count("?")) / n,
        count(",") / n, sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / len(lines), sum(x.lstrip()[0].isupper() for x in lines) / len(lines),
        kinds[5] / chars, len(zlib.compress(raw, 1)) / len(raw), same / n, sum(not any(c.isalnum() for c in w) for w in words) / n, np.log1p(chars),
    ], np.float64)


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value, a column per feature."""
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), np.int64)


@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries for rows of features."""
        at = bins_of(x, self.edges)
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        if self.pairs:
            rough = bins_of(x, self.coarse)
            for i, j, table in self.pairs:
                total += table[rough[:, i], rough[:, j]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -500, 500)))


def _value(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value of every bin of a tree grown best split first on one feature's sums of gradients."""
    cuts = [(0, len(g))]
    gain = lambda s, e: g[s:e].sum() ** 2 / (h[s:e].sum() + 1.0)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for k, (s, e) in enumerate(cuts):
            a, b, c = np.cumsum(g[s:e])[:-1], np.cumsum(h[s:e])[:-1], np.cumsum(n[s:e])[:-1]
            total = n[s:e].sum()
            if len(a):
                found = a**2 / (b + 1) + (g[s:e].sum() - a) ** 2 / (h[s:e].sum() - b + 1) - gain(s, e)
                found[(c < LEAST) | (total - c < LEAST)] = 0
                m = int(np.argmax(found))
                if found[m] > best[0]:
                    best = (found[m], k, s + m + 1)
        if best[1] is None:
            break
        s, e = cuts.pop(best[1])
        cuts += [(s, best[2]), (best[2], e)]
    out = np.zeros(len(g))
    for s, e in cuts:
        out[s:e] = _value(g[s:e].sum(), h[s:e].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts each of two features once."""
    sums = [x.cumsum(0).cumsum(1) for x in (g, h, n)]
    parts = []
    for x in sums:
        a = x[:-1, :-1]
        b, c = x[:-1, -1:] - a, x[-1:, :-1] - a
        parts.append((a, b, c, x[-1, -1] - a - b - c))
    gain = sum(p**2 / (q + 1) for p, q in zip(parts[0], parts[1], strict=True)) - g.sum() ** 2 / (h.sum() + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    for k, (rows, columns) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        if parts[2][k][i, j] >= LEAST:
            out[rows, columns] = _value(parts[0][k][i, j], parts[1][k][i, j])
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """A model of features and labels; with one class only, its share for all."""
    y = np.asarray(y, np.float64)
    w = np.ones(len(y)) if weight is None else weight
    rate = float(((y * w).sum() + 0.5) / (w.sum() + 1))
    cut = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Model(cut(BINS), cut(COARSE), float(np.log(rate / (1 - rate))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        return model
    at = bins_of(x, model.edges)
    logit = np.full(len(y), model.bias)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return w * (y - p), w * p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = gradients()
            size = len(table)
            step = RATE * _tree(np.bincount(at[:, j], g, size), np.bincount(at[:, j], h, size), np.bincount(at[:, j], minlength=size), LEAVES)
            table += step
            logit += step[at[:, j]]
    rough = bins_of(x, model.coarse)
    shape = [len(e) + 1 for e in model.coarse]

    def sums(i: int, j: int, *values: np.ndarray) -> list[np.ndarray]:
        cell = rough[:, i] * shape[j] + rough[:, j]
        return [np.bincount(cell, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in values]

    g, h = gradients()
    ranked = sorted(((_quadrants(*sums(i, j, g, h, np.ones(len(y))))[0], i, j) for i in range(x.shape[1]) for j in range(i) if shape[i] > 1 and shape[j] > 1), reverse=True)
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = gradients()
            step = RATE * _quadrants(*sums(i, j, g, h, np.ones(len(y))))[1]
            table += step
            logit += step[rough[:, i], rough[:, j]]
    return model


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels(doc_id, quality)`` on at most SAMPLE texts of either class, weighted back to the classes' shares.

    Held-out rows and all columns but the text have no part in it. The features are made on the executors.
    """
    known = labels.where(~held_out() & F.col("quality").isNotNull())
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    sample = labelled_features(documents, labels)
    y = sample["y"].to_numpy()
    own = Counter(y.tolist())
    weight = np.array([share[v] / own[v] for v in y.tolist()]) if len(y) else np.zeros(0)
    weight = weight / weight.mean() if len(y) else weight
    x = np.array(sample["x"].tolist(), np.float64).reshape(len(sample), len(FEATURES))
    return fit(x, y, weight)


def labelled_features(documents: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """Features x and labels y of the training sample."""

    @F.pandas_udf("array<double>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return labelled_sample(documents, labels, "quality", {1: SAMPLE, 0: SAMPLE}, made("text")).rename(columns={"text": "x"})


def with_scores(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with ``column``: the probability of good quality of the whole text; null counts as empty."""
    found = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @released
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(found.value.scores(x), dtype="float64")

    return documents.withColumn(column, score("text"))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: predicted is 1 if score >= threshold.

    Each row is scored by its text alone: nulls count as empty, repeated rows score alike, long texts
    are measured whole. With no labels, or one class only, all rows get that share as their score.
    """
    scored = with_scores(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
