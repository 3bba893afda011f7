"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

N-grams of lower-cased code points are hashed into a table. From labelled texts each cell gets the
log ratio of its smoothed document frequencies in toxic and other texts; the strongest cells stay
and a logistic regression is fitted on (presence x ratio) by Newton steps on its ridge-penalised
loss. A model is a table of weights, which scoring looks up for all n-grams of whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrays import U, mix, released, stream

ORDERS, BITS = (4, 5, 6), 22
#: Training takes at most so many labelled texts of each class, those with the least hash of their id.
POSITIVE, NEGATIVE = 2500, 5000
#: ... and of these, in the same order, as many as have so many bytes together (one at least).
SAMPLE_BYTES = 64 << 20
CELLS, RIDGE = 4000, 0.3
_SALTS = stream(11, 8)
_OTHER = np.array([not chr(i).isalnum() for i in range(128)] + [False])


def cells(text: str) -> np.ndarray:
    """Table cell of every n-gram of a text, all orders together, with repeats.

    Runs of ASCII characters other than letters and digits count as one space, also at the ends.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_OTHER[np.minimum(points, 128)], 32, points)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])].astype(U)
    coded = mix(points + _SALTS[0])
    out = []
    for n in ORDERS:
        if len(points) >= n:
            size = len(points) - n + 1
            h = coded[:size].copy()
            for j in range(1, n):
                h = h * U(0x9E3779B97F4A7C15) + coded[j : j + size]
            out.append((mix(h) >> U(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    cells: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS, np.float32)
        full[self.cells] = self.weights
        return full

    def score(self, text: str, table: np.ndarray) -> float:
        """Probability of label 1; each cell counts once a text."""
        at = cells(text)
        at = np.unique(at[table[at] != 0])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + float(table[at].sum(dtype=np.float64))))))


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """A model of labelled texts; with fewer than two classes, their share and no weights.

    ``weight``, of mean 1, is how much each text counts for the prior and in the regression. The log
    ratios are taken within each class, so the mix of classes has no part in them.
    """
    labels = np.asarray(labels, np.float64)
    weight = np.ones(len(labels)) if weight is None else weight
    rate = float(((weight * labels).sum() + 0.5) / (weight.sum() + 2))
    prior = math.log(rate / (1 - rate))
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), prior)
    counts = np.zeros((2, 1 << BITS), np.int32)
    for text, y in zip(texts, labels, strict=True):
        counts[int(y), np.unique(cells(text))] += 1
    pos, neg = labels.sum(), len(labels) - labels.sum()
    ratio = np.log((counts[1] + 1) / (pos + 2)) - np.log((counts[0] + 1) / (neg + 2))
    # what a cell's presence tells: its log ratio by the root of how often it was seen
    gain = np.abs(ratio) * np.sqrt(np.minimum(counts.sum(0), 4000))
    gain[counts.sum(0) < 5] = 0
    chosen = np.sort(np.argpartition(-gain, CELLS)[:CELLS])
    chosen = chosen[gain[chosen] > 0]
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows, columns = [], []
    for i, text in enumerate(texts):
        at = place[cells(text)]
        at = np.unique(at[at >= 0])
        rows.append(np.full(len(at), i))
        columns.append(at)
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    values = ratio[chosen][columns]
    weights, bias = _logistic(rows, columns, values, labels, weight, len(chosen), prior)
    return Model(chosen, (weights * ratio[chosen]).astype(np.float32), bias)


def _logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, weight: np.ndarray, width: int, bias: float) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression on a sparse matrix by Newton steps, each solved by conjugate gradients."""
    n = len(labels)
    times = lambda w: np.bincount(rows, values * w[columns], n) + w[-1]
    back = lambda r: np.append(np.bincount(columns, values * r[rows], width), r.sum())
    w = np.append(np.zeros(width), bias)
    ridge = np.append(np.full(width, RIDGE), 1e-6)

    def loss(w):
        z = times(w)
        return float((weight * (np.logaddexp(0, z) - labels * z)).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(times(w), -500, 500)))
        grad = back(weight * (p - labels)) + ridge * w
        curve = weight * p * (1 - p)
        step, rest = np.zeros_like(w), -grad
        to, size = rest.copy(), rest @ rest
        for _ in range(60):
            if size < 1e-10:
                break
            h = back(curve * times(to)) + ridge * to
            a = size / (to @ h)
            step, rest = step + a * to, rest - a * h
            size, before = rest @ rest, size
            to = rest + size / before * to
        scale = 1.0
        while loss(w + scale * step) > now and scale > 1e-4:
            scale /= 2
        before, now = now, loss(w + scale * step)
        w = w + scale * step
        if before - now < 1e-6 * abs(now):
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) to learn from: not held out, neither null; of several labels of a document the largest."""
    return labels.where(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: dict[int, int], derive=None) -> pd.DataFrame:
    """Texts and labels to learn from: not held out, at most most[y] of each class, by least hash of the id.

    A document with several labels counts once, with the largest; null labels and texts are left out.
    ``derive``, a Column of the text with values of a fixed size, replaces it before it leaves the
    executors. Texts themselves come to the driver up to SAMPLE_BYTES. ``share`` is that of a row's
    class which this bound leaves.
    """
    y = learnable(labels, label).withColumn("h", F.xxhash64(F.lit("train"), "doc_id"))
    chosen = None
    for value, n in most.items():
        part = y.where(F.col("y") == value).orderBy("h", "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.select("h", "y", F.xxhash64("text").alias("t"), F.col("text") if derive is None else derive.alias("text"))
    if derive is not None:
        return texts.toPandas().sort_values(["h", "t"], kind="stable").assign(share=1.0)
    sizes = texts.select("h", "y", "t", F.octet_length("text").alias("n")).toPandas().sort_values(["h", "t"], kind="stable")
    kept = max(1, int(np.searchsorted(sizes["n"].cumsum().to_numpy(), SAMPLE_BYTES, "right")))
    if kept < len(sizes):
        last = sizes.iloc[kept - 1]
        texts = texts.where(F.struct("h", "t") <= F.struct(F.lit(int(last["h"])), F.lit(int(last["t"]))))
    rows = texts.toPandas().sort_values(["h", "t"], kind="stable")
    before, after = sizes["y"].value_counts(), rows["y"].value_counts()
    return rows.assign(share=[float(after[v] / before[v]) for v in rows["y"]])


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels(doc_id, toxic)`` on a sample bounded by POSITIVE and NEGATIVE texts, on the driver.

    The sample is weighted back to the classes' shares of all labels to learn from. Rows that
    :func:`held_out` marks, and all columns but the text, have no part in it.
    """
    most = {1: POSITIVE, 0: NEGATIVE}
    rows = labelled_sample(documents, labels, "toxic", most)
    y = rows["y"].to_numpy()
    counts = {r["y"]: r["count"] for r in learnable(labels, "toxic").groupBy("y").count().collect()}
    weight = np.array([max(1.0, counts[v] / most[v]) / share for v, share in zip(y.tolist(), rows["share"].tolist(), strict=True)])
    return fit(rows["text"].tolist(), y, weight / weight.mean() if len(y) else weight)


def with_scores(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with ``column``: the probability that the whole text is toxic; null counts as empty."""
    found = documents.sparkSession.sparkContext.broadcast(model)
    tables: dict[int, np.ndarray] = {}

    @F.pandas_udf("double")
    @released
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = found.value
        table = tables.setdefault(0, own.table()) if not tables else tables[0]
        for texts in parts:
            yield pd.Series([own.score(x or "", table) for x in texts], dtype="float64")

    return documents.withColumn(column, score("text"))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: predicted is 1 if score >= 0.5.

    Each row is scored by its text alone: nulls count as empty, repeated rows score alike, long texts
    are scored whole. With no labels, or one class only, all rows get that share as their score.
    """
    scored = with_scores(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
