"""Substring deduplication with a log-structured index of window fingerprints.

A window is a run of 13 words. Its fingerprint is the least hash of the 7-word runs inside it, which
consecutive windows mostly share, so a document has about one fingerprint for four words, and equal
windows have equal fingerprints. The index holds (fingerprint, doc_id) in immutable runs, bucketed
and sorted by fingerprint, in a folder that later sessions can open again. Documents come in batches:
a batch is written as a run, merge-joined with the runs before it bucket by bucket (no shuffle of
history), and older runs are compacted into one. Fingerprints that several documents hold are only
candidates: the windows behind them are read again from the texts and verified as whole word
sequences by two independent 64-bit hashes.

Fingerprints that very many documents hold (as a bounded sample tells) are hot. They count as shared
without a join, and their rows are keyed by document, so that they spread over all buckets.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.arrays import U, Hasher, Words, chunks, mix, released, text_bytes, windows, words_of
from glyphmill.llm.ngram_join import BROADCAST_IDS
from glyphmill.llm.shared import Workspace, complete_tables, delete, partitions

WINDOW, GRAM = 13, 7
#: Runs that a batch is joined with at most; beyond it they are compacted first.
FAN_IN = 2
#: Bytes of cuts that are broadcast; more are joined by a shuffle.
BROADCAST_CUTS = 48 << 20
#: A fingerprint that so many of at most SAMPLE sampled documents of a batch hold is hot; an index knows at most HOT of them.
HEAVY, SAMPLE, HOT = 48, 8000, 1 << 20
_HASHERS = (Hasher(21), Hasher(22))


def _batches(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, words, _HASHERS[0].spans(words.data, words.start, words.end)


def _fingerprints(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The fingerprint of the window at each start (word numbers); it is even."""
    if not len(start):
        return np.zeros(0, U)
    size = len(hashes) - GRAM + 1
    grams = _HASHERS[0].runs(hashes, np.arange(size), GRAM)
    least = grams[start].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[start + j], out=least)
    return least & ~U(1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


@released
def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, high, low): length and 128-bit hash of each word sequence."""
    for batch in batches:
        for a, b, words, hashes in _batches(batch.column("text")):
            high = _HASHERS[0].sequences(hashes, words.first[:-1], words.first[1:])
            low = _HASHERS[1].sequences(_HASHERS[1].spans(words.data, words.start, words.end), words.first[:-1], words.first[1:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(words.first)), _signed(high), _signed(low)], ["doc_id", "n_words", "high", "low"])


@released
def fingerprint_rows(hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc_id) for every change of fingerprint along a document.

    In place of one of the ``hot`` fingerprints h is odd and holds its number there below bits of the
    document's hash.
    """
    order = np.argsort(hot)
    ranked = hot[order]
    for batch in batches:
        for a, b, words, hashes in _batches(batch.column("text")):
            start, doc = windows(words, WINDOW)
            h = _fingerprints(hashes, start)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, ids = h[new], batch.column("doc_id").slice(a, b - a).take(pa.array(doc[new]))
            if len(hot):
                at = np.minimum(np.searchsorted(ranked, h), len(hot) - 1)
                known = ranked[at] == h
                h[known] = mix(np.asarray(ids).view(U)[known]) << U(21) | order[at[known]].astype(U) << U(1) | U(1)
            yield pa.RecordBatch.from_arrays([_signed(h), ids], ["h", "doc_id"])


@released
def hot_rows(hot: np.ndarray, here: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc_id) with the fingerprints themselves of rows that hold a number of ``hot``, if it's among those ``here`` (sorted)."""
    for batch in batches:
        number = (np.asarray(batch.column("h")) >> 1) & (HOT - 1)
        keep = np.isin(number, here)
        yield pa.RecordBatch.from_arrays([_signed(hot[number[keep]]), batch.column("doc_id").filter(pa.array(keep))], ["h", "doc_id"])


@released
def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, doc_id, whole, at): the windows whose fingerprint is in the row's ``shared``; whole is the text's own hash."""
    for batch in batches:
        for a, b, words, hashes in _batches(batch.column("text")):
            start, doc = windows(words, WINDOW)
            h, keep = _fingerprints(hashes, start), np.zeros(len(start), bool)
            edges = np.searchsorted(doc, np.arange(b - a + 1))
            for i in range(b - a):
                s, e = edges[i], edges[i + 1]
                if e > s:
                    shared = np.asarray(batch.column("shared")[a + i].values).view(U)
                    keep[s:e] = np.isin(h[s:e], shared)
            start, doc = start[keep], doc[keep]
            second = _HASHERS[1].spans(words.data, words.start, words.end)
            whole = _HASHERS[0].sequences(hashes, words.first[:-1], words.first[1:])
            high, low = _HASHERS[0].runs(hashes, start, WINDOW), _HASHERS[1].runs(second, start, WINDOW)
            ids = batch.column("doc_id").slice(a, b - a).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([_signed(high), _signed(low), ids, _signed(whole[doc]), pa.array((start - words.first[doc]).astype(np.int32))], ["high", "low", "doc_id", "whole", "at"])


@released
def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From window starts of a text to the spans of words that they cover, as pairs of 32-bit numbers."""
    for batch in batches:
        out = []
        for starts in batch.column("starts"):
            at = np.sort(np.asarray(starts.values))
            cut = np.flatnonzero(np.diff(at) > WINDOW)
            out.append(np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + WINDOW], 1).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("whole"), pa.array(out, pa.binary())], ["doc_id", "whole", "spans"])


def _whole(raw: bytes) -> int:
    words = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return int(_HASHERS[0].sequences(_HASHERS[0].spans(words.data, words.start, words.end), words.first[:1], words.first[1:]).view(np.int64)[0])


def kept_words(raw: bytes, cuts: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay and the number removed; cuts are those of all texts with this doc_id."""
    words = raw.split()
    if not cuts:
        return words, 0
    own, gone = _whole(raw), np.zeros(len(words), bool)
    for cut in cuts:
        if cut["whole"] == own:
            for s, e in np.frombuffer(cut["spans"], "<i4").reshape(-1, 2):
                gone[s:e] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


class FingerprintIndex:
    """Sorted immutable runs of (h, doc_id) as bucketed tables in one folder of a store that every executor sees.

    A run's name tells the batches that it covers and its number of buckets, and only a finished one counts;
    a compacted run stands for all whose batches it covers. So opening the folder again, in another
    session or after a failure at any point, finds exactly the batches that were added.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root, self.id = spark, root, uuid.uuid4().hex[:12]
        found = sorted((tuple(map(int, name.split("-")[1:])) for name in complete_tables(spark, root) if name.startswith("run-")), key=lambda x: (x[0], -x[1]))
        self.runs: list[tuple[int, int, int]] = []
        for run in found:
            if not self.runs or run[0] > self.runs[-1][1]:
                self.runs.append(run)
        for run in found:
            if run not in self.runs:
                delete(spark, self._path(run))
        for run in self.runs:
            spark.sql(f"CREATE TABLE {self._table(run)} (h BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h, doc_id) INTO {run[2]} BUCKETS LOCATION '{self._path(run)}'")
        self.buckets = buckets or (self.runs[-1][2] if self.runs else partitions(spark))
        self.hot = np.zeros(0, U)
        parts = sorted((int(name.split("-")[1]), name) for name in complete_tables(spark, root) if name.startswith("hot-"))
        for _, name in parts:
            rows = spark.read.schema("number long, h long").parquet(f"{root}/{name}").orderBy("number").toArrow()  # HOT at most
            self.hot = np.concatenate([self.hot, rows.column("h").to_numpy().view(U)])

    def _path(self, run: tuple[int, int, int]) -> str:
        return f"{self.root}/run-{run[0]}-{run[1]}-{run[2]}"

    def _table(self, run: tuple[int, int, int]) -> str:
        return f"fingerprints_{self.id}_{run[0]}_{run[1]}"

    def _write(self, rows: DataFrame, first: int, last: int) -> tuple[int, int, int]:
        run = (first, last, self.buckets)
        delete(self.spark, self._path(run))
        sorted_rows = rows.repartition(self.buckets, "h")
        sorted_rows.write.format("parquet").option("compression", "zstd").option("path", self._path(run)).bucketBy(self.buckets, "h").sortBy("h", "doc_id").saveAsTable(self._table(run))
        return run

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            merged = self.spark.table(self._table(self.runs[0]))
            for run in self.runs[1:]:
                merged = merged.unionByName(self.spark.table(self._table(run)))
            old, self.runs = self.runs, [self._write(merged, self.runs[0][0], self.runs[-1][1])]
            for run in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
                delete(self.spark, self._path(run))

    def learn(self, docs: DataFrame, number: int) -> None:
        """Add the hot fingerprints of some documents to those known, under a number that is free. They are only a way to deal rows out, so a sample will do."""
        every = max(1, -(-docs.count() // SAMPLE))
        sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        none = np.zeros(0, U)
        rows = sample.mapInArrow(lambda x: fingerprint_rows(none, x), "h long, doc_id long").distinct()
        found = rows.groupBy("h").count().where(F.col("count") >= HEAVY).select("h").toArrow().column("h").to_numpy().view(U)
        fresh = np.setdiff1d(found, self.hot)[: HOT - len(self.hot)]
        if len(fresh):
            table = pa.table({"number": np.arange(len(self.hot), len(self.hot) + len(fresh)), "h": fresh.view(np.int64)})
            self.spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/hot-{number}")
            self.hot = np.concatenate([self.hot, fresh])

    def candidates(self, docs: DataFrame, work: Workspace, learn: bool = True) -> DataFrame:
        """Add a batch, and learn its hot fingerprints first, if these aren't known; (h, doc_id) of the fingerprints it shares among its documents or with history, from either side.

        All rows of hot fingerprints that the batch holds are among these.
        """
        if len(self.runs) >= FAN_IN:
            self.compact()
        number = self.runs[-1][1] + 1 if self.runs else 1
        if learn:
            self.learn(docs, number)
        hot = self.hot
        new = self._write(docs.mapInArrow(lambda x: fingerprint_rows(hot, x), "h long, doc_id long"), number, number)
        tables = [self.spark.table(self._table(run)) for run in [new, *self.runs]]
        batch, old = tables[0].where("h & 1 = 0"), [x.where("h & 1 = 0") for x in tables[1:]]
        ends = batch.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
        keys = ends.where("x < y").select("h")
        for run in old:
            keys = keys.unionByName(ends.join(run, "h", "left_semi").select("h"))
        spread = None
        if len(hot):
            numbers = tables[0].where("h & 1 = 1").select(F.shiftright("h", 1).bitwiseAND(HOT - 1).alias("number")).distinct()
            here = np.sort(numbers.toArrow().column("number").to_numpy())  # HOT at most
            if len(here):
                own = self.spark.createDataFrame(pa.table({"h": hot[here].view(np.int64)}))
                keys = keys.unionByName(own)  # as rows of runs from before they were hot
                spread = [x.where("h & 1 = 1").mapInArrow(lambda y: hot_rows(hot, here, y), "h long, doc_id long") for x in tables]
        keys = work.save(keys.distinct(), f"keys-{number}")
        found = batch.join(keys, "h", "left_semi").distinct()
        for run in old:
            found = found.unionByName(run.join(keys, "h", "left_semi").distinct())
        for rows in spread or ():
            found = found.unionByName(rows.distinct())
        self.runs.append(new)
        found = work.save(found, f"found-{number}")
        work.drop(f"keys-{number}")
        return found

    def add(self, docs: DataFrame, history: DataFrame) -> DataFrame:
        """Add a batch ``docs(doc_id, text)``; verified (doc_id, whole, spans) of what its documents repeat.

        ``history`` holds the texts of the batches before, of which only those that share a fingerprint
        with the batch are looked at again. As everywhere here, the smallest doc_id keeps its words, so new
        batches should have larger ids than old ones. Rows without a doc_id are left out.
        """
        work = Workspace(self.spark, "batch")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
        texts = docs.unionByName(history.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
        cuts = _window_cuts(texts, self.candidates(docs, work), work)
        return work.save(cuts.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "cuts")

    def close(self) -> None:
        """Take the runs' tables out of the session's catalog; the folder stays."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        self.runs = []


def _window_cuts(docs: DataFrame, found: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, whole, spans) of the words that windows with the candidate fingerprints ``found(h, doc_id)`` repeat."""
    shared = work.save(found.groupBy("doc_id").agg(F.collect_set("h").alias("shared")), "shared")
    own = shared.select("doc_id")
    texts = docs.join(F.broadcast(own) if shared.count() <= BROADCAST_IDS else own, "doc_id", "left_semi").join(shared, "doc_id")
    rows = work.save(texts.select("doc_id", "text", "shared").mapInArrow(window_rows, "high long, low long, doc_id long, whole long, at int"), "windows")
    firsts = rows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("high", "low", "first")
    firsts = work.save(firsts, "firsts")
    later = rows.join(firsts, ["high", "low"]).where("doc_id > first")
    starts = later.groupBy("doc_id", "whole").agg(F.collect_set("at").alias("starts"))
    return starts.mapInArrow(covered, "doc_id long, whole long, spans binary")


def _cuts(docs: DataFrame, batches: int, work: Workspace) -> DataFrame:
    """(doc_id, whole, spans) of every text of which something goes."""
    info = work.save(docs.mapInArrow(describe, "doc_id long, n_words long, high long, low long"), "info")
    long = info.where(F.col("n_words") >= WINDOW)
    # a whole text that an earlier document has goes altogether, and needs no look at its windows
    # (tables of groups are written before a join with their rows, so that Spark can split a hot group's rows)
    least = work.save(long.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "least")
    copies = work.save(long.join(least, ["high", "low"]).where("doc_id > first").select("doc_id", F.col("high").alias("whole"), "n_words").distinct(), "copies")
    few = copies.count() <= BROADCAST_IDS
    ids = copies.groupBy("doc_id").agg(F.collect_set("whole").alias("copied"))
    repeated = info.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(1).count() > 0
    lone = ids.select("doc_id") if not repeated else ids.select("doc_id").limit(0)
    rest = docs.join(F.broadcast(lone) if few else lone, "doc_id", "left_anti")

    bounds = info.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    bounds = sorted(set(bounds or []))
    index, found = FingerprintIndex(work.spark, f"{work.root}/index"), []
    try:
        index.learn(rest, 0)
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            part = rest if low is None else rest.where(F.col("doc_id") > low)
            found.append(index.candidates(part if high is None else part.where(F.col("doc_id") <= high), work, learn=False))
    finally:
        index.close()
    work.drop("index")
    cuts = _window_cuts(rest, functools.reduce(DataFrame.unionByName, found), work)
    all_of = F.unhex(F.concat(F.lit("00000000"), *(F.lpad(F.hex(F.shiftrightunsigned("n_words", 8 * k).bitwiseAND(255)), 2, "0") for k in range(4))))
    cuts = work.save(cuts.unionByName(copies.select("doc_id", "whole", all_of.alias("spans"))), "cuts")
    work.drop("windows", "firsts", "least", "shared", "info", "copies", *(f"found-{i + 1}" for i in range(len(found))))
    return cuts


def cut_repeats(documents: DataFrame, batches: int = 3) -> DataFrame:
    """(doc_id, kept, n_words, n_removed): the words that stay, joined by one space.

    Words covered by a window of 13 whose word sequence also starts in a document with a smaller doc_id
    go; windows are judged on the input. Null and empty texts have no words. Rows without a doc_id
    neither lose words nor take them from others. Rows that share a doc_id don't count as earlier than one
    another; each loses what its own text repeats of smaller ids. ``batches`` ranges of ids are
    indexed one after the other; the result doesn't depend on their number.
    """
    work = Workspace(documents.sparkSession, "substrings")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = _cuts(docs.where("doc_id is not null"), batches, work)
    size = cuts.agg(F.sum(F.length("spans") + 32)).first()[0] or 0
    by_doc = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("whole", "spans")).alias("cuts"))
    joined = docs.join(F.broadcast(by_doc) if size <= BROADCAST_CUTS else by_doc, "doc_id", "left")

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 256):
                batch = part.slice(i, 256)
                rows = []
                for text, cut in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                    words, gone = kept_words((text or "").encode(), cut)
                    rows.append((b" ".join(words).decode(), len(words) + gone, gone))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(columns[0]), pa.string()), pa.array(list(columns[1]), pa.int64()), pa.array(list(columns[2]), pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    return joined.select("doc_id", "text", "cuts").mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long")
