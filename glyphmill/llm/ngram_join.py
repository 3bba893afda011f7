"""Exact Jaccard self-join of documents on sets of word n-grams, by partitioning the token universe.

The similarity bound J >= p/q turns into a bound on the symmetric difference of two sets. Sizes are
put into bands [l, floor(l*q/p)]; for pairs whose smaller set lies in a band the difference is at
most ``H``. Tokens are hashed into ``m = H + 1 + E`` segments, so at least ``1 + E`` segments of a
similar pair are equal (pigeonhole). Each document emits one key per segment for its own band and,
where a smaller partner can lie in the band below, for that band as well.

Cost-based allocation: a segment that is empty, or whose key is frequent in a bounded sample, is
*heavy*. A document with at most ``E`` heavy segments leaves them out and no pair is lost. One with
more ("deficit") adds one-deletion neighbourhoods of every eighth segment, each of which detects a
difference of one and so counts twice; only where even that does not make up for the heavy segments
are they emitted too. Of documents that share a key, sizes and parity sketches, which rule out no similar
pair, leave few; those are compared exactly on their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrays import U, Hasher, chunks, mix, released, stream, text_bytes, windows, words_of
from glyphmill.llm.components import components
from glyphmill.llm.shared import Workspace, partitions

EVERY = 8
#: A key held by so many of at most SAMPLE sampled documents is heavy.
HEAVY, SAMPLE = 48, 8000
#: A heavy key's documents are dealt out to so many groups.
SPREAD = 100
#: Ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Larger open buckets are compared in pairs of blocks of about so many documents.
BLOCK = 4096
_SALT = stream(77, 4)


class Scheme:
    """Bands and segment counts for sets of n-grams with J >= p/q."""

    def __init__(self, n: int, p: int, q: int):
        if not 0 < p <= q:
            raise ValueError("the similarity must be in (0, 1]")
        self.n, self.p, self.q = n, p, q
        self.low, self.high, self.m, self.slack = [1], [], [], []

    def grow(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            low = self.low[len(self.high)]
            high = low * self.q // self.p
            differ = (self.q - self.p) * (high + high * self.q // self.p) // (self.q + self.p)
            slack = 1 + (differ + 1) * 3 // 100 if differ else 0
            self.high.append(high)
            self.m.append(differ + 1 + slack if differ else 0)
            self.slack.append(slack)
            self.low.append(high + 1)

    def bands(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Band of each size, and the tables high, m and slack."""
        self.grow(int(sizes.max(initial=1)))
        high = np.array(self.high)
        return np.searchsorted(high, sizes, "left"), high, np.array(self.m), np.array(self.slack)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, tokens, first token of each row) for slices of a text column; tokens are distinct and sorted in a row."""
    hasher = Hasher(1)
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        hashes = hasher.spans(words.data, words.start, words.end)
        start, doc = windows(words, n)
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < n))
        tokens = np.concatenate([hasher.runs(hashes, start, n), hasher.sequences(hashes, words.first[short], words.first[short + 1])])
        doc = np.concatenate([doc, short])
        if len(short):
            order = np.argsort(doc, kind="stable")
            tokens, doc = tokens[order], doc[order]
        edges = np.searchsorted(doc, np.arange(b - a + 1))
        own = [np.unique(tokens[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        yield a, b, np.concatenate([*own, np.zeros(0, U)]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def _digests(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's whole set."""
    size = np.diff(first).astype(U)
    out = []
    for salt in _SALT[:2]:
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens ^ salt))])
        out.append(mix((total[first[1:]] - total[first[:-1]]) ^ mix(size + salt)))
    return out[0], out[1]


def _keys(tokens: np.ndarray, first: np.ndarray, scheme: Scheme, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key that the rows emit; heavy is sorted."""
    size = np.diff(first)
    own, high, all_m, all_slack = scheme.bands(size)
    rows, keys = [], []
    for below in (0, 1):
        band = own - below
        use = np.flatnonzero((size > 0) & (band >= 0) & ((below == 0) | (scheme.p * size <= scheme.q * high[band])) & (all_m[band] > 0))
        if not len(use):
            continue
        band, n = band[use], size[use]
        m = all_m[band]
        base = np.concatenate([[0], np.cumsum(m)])
        at = np.repeat(np.arange(len(use)), n)
        token = tokens[np.repeat(first[use] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(at))]
        mixed = mix(token ^ mix(band.astype(U) + _SALT[2])[at])
        segment = (((mixed >> U(32)) * m[at].astype(U)) >> U(32)).astype(np.int64)
        cell = base[at] + segment
        total = np.zeros(base[-1], U)
        value = mix(token + _SALT[3])
        np.add.at(total, cell, value)
        held = np.bincount(cell, minlength=base[-1])
        of = np.repeat(np.arange(len(use)), m)
        number = np.arange(base[-1]) - base[of]
        place = mix((band[of].astype(U) << U(32)) + number.astype(U) + U(1))
        key = mix(total ^ place ^ held.astype(U))
        bad = (held == 0) | np.isin(key, heavy)
        deficit = np.bincount(of, bad, len(use)).astype(np.int64) - all_slack[band]
        emit = ~bad
        short = deficit > 0
        if short.any():
            near = np.flatnonzero(short[at] & (segment % EVERY == 0))
            where = cell[near]
            gone = mix((total[where] - value[near]) ^ place[where] ^ (held[where] - 1).astype(U))
            spoilt = np.zeros(base[-1], bool)
            spoilt[where[(held[where] == 1) | np.isin(gone, heavy)]] = True
            chosen = short[of] & (number % EVERY == 0)
            worth = chosen & ~bad & ~spoilt
            covered = np.bincount(of, worth, len(use)) >= deficit
            emit |= bad & (short & ~covered)[of]
            plain = np.flatnonzero(chosen & ~bad)
            light = np.flatnonzero(~((held[where] == 1) | np.isin(gone, heavy)))
            rows += [use[of[plain]], use[at[near[light]]]]
            keys += [mix(key[plain] + _SALT[1]), mix(gone[light] + _SALT[1])]
        rows.append(use[of[emit]])
        keys.append(key[emit])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(rows), np.concatenate(keys)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash, about two bits a token.

    Two sketches, folded to one length, differ in no more bits than the sets differ in tokens.
    """
    length = min(16384, max(256, 1 << int(2 * len(tokens) - 1).bit_length())) if len(tokens) else 256
    odd = np.bincount((mix(tokens) & U(length - 1)).astype(np.int64), minlength=length) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(bits, U).reshape(-1, size // 8), axis=0)


@released
def describe(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, size, high, low, bits): the size of each row's set, a 128-bit digest and a sketch of it."""
    for batch in batches:
        for a, b, tokens, first in _sets(batch.column("text"), n):
            high, low = _digests(tokens, first)
            bits = pa.array([_sketch(tokens[s:e]) for s, e in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first)), _long(high), _long(low), bits], ["doc_id", "size", "high", "low", "bits"])


@released
def plausible(p: int, q: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (a, b) of rows (a, b, s, t, x, y) whose sizes and sketches don't rule similarity out."""
    for batch in batches:
        size, other = (np.asarray(batch.column(c)) for c in ("s", "t"))
        keep = q * np.minimum(size, other) >= p * np.maximum(size, other)
        left, right = batch.column("x"), batch.column("y")
        for i in np.flatnonzero(keep):
            x, y = left[i].as_py(), right[i].as_py()
            least = min(len(x), len(y))
            differ = int(np.bitwise_count(_folded(x, least) ^ _folded(y, least)).sum())
            keep[i] = differ * (q + p) <= (q - p) * int(size[i] + other[i])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


@released
def signatures(scheme: Scheme, heavy: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, salt, doc_id) rows. Equal sets met again in the same task emit nothing: their digest links them.

    Rows with a null id emit nothing and stand for no set, as no digest links them. A heavy key, where it is
    emitted all the same, has a salt from 1 on by its document, so that it is dealt out to many tasks.
    """
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for a, b, tokens, first in _sets(batch.column("text"), scheme.n):
            ids = batch.column("doc_id").slice(a, b - a)
            fresh = np.asarray(ids.is_valid())
            for i, digest in enumerate(zip(*(x.tolist() for x in _digests(tokens, first)), strict=True)):
                fresh[i] &= digest not in seen
                if fresh[i] and len(seen) < 100_000:
                    seen.add(digest)
            size = np.diff(first)
            kept = np.repeat(fresh, size)
            tokens, first = tokens[kept], np.concatenate([[0], np.cumsum(size * fresh)])
            rows, keys = _keys(tokens, first, scheme, heavy)
            ids = ids.take(pa.array(rows))
            salt = np.zeros(len(keys), np.int8)
            hot = np.flatnonzero(np.isin(keys, heavy))
            salt[hot] = 1 + (mix(np.asarray(ids.take(pa.array(hot))).astype(np.int64).view(U)) % U(SPREAD)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([_long(keys), pa.array(salt), ids], ["key", "salt", "doc_id"])


@released
def shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, salt, doc_id) sorted by all: (key, salt, least, doc_id) of the keys that several documents hold.

    A batch at a time; a key that runs on into the next batch keeps only its key, salt and least document.
    Of salted keys all rows stay, as other salts may hold the other documents.
    """
    at, least, held = None, None, None  # key and salt of the last row; held: that row, as long as it's its key's only one
    for batch in batches:
        keys, salts, docs = (np.asarray(batch.column(c)) for c in ("key", "salt", "doc_id"))
        if not len(keys):
            continue
        new = np.concatenate([[at is None or (keys[0], salts[0]) != at], (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])])
        group = np.cumsum(new)  # 0: goes on from the batch before
        starts = np.flatnonzero(new)
        leasts = np.concatenate([[least if least is not None else 0], docs[starts]])[group]
        counts = np.bincount(group, minlength=len(starts) + 1)
        single = (counts[group] == 1) & (salts == 0)
        single[group == 0] = False
        last_single = bool(single[-1])
        keep = ~single
        out = [keys[keep], salts[keep], leasts[keep], docs[keep]]
        if not new[0] and held is not None:
            out = [np.concatenate([[x], y]).astype(y.dtype) for x, y in zip((*at, least, least), out, strict=True)]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "salt", "least", "doc_id"])
        if len(starts):
            held = True if last_single else None
        else:
            held = None
        at, least = (int(keys[-1]), int(salts[-1])), int(leasts[-1])


@released
def set_rows(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens): the sorted distinct tokens as bytes."""
    for batch in batches:
        for a, b, tokens, first in _sets(batch.column("text"), n):
            own = [tokens[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(own, pa.binary())], ["doc_id", "tokens"])


@released
def compare(p: int, q: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with q * |intersection| >= p * |union|."""
    for batch in batches:
        left, right = batch.column("x"), batch.column("y")
        keep = np.zeros(len(left), bool)
        for i in range(len(left)):
            x, y = (np.frombuffer(c[i].as_buffer(), U) for c in (left, right))
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep[i] = q * both >= p * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _near(p: int, q: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's rows (doc_id, label, block, size, bits) of different labels that their sketches don't rule out.

    Rows of two blocks are only compared across them.
    """
    doc, label, block, size = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    least = min(len(r[4]) for r in rows)
    bits = np.zeros((len(rows), least // 8), U)
    for i, r in enumerate(rows):
        bits[i] = _folded(r[4], least)
    two = len(np.unique(block)) > 1
    a, b = [], []
    for i in range(len(rows) - 1):
        use = label[i + 1 :] != label[i]
        if two:
            use &= block[i + 1 :] != block[i]
        j = i + 1 + np.flatnonzero(use)
        if len(j):
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(1).astype(np.int64)
            j = j[(differ * (q + p) <= (q - p) * (size[j] + size[i])) & (q * np.minimum(size[j], size[i]) >= p * np.maximum(size[j], size[i]))]
            a.append(np.full(len(j), doc[i]))
            b.append(doc[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


@released
def open_pairs(p: int, q: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) candidates of rows sorted by (key, i, j): each such group is at most two blocks."""
    at, rows = None, []

    def done():
        a, b = _near(p, q, rows)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "doc_id", "label", "block", "size", "bits")]
        for row in zip(*columns, strict=True):
            if row[:3] != at and rows:
                yield done()
                rows = []
            at = row[:3]
            rows.append(row[3:])
    if rows:
        yield done()


def _few(frame: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table, to be broadcast if it has at most so many rows."""
    return F.broadcast(frame) if frame.count() <= most else frame


def _cross(info: DataFrame, named: DataFrame, scheme: Scheme, work: Workspace) -> DataFrame:
    """Candidate (a, b) of different components in the open buckets, whichever size these have."""
    p, q = scheme.p, scheme.q
    ids = work.save(named.select("doc_id").distinct(), "cross-ids")
    bits = info.select("doc_id", "size", "bits").join(_few(ids), "doc_id", "left_semi")
    counts = named.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("k"))
    placed = named.select("key", "doc_id", "label").join(counts, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), "k"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")))
    placed = placed.withColumn("ij", F.explode(others)).select("key", "ij.i", "ij.j", "doc_id", "label", "block").join(bits, "doc_id")
    placed = placed.repartition(partitions(info.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return placed.mapInArrow(lambda x: open_pairs(p, q, x), "a long, b long")


def _promising(info: DataFrame, pairs: DataFrame, scheme: Scheme, work: Workspace, name: str) -> DataFrame:
    """The pairs that sizes and sketches, about a thirtieth of the sets' bytes, don't rule out."""
    p, q = scheme.p, scheme.q
    pairs = work.save(pairs.distinct(), f"{name}-all")
    ids = work.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-some")
    bits = info.select("doc_id", "size", "bits").join(_few(ids), "doc_id", "left_semi")
    left, right = (bits.select(F.col("doc_id").alias(k), F.col("size").alias(s), F.col("bits").alias(x)) for k, s, x in (("a", "s", "x"), ("b", "t", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t", "x", "y").mapInArrow(lambda x: plausible(p, q, x), "a long, b long")


def _verify(docs: DataFrame, pairs: DataFrame, scheme: Scheme, work: Workspace, name: str) -> DataFrame:
    """The (a, b) of pairs whose sets are similar."""
    pairs = work.save(pairs.distinct(), f"{name}-pairs")
    ids = work.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    texts = docs.join(_few(ids), "doc_id", "left_semi")
    n, p, q = scheme.n, scheme.p, scheme.q
    sets = work.save(texts.mapInArrow(lambda x: set_rows(n, x), "doc_id long, tokens binary"), f"{name}-sets")
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    links = work.save(full.mapInArrow(lambda x: compare(p, q, x), "a long, b long").distinct(), f"{name}-links")
    work.drop(*(f"{name}-{x}" for x in ("all", "some", "sets", "pairs", "ids")))
    return links


def _heavy(docs: DataFrame, scheme: Scheme) -> np.ndarray:
    """Keys that many of a bounded sample of documents hold: at most SAMPLE * keys a document / HEAVY of them."""
    total = docs.count()
    every = max(1, -(-total // SAMPLE))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    none = np.zeros(0, U)
    rows = sample.mapInArrow(lambda x: signatures(scheme, none, x), "key long, salt byte, doc_id long")
    found = rows.groupBy("key").count().where(F.col("count") >= HEAVY).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().view(U)) if found.num_rows else none


def similar_groups(documents: DataFrame, n: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents(doc_id, text, ...)``.

    A set holds the distinct n-word shingles of the lower-cased (A-Z) text; a text of fewer words is
    one shingle; a text without words, or null, has none and is linked with nothing. Documents with
    q * |intersection| >= p * |union| are linked, component_id is the smallest doc_id reachable.
    Rows with a null doc_id come out as their own component (null). A repeated doc_id is one node:
    its rows share a component, and its similarity is that of any of its texts. Empty tables give
    empty results; columns besides doc_id and text are not read.
    """
    spark = documents.sparkSession
    work, scheme = Workspace(spark, "ngram"), Scheme(n, p, q)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = docs.mapInArrow(lambda x: describe(n, x), "doc_id long, size long, high long, low long, bits binary")
    info = work.save(info, "info")
    known = info.where("size > 0 and doc_id is not null")
    # written before the join with its rows, so that Spark can split a hot group's rows
    least = work.save(known.groupBy("high", "low").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most")).where("b < most").drop("most"), "least")
    equal = known.join(least, ["high", "low"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    equal = work.save(equal, "equal")

    heavy = _heavy(docs, scheme)
    rows = docs.mapInArrow(lambda x: signatures(scheme, heavy, x), "key long, salt byte, doc_id long")
    rows = rows.repartition(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", "doc_id")
    buckets = work.save(rows.mapInArrow(shared_buckets, "key long, salt byte, least long, doc_id long"), "buckets")
    if len(heavy):
        # one least document for all salts of a key; heavy keys are bounded in number by the sample
        whole = work.save(buckets.where("salt > 0").groupBy("key").agg(F.min("least").alias("whole"), F.max("doc_id").alias("most")), "whole")
        buckets = buckets.join(F.broadcast(whole), "key", "left").where("salt = 0 OR whole < most").withColumn("least", F.coalesce("whole", "least"))
    buckets = buckets.select("key", "least", "doc_id")

    # each document against the least partner of all its buckets, then what the links found so far leave open
    first = buckets.where("doc_id <> least").groupBy("doc_id").agg(F.min("least").alias("a")).select("a", F.col("doc_id").alias("b"))
    links = equal.unionByName(_verify(docs, _promising(info, first, scheme, work, "first"), scheme, work, "first"))
    labels = components(links, work, "cc1")
    named = _once(_open_buckets(buckets, labels, work, "open1"), work)
    if not named.isEmpty():
        star = named.where("label <> least_label").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
        links = links.unionByName(_verify(docs, _promising(info, star, scheme, work, "star"), scheme, work, "star"))
        labels = components(links, work, "cc2")
        named = _open_buckets(named.select("key", "least", "doc_id"), labels, work, "open2")
        if not named.isEmpty():
            links = links.unionByName(_verify(docs, _cross(info, named, scheme, work), scheme, work, "cross"))
            labels = components(links, work, "cc3")
    out = info.select("doc_id", F.col("size").alias("n_shingles")).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _open_buckets(buckets: DataFrame, labels: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(key, least, doc_id, label, least_label) of the buckets that still hold documents of several components."""
    labels = _few(work.save(labels, f"{name}-labels"))
    named = buckets.join(labels.withColumnsRenamed({"node": "doc_id", "component": "label"}), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    named = named.join(mixed, "key", "left_semi")
    named = named.join(labels.withColumnsRenamed({"node": "least", "component": "least_label"}), "least", "left").withColumn("least_label", F.coalesce("least_label", "least"))
    return work.save(named.select("key", "least", "doc_id", "label", "least_label"), name)


def _once(named: DataFrame, work: Workspace) -> DataFrame:
    """One of the buckets that hold the same documents; those that share a passage often meet under dozens of keys."""
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), F.col("doc_id"))).alias(f"h{seed}") for seed in (1, 2)]
    same = named.groupBy("key").agg(F.count("*").alias("n"), *hashes).groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    return work.save(named.join(same.select("key"), "key", "left_semi"), "once")
