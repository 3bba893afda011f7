"""SentencePiece models on the ``tokenizers`` library: encoding and decoding without the original runtime.

The model's protobuf is parsed here. A unigram model becomes ``Unigram`` with its scores and byte
fallback, a BPE model becomes ``BPE`` with merges ranked by the scores of the pieces that they make.
The normaliser (character map, dummy prefix, extra white space) and the marker for spaces are rebuilt.

A merge of a BPE model makes a piece, so none reaches over two characters that stand side by side in
no piece. Texts are cut there, which leaves parts that repeat often: a chunk of texts is one Arrow
column of parts, the library encodes its distinct ones, many to a line, and ids are gathered by part.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glyphmill.llm.arrays import few_arenas, released, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Texts are encoded about so many bytes at a time, whole, and their distinct parts so many to a line.
BYTES, GROUP = 1 << 19, 64


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value = raw[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value = raw[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")
        yield number, kind, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces: bool = True
    escape_spaces: bool = True
    suffix: bool = False


def parse_model(raw: bytes) -> Model:
    """The parts of a ModelProto that encoding and decoding need."""
    model = Model()
    for number, _, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append(piece)
            model.scores.append(score)
            model.kinds.append(kind)
        elif number == 2:
            for n, _, v in _fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
                elif n == 24:
                    model.suffix = bool(v)
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.extra_spaces = bool(v)
                elif n == 5:
                    model.escape_spaces = bool(v)
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces whose join is a piece, by the join's score, then by the pair's ids."""
    usable = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
    found = []
    for piece, i in usable.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in usable and b in usable:
                found.append((-model.scores[i], usable[a], usable[b], a, b))
    return [x[3:] for x in sorted(found)]


class Codec:
    """Encodes and decodes texts with a parsed model."""

    def __init__(self, model: Model):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if model.suffix or not model.escape_spaces or model.model_type not in (UNIGRAM, BPE):
            raise ValueError("a model of this kind is not supported")
        self.model = model
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.extra_spaces:
            steps += [normalizers.Replace(Regex(r"\A +"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(steps)
        unk = model.pieces[model.unk_id]
        if model.model_type == UNIGRAM:
            # only ordinary pieces may match a text; unknown stretches are turned into bytes in encode()
            names = [p if k in (NORMAL, USER) else f"{_NEVER}{i}" for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))]
            least = min((s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL), default=0.0)
            scores = [s if k in (NORMAL, USER) else least for s, k in zip(model.scores, model.kinds, strict=True)]
            core = models.Unigram(list(zip(names, scores, strict=True)), unk_id=model.unk_id, byte_fallback=False)
            self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        else:
            vocabulary = {p: i for i, p in enumerate(model.pieces)}
            core = models.BPE(vocabulary, _merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
        self.tokenizer = Tokenizer(core)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
        self._joined = None if model.model_type == UNIGRAM or USER in model.kinds else _Joined(model)
        self._spelled()

    def _spelled(self) -> None:
        """Bytes of each piece, one after the other, as decoding writes them."""
        spelled = [bytes((int(p[3:5], 16),)) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        self.spelt = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelt_sizes = np.array([len(x) for x in spelled], np.int64)
        self.spelt_at = np.cumsum(self.spelt_sizes) - self.spelt_sizes

    def marked(self, text: str) -> str:
        """The text as the pieces see it: normalised, with the dummy prefix and markers for spaces."""
        text = self.normalizer.normalize_str(text) if self.model.charsmap or self.model.extra_spaces else text
        if text and self.model.dummy_prefix:
            text = " " + text
        text = text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.model.extra_spaces else text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        flat, first = self.ids_of([self.marked(x or "") for x in texts])
        return [flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def ids_of(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all marked texts in a row, and where each text's begin. The library's threads share a batch."""
        if self._joined is None:
            done = [self._with_bytes(x, e) for x, e in zip(marked, self.tokenizer.encode_batch(marked, add_special_tokens=False), strict=True)]
            return np.concatenate([*done, np.zeros(0, np.int32)]), _edges([len(x) for x in done])
        parts, first = self._joined.parts(marked)
        coded = parts.dictionary_encode()
        ids, at, sizes = self._distinct(coded.dictionary)
        which = coded.indices.to_numpy()
        return _ragged(ids, at, sizes, which), _edges(sizes[which])[first]

    def _distinct(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts: all in a row, and where each one's begin and how many it has.

        A line break that no longer piece holds parts words that are encoded together.
        """
        mark = self._joined.mark
        if mark is None:
            done = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(x) for x in done], np.int64)
            return np.concatenate([*done, np.zeros(0, np.int32)]), np.cumsum(sizes) - sizes, sizes
        lone = pc.equal(words, "\n")
        words = pc.if_else(lone, "", words.cast(pa.string()))
        groups = np.unique(np.append(np.arange(0, len(words), GROUP), len(words))).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups), words), "\n").to_pylist()
        done = [np.array([*e.ids, mark], np.int32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([*done, np.zeros(0, np.int32)])
        ends = np.flatnonzero(ids == mark)
        at = np.concatenate([[0], ends + 1])[:-1]
        own = lone.to_numpy(zero_copy_only=False)
        return ids, np.where(own, ends, at), np.where(own, 1, ends - at)

    def _with_bytes(self, text: str, encoding) -> np.ndarray:
        """Ids of a unigram encoding, each unknown stretch as its bytes where the model has these."""
        ids = encoding.ids
        if self.model.byte_fallback and self.model.unk_id in ids:
            ids = [j for i, (s, e) in zip(ids, encoding.offsets, strict=True) for j in ([self.byte_ids[b] for b in text[s:e].encode()] if i == self.model.unk_id else [i])]
        return np.array(ids, np.int32)

    def bytes_of(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ids of several texts spell, without dummy prefixes, and where each text begins."""
        data = _ragged(self.spelt, self.spelt_at, self.spelt_sizes, flat)
        edges = _edges(self.spelt_sizes[flat])[first]
        if not self.model.dummy_prefix:
            return data, edges
        begun = edges[:-1][edges[:-1] < edges[1:]]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[begun[data[begun] == 32]] = 1
        return data[gone[:-1] == 0], edges - (np.cumsum(gone) - gone)[edges]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids; the dummy prefix goes. Bytes that aren't UTF-8 are left to the library."""
        first = _edges([len(x) for x in ids])
        data, edges = self.bytes_of(np.concatenate([*(np.asarray(x, np.int64) for x in ids), np.zeros(0, np.int64)]), first)
        raw, out = data.tobytes(), []
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            try:
                out.append(raw[a:b].decode())
            except UnicodeDecodeError:
                x = self.tokenizer.decoder.decode([self.model.pieces[j] for j in ids[i]])
                out.append(x[1:] if self.model.dummy_prefix and x[:1] == " " else x)
        return out

    def plain(self, marked: str) -> str:
        """What decoding gives for a marked text, if no character is unknown."""
        x = marked.replace(SPACE, " ")
        return x[1:] if self.model.dummy_prefix else x


#: Begins the names of pieces that no text may match.
_NEVER = "\U0010ffff\U0010fffe never matched "


def _edges(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def _ragged(values: np.ndarray, at: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values[at[i] : at[i] + sizes[i]] for each i of which, one after the other."""
    n = sizes[which]
    end = np.cumsum(n)
    return values[np.arange(end[-1] if len(end) else 0) + np.repeat(at[which] - end + n, n)]


class _Joined:
    """Which characters stand side by side in a piece of a BPE model; a filter that may say so of others, too."""

    BITS = 20

    def __init__(self, model: Model):
        own = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL]
        self.classes = np.zeros(0x110000, np.uint16)
        known = sorted({c for p in own for c in p if len(p) > 1} | (set() if model.byte_fallback else {p for p in own if len(p) == 1}))
        self.classes[[ord(c) for c in known]] = (np.arange(len(known)) % 65535 + 1).astype(np.uint16)
        pairs = np.array([(ord(a), ord(b)) for p in own for a, b in zip(p, p[1:], strict=False)], np.int64).reshape(-1, 2)
        self.filter = np.zeros(1 << self.BITS, bool)
        self.filter[self._cell(*(self.classes[pairs[:, i]] for i in range(2)))] = True
        if not model.byte_fallback:  # unknown characters side by side are one unknown piece
            self.filter[0] = True
        alone = [i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if (p, k) in (("\n", NORMAL), ("<0x0A>", BYTE))]
        self.mark = alone[0] if len(alone) == 1 and (model.byte_fallback or model.kinds[alone[0]] == NORMAL) and not any("\n" in p and len(p) > 1 for p in own) else None

    def _cell(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint32) * np.uint32(40503) + b) & np.uint32((1 << self.BITS) - 1)

    def parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, and where each text's begin."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = _edges([len(x) for x in texts])
        cut = np.ones(len(points) + 1, bool)
        own = self.classes[points]
        cut[1:-1] = ~self.filter[self._cell(own[:-1], own[1:])] if len(points) else True
        if self.mark is not None:
            lone = np.flatnonzero(points == 10)
            cut[lone] = cut[lone + 1] = True
        cut[ends] = True
        places = np.flatnonzero(cut) if len(points) else np.zeros(1, np.int64)
        size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offsets = _edges(size)[places]
        raw = "".join(texts).encode()
        return pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)), np.searchsorted(places, ends)


@functools.lru_cache(maxsize=4)
def codec(raw: bytes) -> Codec:
    few_arenas()
    return Codec(parse_model(raw))


def encoded(documents: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all of them if None) with n_tokens, ids (array<int>) and decoded.

    The model's bytes travel with the task. A null text has no tokens and decodes to ''. Names that
    clash with the added columns are replaced. Rows are encoded about BYTES of text at a time, whole;
    each stands alone, so repeated rows and null ids come out as they are, and an empty table gives none.
    """
    keep = [c for c in (keep or documents.columns) if c not in ("n_tokens", "ids", "decoded")]
    own = "text" in keep  # then it is sent once
    source = documents.select(*keep) if own else documents.select(*keep, documents["text"].alias("_text"))
    place = keep.index("text") if own else len(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            for part, texts in _slices(batch, place):
                flat, first = coder.ids_of([coder.marked(x) for x in texts])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
                decoded = coder.decode([flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(first)), lists, pa.array(decoded, pa.string())], [*keep, "n_tokens", "ids", "decoded"])

    return source.mapInArrow(run, (schema + ", " if schema else "") + "n_tokens long, ids array<int>, decoded string")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about BYTES of text, and their texts; null counts as empty."""
    for a, b in slices(batch.column(column), BYTES):
        part = batch.slice(a, b - a)
        yield part, [x or "" for x in part.column(column).to_pylist()]


def token_digests(documents: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, n_unknown, ids_sha256, decoded_sha256, round_trip) of each whole text.

    ids_sha256 is of the ids as little-endian 32-bit numbers; round_trip tells whether decoding gives
    back the normalised text, which holds unless a character has neither a piece nor byte fallback.
    Null counts as empty, which has no tokens; each row stands alone, and only doc_id and text are read.
    """
    names = ["n_tokens", "n_unknown", "ids_sha256", "decoded_sha256", "round_trip"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            for part, texts in _slices(batch, 1):
                marked = [coder.marked(x) for x in texts]
                flat, first = coder.ids_of(marked)
                unknown = _edges(flat == coder.model.unk_id)[first]
                decoded = [x.encode() for x in coder.decode([flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])]
                little = flat.astype("<i4")
                rows = [
                    (b - a, n, hashlib.sha256(little[a:b].tobytes()).hexdigest(), hashlib.sha256(y).hexdigest(), y == coder.plain(m).encode())
                    for a, b, n, m, y in zip(first[:-1].tolist(), first[1:].tolist(), np.diff(unknown).tolist(), marked, decoded, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    schema = "n_tokens long, n_unknown long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {schema}")


def load_model(path: str = MODEL) -> bytes:
    """A model file from the driver's disk; executors get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def parity(raw: bytes, texts: list[str]) -> list[int]:
    """Numbers of the texts whose ids differ from the sentencepiece library's.

    None for BPE. For unigram models the library adds scores in 32 bits, so over long texts it may pick
    another segmentation of (nearly) the same score.
    """
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return [i for i, (x, y) in enumerate(zip(codec(raw).encode(texts), other.encode(texts), strict=True)) if x.tolist() != y]
