"""Secret scans: fixed patterns, and a token-efficiency test for random strings without one.

Ordinary text takes few tokens of a byte-pair vocabulary, a random string takes many: a long run of
key characters with a low number of characters a token is reported, unless patterns' spans cover it or
it has the form of a known digest, a UUID, a number or an identifier made of words. A run that holds
hex or access spans is judged by the rest of it and reported whole; one that an assignment's key ends,
by what comes before.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.arrays import released, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
#: A run of so many characters or more is random if it has fewer characters a token than RATIO.
LEAST, RATIO = 20, 2.1
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_HINTS = ("passw", "secret", "token", "api")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: The split of text before byte-pair merges: runs of letters, of digits, of others.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a rank file. Executors read it once each; every node has it at the same path."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def is_random(parts: list[str], vocabulary: str = VOCABULARY) -> bool:
    """Fewer characters a token than RATIO, the parts together."""
    return sum(map(len, parts)) < RATIO * sum(len(encoding(vocabulary).encode_ordinary(x)) for x in parts)


def is_known(run: str, vocabulary: str = VOCABULARY) -> bool:
    """A digest, UUID or number, or an identifier: made of words of three letters or more, which take few tokens, with short numbers."""
    if _DIGEST.fullmatch(run) or not any(c.isalpha() for c in run):
        return True
    parts = _PART.findall(run)
    letters = [p for p in parts if p.isalpha()]
    one_case = len(letters) == len(parts) and (run.lower() == run or run.upper() == run)
    words = one_case or (all(len(p) >= 3 for p in letters) and all(len(p) <= 4 for p in parts if p.isdigit()))
    return words and not is_random(letters, vocabulary)


def scan(text: str | None, vocabulary: str = VOCABULARY) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind as listed; code points, end exclusive. Null has none."""
    text, found = text or "", []
    lower = text.lower()
    if any(x in lower for x in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    for m in _RUN.finditer(text):
        start, end = m.span()
        over = [(s, k, e) for s, k, e in base if s < end and start < e]
        end = min([end, *(s for s, k, _ in over if k == 0)])  # an assignment's value goes on to the run's end
        if end - start < LEAST:
            continue
        rest, at = [], start
        for s, _, e in [*(x for x in over if x[1] and x[0] < end), (end, 3, end)]:
            if s > at:
                rest.append(text[at:s])
            at = max(at, e)
        rest = [x for x in rest if not is_known(x, vocabulary)]
        if rest and is_random(rest, vocabulary):
            found.append((start, 3, end))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_spans(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each whole text.

    A null or empty text has no spans and the digest of an empty list. Each row stands alone, so ties,
    repeated rows and null ids come out as they are; other columns are not read.
    """
    names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                spans = scan(text.as_py(), vocabulary)
                base = listed([x for x in spans if x[0] != "random"])
                rows.append((*(sum(x[0] == k for x in spans) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), listed(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])

    schema = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {schema}")


def redact(documents: DataFrame, mark: str = "[SECRET]", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with every span (overlapping ones together) replaced by ``mark``; no row is dropped.

    A null text stays null, and its row as it is. ``n_chars``, where there is one, is set to the new length.
    """
    import pyspark.sql.functions as F

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, s, e in scan(text, vocabulary):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text

    names, place = documents.columns, documents.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(place)):
                part = batch.slice(a, b - a)
                texts = pa.array([clean(x) for x in part.column(place).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == place else x for i, x in enumerate(part.columns)], names)

    new = documents.mapInArrow(run, documents.schema)
    return new.withColumn("n_chars", F.coalesce(F.char_length("text").cast(documents.schema["n_chars"].dataType), "n_chars")) if "n_chars" in documents.columns else new
