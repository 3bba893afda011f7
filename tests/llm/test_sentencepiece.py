import hashlib
import math
import random
import struct

import numpy as np
import pytest
import sentencepiece

from glyphmill.llm import sentencepiece_tok as sp
from glyphmill.llm.queries import QUERIES

ODD = ["a", "  ", " ", "\n", "é", "日本", "▁", "▁▁", "😀", "the", "\t", "<s>", "<unk>", "<0x41>", " x", "token", "ing", "​", "\x00"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 12))) for _ in range(n)]


def varint(n):
    out = b""
    while True:
        out += bytes((n & 127 | (128 if n > 127 else 0),))
        n >>= 7
        if not n:
            return out


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram(fallback, dummy=True, extra=False):
    """A small hand-written unigram model."""
    r = random.Random(3)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "a", "b", "t", "h", "e", "i", "n", "g", "x", "the", "▁the", "ing", "▁a", "th", "he", "▁x", "to", "o", "k", "ken", "▁token", "in", "ng"]
    pieces += [(w, -r.uniform(1, 12), 1) for w in words]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    trainer = message((3, 1), (35, int(fallback)), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))
    normal = message((1, b"identity"), (3, int(dummy)), (4, int(extra)), (5, 1))
    return body + message((2, trainer), (3, normal))


def test_parity_on_the_public_model(spark, sf):
    raw = sp.load_model()
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + odd_texts(1500)
    assert sp.parity(raw, texts) == []
    own, other = sp.codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids = own.encode(texts)
    assert own.decode(ids) == [other.decode(x.tolist()) for x in ids]


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("extra", [False, True])
def test_parity_on_a_unigram_model(fallback, dummy, extra):
    raw = unigram(fallback, dummy, extra)
    assert sp.parity(raw, odd_texts(800, 7)) == []


def test_parse_model():
    model = sp.parse_model(unigram(True))
    assert (model.pieces[0], model.kinds[0], model.byte_fallback, model.model_type, model.unk_id) == ("<unk>", 2, True, sp.UNIGRAM, 0)


@pytest.mark.parametrize("group", [1, 3, 64])
def test_texts_alone_and_together(monkeypatch, group):
    monkeypatch.setattr(sp, "GROUP", group)
    coder, texts = sp.codec(sp.load_model()), [*odd_texts(200), "a\nb\n\n c\n", "\n", "\n\n"]
    alone = [x.tolist() for t in texts for x in coder.encode([t])]
    assert alone == [x.tolist() for x in coder.encode(texts)]
    assert sp.parity(sp.load_model(), texts) == []


def test_parity_on_unspaced_text():
    text = "".join(chr(0x3042 + i * i % 80) + "漢字"[i % 2] for i in range(3000))
    coder = sp.codec(sp.load_model())
    assert sp.parity(sp.load_model(), [text, text + "\n" + text]) == []
    assert len(coder._joined.parts([coder.marked(text)])[0]) > 1000


def converted(model_type, rule):
    """The public model's pieces as a model of another type, with a character map of the library's."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    charsmap = sp.parse_model(spec).charsmap
    model = sp.parse_model(sp.load_model())
    # a BPE model's scores are whole numbers, whose sums tie: for the unigram type they are spread
    scores = model.scores if model_type == sp.BPE else [-3 - math.sqrt(-s) / 20 - math.sin(i) / 100 if k == 1 else 0.0 for i, (s, k) in enumerate(zip(model.scores, model.kinds, strict=True))]
    body = b"".join(message((1, message((1, p.encode()), (2, float(s)), (3, k)))) for p, s, k in zip(model.pieces, scores, model.kinds, strict=True))
    trainer = message((3, model_type), (35, 1), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))
    return body + message((2, trainer), (3, message((1, rule.encode()), (2, charsmap), (3, 1), (4, 1), (5, 1))))


WIDE = ["ﬁne", "①", "ｆｕｌｌ", "Ⅳ", "é", "½ x", "  ", "\u3000", "…", "Ａ1", "㎏", "a\tb", "ß", "한", "ö"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("model_type", [sp.UNIGRAM, sp.BPE])
def test_parity_with_a_character_map(spark, sf, model_type, rule):
    raw = converted(model_type, rule)
    assert len(sp.parse_model(raw).charsmap) > 1000
    r = random.Random(5)
    texts = ["".join(r.choice(WIDE + ODD[:3]) for _ in range(r.randint(0, 9))) for _ in range(400)]
    assert sp.parity(raw, texts) == []
    # over long texts the library's 32-bit sums decide between segmentations of (nearly) equal scores
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own, other, scores = sp.codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw), sp.parse_model(raw).scores
    odd = sp.parity(raw, texts)
    assert len(odd) < len(texts) / 4 and (model_type == sp.UNIGRAM or not odd)
    for i in odd:
        a, b = own.encode([texts[i]])[0].tolist(), other.encode(texts[i])
        best, second = sum(scores[j] for j in a), sum(scores[j] for j in b)
        assert second - 1e-9 * abs(best) <= best <= second + 1e-6 * abs(best)
        assert own.decode([a]) == [other.decode(b)]


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    other = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    rows = QUERIES["op8_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(texts) and all(r.round_trip and not r.n_unknown for r in rows)
    for r in rows:
        ids = other.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "x " * 100_000, 7), (2, "a\n", 8)], "doc_id long, text string, n_tokens int")
    rows = sp.encoded(docs, sp.load_model()).collect()
    assert sorted((str(r.doc_id), r.n_tokens, (r.decoded or "")[:2]) for r in rows) == [("1", 0, ""), ("2", 2, "a\n"), ("2", 100_001, "x "), ("None", 0, "")]
    assert sp.encoded(docs.limit(0), sp.load_model()).collect() == []
