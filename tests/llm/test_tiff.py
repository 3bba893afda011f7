import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import tiff


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.tuples(st.integers(0, 255), st.integers(1, 400)), max_size=20).map(lambda x: b"".join(bytes((a,)) * n for a, n in x))))
def test_codecs_round_trip(raw):
    assert tiff.packbits_decode(tiff.packbits_encode(raw), len(raw)) == raw
    assert tiff.lzw_decode(tiff.lzw_encode(raw), len(raw)) == raw


def test_lzw_over_all_code_widths():
    raw = random.Random(1).randbytes(60_000) + b"ab" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(raw), len(raw)) == raw


@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("codec", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_pages(codec, tiled):
    payload = random.Random(codec).randbytes(100 * 37)
    pages = list(tiff.read_pages(tiff.write_tiff(payload, 100, 16, codec, tiled, strip=5)))
    assert [p.height for p in pages] == [16, 16, 5] and all(p.error is None and p.tiled == tiled for p in pages)
    assert b"".join(p.data for p in pages) == payload


def hand_made(order, bits, predictor, samples, planar, array):
    """A one-page file written by other means than write_tiff."""
    height, width = array.shape[:2]
    kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
    planes = [array[:, :, [s]] for s in range(samples)] if planar else [array]
    blobs = []
    for plane in planes:
        x = plane.astype(kind.newbyteorder("="))
        if predictor == 2:
            x = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)
        blobs.append(zlib.compress(x.astype(kind).tobytes()))
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    where = []
    for b in blobs:
        where.append(len(out))
        out += b
    far = len(out)
    out += struct.pack(f"{order}{len(where)}I", *where) + struct.pack(f"{order}{len(where)}I", *map(len, blobs))
    at = lambda i, v: v[0] if len(v) == 1 else far + i * 4 * len(v)
    tags = [(256, width), (257, height), (258, bits), (259, 8), (273, at(0, where)), (277, samples), (278, height), (279, at(1, list(map(len, blobs)))), (284, 2 if planar else 1), (317, predictor)]
    struct.pack_into(order + "I", out, 4, len(out))
    out += struct.pack(order + "H", len(tags))
    for tag, value in tags:
        out += struct.pack(order + "HHII", tag, 4, len(where) if tag in (273, 279) else 1, value)
    return bytes(out + b"\0\0\0\0")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [8, 16, 32])
@pytest.mark.parametrize("planar", [False, True])
def test_foreign_files(order, bits, planar):
    array = np.random.default_rng(3).integers(0, 1 << bits, (7, 9, 3), np.uint64)
    raw = hand_made(order, bits, 2, 3, planar, array)
    (page,) = tiff.read_pages(raw)
    assert page.error is None and (page.width, page.height, page.samples) == (9, 7, 3)
    got = np.frombuffer(page.data, np.dtype(f"u{bits // 8}").newbyteorder(order)).reshape(7, 9, 3)
    assert (got == array).all()


def test_broken_files_give_errors_not_failures():
    good = tiff.write_tiff(bytes(576 * 3), 576)
    for cut in range(0, len(good), 7):
        list(tiff.read_pages(good[:cut]))
    loop = bytearray(good)
    first = struct.unpack_from("<I", good, 4)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * struct.unpack_from("<H", good, first)[0], first)
    assert [p.error for p in tiff.read_pages(bytes(loop))] == [None, "the directories form a loop"]
    assert [p.error for p in tiff.read_pages(None)] == ["not a TIFF file"]


@pytest.mark.parametrize("codec", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_short_strips_are_errors(codec):
    """With each strip's byte count halved nothing is filled in."""
    raw = bytearray(tiff.write_tiff(random.Random(1).randbytes(100 * 30), 100, 30, codec, strip=10))
    at = struct.unpack_from("<I", raw, 4)[0]
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        tag, _, n, place = struct.unpack_from("<HHII", raw, at + 2 + 12 * k)
        if tag == 279:
            sizes = struct.unpack_from(f"<{n}I", raw, place)
            struct.pack_into(f"<{n}I", raw, place, *(x // 2 for x in sizes))
    (page,) = tiff.read_pages(bytes(raw))
    assert page.error and page.data == b""


def test_directories_below_a_page():
    """A file whose second and third page hang below the first."""
    raw = bytearray(tiff.write_tiff(bytes(range(90)), 10, 3, tiff.PLAIN, strip=3))
    at, places = struct.unpack_from("<I", raw, 4)[0], []
    while at:
        places.append(at)
        link = at + 2 + 12 * struct.unpack_from("<H", raw, at)[0]
        at = struct.unpack_from("<I", raw, link)[0]
    n = struct.unpack_from("<H", raw, places[0])[0]
    struct.pack_into("<HHII", raw, places[0] + 2 + 12 * (n - 1), tiff.SUB_IFDS, 4, 1, places[1])  # in place of the last tag, the strips' sizes
    struct.pack_into("<I", raw, places[0] + 2 + 12 * n, 0)
    pages = list(tiff.read_pages(bytes(raw)))
    assert [(p.page, p.parent) for p in pages] == [(0, None), (1, 0), (2, 0)] and pages[1].data == bytes(range(30, 60)) and pages[0].error
    assert pages[2].error is None


def test_operator_one_row_per_page(spark):
    raw = tiff.write_tiff(bytes(range(100)) * 30, 100, 16)
    files = spark.createDataFrame([("a", bytearray(raw), 1), ("b", None, 2), ("c", bytearray(b""), 3)], "path string, content binary, page int")
    rows = tiff.tiff_pages(files).collect()
    assert sorted((r.path, r.page, r.height, r.error) for r in rows) == [("a", 0, 16, None), ("a", 1, 14, None), ("b", 0, 0, "not a TIFF file"), ("c", 0, 0, "not a TIFF file")]
    assert b"".join(bytes(r.data) for r in sorted(rows) if r.path == "a") == bytes(range(100)) * 30


def test_query(spark, sf):
    from glyphmill.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_tiff_media"](spark, sf).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)


def test_edge_texts(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "é" * 288, 0), (4, "x" * 200_000, 0), (4, "x" * 200_000, 0)], "doc_id long, text string, n_bytes int")
    rows = tiff.media_digests(tiff.text_media(docs)).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in rows) == [(0, 576), (0, 576), (576, 576), (200_000, 200_448), (200_000, 200_448)]
    assert tiff.media_digests(tiff.text_media(docs.limit(0))).collect() == []


def test_bad_media_are_rows_with_an_error(spark):
    good = tiff.write_tiff(bytes(576), 576)
    media = spark.createDataFrame([(1, 0, bytearray(good)), (2, 0, bytearray(good[:-20])), (3, None, None)], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in tiff.media_digests(media).collect()}
    assert rows[1].error is None and rows[1].payload_bytes == 576
    assert rows[2].error and rows[2].payload_sha256 is None and rows[2].media_bytes == len(good) - 20
    assert rows[3].error == "not a TIFF file" and rows[3].media_sha256 is None
