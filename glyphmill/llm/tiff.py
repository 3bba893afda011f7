"""TIFF columns: write samples as TIFF, walk image directories, and emit one row per page.

Reads classic and big TIFF of either byte order, strips and tiles, chunky or planar, stored plain or
as PackBits, LZW or deflate, with horizontal (8, 16, 32 bit) or floating-point predictors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.arrays import slices

PLAIN, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
SUB_IFDS = 330
_KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "2I", 6: "b", 7: "B", 8: "h", 9: "i", 10: "2i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: A page of more bytes is an error in its row, as its header alone may ask for any amount of memory.
MAX_PAGE = 1 << 30
#: Texts are stored about so many bytes at a time.
BYTES = 16 << 20
PAGE_SCHEMA = "page int, parent int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, data binary, error string"


def packbits_encode(raw: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals of up to 128 bytes."""
    x, out = np.frombuffer(raw, np.uint8), bytearray()
    cuts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, int)
    lengths = np.diff(cuts)
    literal = 0
    for k in [*np.flatnonzero(lengths >= 3).tolist(), -1]:
        start = int(cuts[k]) if k >= 0 else len(raw)
        for i in range(literal, start, 128):
            piece = raw[i : min(start, i + 128)]
            out.append(len(piece) - 1)
            out += piece
        if k >= 0:
            left = int(lengths[k])
            literal = start + left
            while left:
                n = min(left, 128)
                out += bytes(((257 - n) & 255, raw[start])) if n > 1 else bytes((0, raw[start]))
                left -= n
    return bytes(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < size:
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, 9 to 12 bits, one code early."""
    out, hold, held = bytearray(), 0, 0
    table: dict[tuple[int, int], int] = {}
    code, width, following = -1, 9, 258

    def put(value: int) -> None:
        nonlocal hold, held
        hold, held = (hold << width) | value, held + width
        while held >= 8:
            held -= 8
            out.append((hold >> held) & 255)
        hold &= (1 << held) - 1

    put(256)
    for byte in raw:
        if code < 0:
            code = byte
            continue
        found = table.get((code, byte))
        if found is not None:
            code = found
            continue
        put(code)
        table[code, byte] = following
        following += 1
        if following == 4094:
            put(256)
            table, width, following = {}, 9, 258
        elif following >= 1 << width and width < 12:
            width += 1
        code = byte
    if code >= 0:
        put(code)
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append((hold << (8 - held)) & 255)
    return bytes(out)


def lzw_decode(raw: bytes, size: int) -> bytes:
    out, hold, held, at = bytearray(), 0, 0, 0
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, before = list(base), 9, b""
    while len(out) < size:
        while held < width and at < len(raw):
            hold, held, at = ((hold << 8) | raw[at]) & 0xFFFFFF, held + 8, at + 1
        if held < width:
            break
        held -= width
        code = (hold >> held) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(base), 9, b""
            continue
        if not before:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("bad LZW code")
            word = table[code] if code < len(table) else before + before[:1]
            table.append(before + word[:1])
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        out += word
        before = word
    return bytes(out)


def _inflate(raw: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(raw, size)


@dataclass
class Page:
    page: int
    parent: int | None = None
    width: int = 0
    height: int = 0
    bits: int = 0
    samples: int = 1
    compression: int = PLAIN
    predictor: int = 1
    tiled: bool = False
    data: bytes = b""
    error: str | None = None
    tags: dict = field(default_factory=dict)

    def row(self) -> tuple:
        return (self.page, self.parent, self.width, self.height, self.bits, self.samples, self.compression, self.predictor, self.tiled, self.data, self.error)


def _unpredict(block: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Bytes of a decoded strip or tile, one row each, in the file's byte order."""
    step = (width * samples * bits + 7) // 8
    if len(block) < rows * step:
        raise ValueError("too short a strip or tile")
    x = np.frombuffer(block[: rows * step], np.uint8).reshape(rows, step)
    if predictor == 2:
        kind = np.dtype({8: "u1", 16: "u2", 32: "u4"}[bits]).newbyteorder(order)
        y = np.ascontiguousarray(x).view(kind).reshape(rows, width, samples)
        return np.ascontiguousarray(np.cumsum(y, axis=1, dtype=kind.newbyteorder("="))).astype(kind).reshape(rows, -1).view(np.uint8)
    if predictor == 3:
        n = bits // 8
        y = np.cumsum(x.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, n, width * samples)
        y = y if order == ">" else y[:, ::-1]
        return np.ascontiguousarray(y.transpose(0, 2, 1)).reshape(rows, -1)
    if predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return x


def _image(raw: bytes, page: Page, order: str) -> bytes:
    tags = page.tags
    one = lambda tag, default: int(tags.get(tag, [default])[0])
    page.width, page.height, page.samples = one(256, 0), one(257, 0), one(277, 1)
    page.bits, page.compression, page.predictor = one(258, 1), one(259, PLAIN), one(317, 1)
    page.tiled = 322 in tags
    planes = page.samples if one(284, 1) == 2 and page.samples > 1 else 1
    inner = page.samples // planes
    if one(266, 1) != 1:
        raise ValueError("fill order")
    if page.tiled:
        across, down = one(322, 0), one(323, 0)
        where, sizes = tags.get(324, []), tags.get(325, [])
    else:
        across, down = page.width, min(one(278, page.height), page.height)
        where, sizes = tags.get(273, []), tags.get(279, [])
    if min(page.width, page.height, across, down) <= 0:
        raise ValueError("no size")
    line = (page.width * inner * page.bits + 7) // 8
    if line * page.height * planes > MAX_PAGE or across * down * inner * page.bits > 8 * MAX_PAGE:
        raise ValueError("too large a page")
    if page.tiled and page.bits < 8:
        raise ValueError("tiles of less than 8 bits")
    columns, lines = -(-page.width // across), -(-page.height // down)
    if len(where) < columns * lines * planes or len(sizes) < len(where):
        raise ValueError("too few strips or tiles")
    codec = {PLAIN: lambda x, n: x, LZW: lzw_decode, DEFLATE: _inflate, 32946: _inflate, PACKBITS: packbits_decode}.get(page.compression)
    if codec is None:
        raise ValueError(f"compression {page.compression}")
    out = np.zeros((planes, page.height, line), np.uint8)
    step = (across * inner * page.bits + 7) // 8
    for k in range(columns * lines * planes):
        plane, rest = divmod(k, columns * lines)
        y, x = rest // columns * down, rest % columns
        rows = down if page.tiled else min(down, page.height - y)
        block = codec(raw[where[k] : where[k] + sizes[k]], rows * step)
        cells = _unpredict(block, rows, across, inner, page.bits, page.predictor, order)
        part = out[plane, y : y + rows, x * step : (x + 1) * step]
        part[:] = cells[: part.shape[0], : part.shape[1]]
    if planes > 1:
        n = page.bits // 8
        out = out.reshape(planes, page.height, page.width, n).transpose(1, 2, 0, 3)
    return out.tobytes()


def read_pages(raw: bytes | None) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; what can't be read has ``error`` set.

    Directories below a page's (SubIFDs) follow it as pages of their own, with its number as ``parent``.
    """
    raw = raw or b""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2], "")
    if not order or len(raw) < 8:
        yield Page(0, error="not a TIFF file")
        return
    magic = struct.unpack_from(order + "H", raw, 2)[0]
    big = magic == 43
    if magic not in (42, 43):
        yield Page(0, error="not a TIFF file")
        return
    number, entry, wide = ("Q", 20, "Q") if big else ("H", 12, "I")
    first = struct.unpack_from(order + wide, raw, 8 if big else 4)[0] if len(raw) >= (16 if big else 8) else 0
    waiting, seen, count = [(first, None)], set(), 0
    while waiting:
        at, parent = waiting.pop(0)
        if not at:
            continue
        page = Page(count, parent)
        if at in seen:
            page.error = "the directories form a loop"
            yield page
            return
        seen.add(at)
        following = 0
        try:
            n = struct.unpack_from(order + number, raw, at)[0]
            start = at + struct.calcsize(number)
            for k in range(n):
                tag, kind, length = struct.unpack_from(order + "HH" + wide, raw, start + k * entry)
                if kind not in _KINDS:
                    continue
                form = _KINDS[kind]
                form = order + str(length * (2 if len(form) == 2 else 1)) + form[-1]
                place = start + k * entry + (12 if big else 8)
                if struct.calcsize(form) > (8 if big else 4):
                    place = struct.unpack_from(order + wide, raw, place)[0]
                page.tags[tag] = struct.unpack_from(form, raw, place)
            following = struct.unpack_from(order + wide, raw, start + n * entry)[0]
        except struct.error as e:
            page.error = f"directory: {e}"
        if page.error is None:
            try:
                page.data = _image(raw, page, order)
            except (ValueError, KeyError, IndexError, zlib.error, OverflowError) as e:
                page.error = str(e) or type(e).__name__
        yield page
        waiting = [(x, count) for x in page.tags.get(SUB_IFDS, ()) if isinstance(x, int)] + [(following, parent), *waiting]
        count += 1


def write_tiff(payload: bytes, width: int, rows_per_page: int = 112, codec: int = DEFLATE, tiled: bool = False, strip: int = 16, tile: tuple[int, int] = (64, 16)) -> bytes:
    """8-bit grey pages of ``width`` samples a row; the payload is a whole number of rows."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    encode = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: packbits_encode}[codec]
    predict = codec in (LZW, DEFLATE)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(image), rows_per_page):
        part = image[top : top + rows_per_page]
        if tiled:
            across, down = tile
            padded = np.zeros((-(-len(part) // down) * down, -(-width // across) * across), np.uint8)
            padded[: len(part), :width] = part
            blocks = [padded[y : y + down, x : x + across] for y in range(0, len(padded), down) for x in range(0, padded.shape[1], across)]
        else:
            blocks = [part[y : y + strip] for y in range(0, len(part), strip)]
        where, sizes = [], []
        for block in blocks:
            if predict:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            stored = encode(block.tobytes())
            where.append(len(out))
            sizes.append(len(stored))
            out += stored
        out += b"\0" * (len(out) % 2)
        tags = [(256, 4, [width]), (257, 4, [len(part)]), (258, 3, [8]), (259, 3, [codec]), (262, 3, [1]), (277, 3, [1])]
        tags += [(322, 4, [tile[0]]), (323, 4, [tile[1]]), (324, 4, where), (325, 4, sizes)] if tiled else [(273, 4, where), (278, 4, [strip]), (279, 4, sizes)]
        tags += [(317, 3, [2])] if predict else []
        entries, more = b"", b""
        begin = len(out) + 2 + 12 * len(tags) + 4
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"<{len(values)}{_KINDS[kind]}", *values)
            if len(value) > 4:
                value, more = struct.pack("<I", begin + len(more)), more + value
            entries += struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + more + b"\0" * (len(more) % 2)
    return bytes(out)


def tiff_pages(files: DataFrame, content: str = "content", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per page of each file: the key columns, then PAGE_SCHEMA.

    A null or unreadable file gives one row whose ``error`` says why; an empty table gives none.
    Files are read one at a time, so memory is bounded by the largest file and page.
    """
    names = [*keys, *(x.split()[0] for x in PAGE_SCHEMA.split(", "))]
    schema = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys) + ", " + PAGE_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 8 + [pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                for page in read_pages(batch.column(len(keys))[i].as_py()):
                    own = [batch.column(k).slice(i, 1) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([x], t) for x, t in zip(page.row(), kinds, strict=True))], names)

    return files.select(*keys, content).mapInArrow(run, schema)


# --- texts as media -------------------------------------------------------------------------------

BLOCK = 576


def _payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\xff")


def store_text(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the TIFF that holds them padded to whole rows of 576.

    Codec and layout follow from a checksum of the payload: mostly deflate, some PackBits and LZW.
    """
    n, payload = _payload(text)
    pick = zlib.crc32(payload)
    codec = LZW if pick % 32 == 0 else PACKBITS if pick % 32 < 5 else DEFLATE
    return n, write_tiff(payload, BLOCK, codec=codec, tiled=bool(pick >> 8 & 1))


def page_features(page: Page) -> tuple[float, int]:
    """Mean of the samples, and signs of the differences between means of 8 x 9 parts of the page."""
    x = np.frombuffer(page.data, np.uint8).reshape(page.height, -1).astype(np.float64)
    sums = np.zeros((page.height + 1, x.shape[1] + 1))
    sums[1:, 1:] = x.cumsum(0).cumsum(1)
    down, across = (np.linspace(0, n, k + 1).astype(int) for n, k in ((page.height, 8), (x.shape[1], 9)))
    down = np.stack([down[:-1], np.maximum(down[1:], np.minimum(down[:-1] + 1, page.height))])
    down[0] = np.minimum(down[0], down[1] - 1)
    block = sums[down[1]][:, across[1:]] - sums[down[0]][:, across[1:]] - sums[down[1]][:, across[:-1]] + sums[down[0]][:, across[:-1]]
    block /= (down[1] - down[0])[:, None] * np.diff(across)[None, :]
    bits = (block[:, 1:] > block[:, :-1]).ravel()
    return float(x.mean()), int.from_bytes(np.packbits(bits).tobytes())


def text_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text of ``documents(doc_id, text, ...)`` stored as a TIFF; null counts as empty.

    Rows stand alone: repeated rows and null ids come out as they are, an empty table gives none, and
    other columns aren't read. Slices of a batch are cut by bytes, a longer text is one of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), BYTES):
                part = batch.slice(a, b - a)
                stored = [store_text(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in stored], pa.int64()), pa.array([x for _, x in stored], pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """What the pages of ``media(doc_id, n_bytes, media)`` hold together, read back from the stored bytes.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes,
    media_sha256, n_pages, feature (per page its mean and a 64-bit difference hash, joined by ';') and
    error. A file with a page that can't be read, or null, has ``error`` set and no payload or feature.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pages", "feature", "error"]

    def one(n: int | None, raw: bytes | None) -> tuple:
        digest, tail, size, pages, features, error = hashlib.sha256(), b"", 0, 0, [], None
        for page in read_pages(raw):
            error = error or page.error
            if not page.error and not error:
                digest.update(page.data)
                tail, size = (tail + page.data)[-32:], size + len(page.data)
                features.append("{:.4f}:{:016x}".format(*page_features(page)))
            pages += 1
        payload = (None, None, None) if error else (size, digest.hexdigest(), zlib.crc32(tail))
        return n, *payload, None if raw is None else len(raw), None if raw is None else hashlib.sha256(raw).hexdigest(), pages, None if error else ";".join(features), error

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(n.as_py(), x.as_py()) for n, x in zip(batch.column("n_bytes"), batch.column("media"), strict=True)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pages long, feature string, error string"
    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {schema}")
