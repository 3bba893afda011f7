"""Region files: 32 x 32 chunks behind a header of offsets and times, in sectors of 4096 bytes."""

from __future__ import annotations

import gzip
import struct
import zlib
from dataclasses import dataclass

from glyphmill.parse import nbt

# Fixed values of the format.
SECTOR, CHUNKS, LEAST = 4096, 1024, 8192
GZIP, ZLIB, PLAIN = 1, 2, 3


class RegionError(ValueError):
    pass


@dataclass
class Chunk:
    index: int
    kind: int
    data: bytes
    time: int

    def tree(self) -> object:
        return self.named()[1]

    def named(self) -> tuple[str, object]:
        """Name and tree; RegionError where the bytes aren't of a kind that is decoded here, or don't decode."""
        if self.kind not in (GZIP, ZLIB, PLAIN):
            raise RegionError(f"chunk {self.index} has compression {self.kind}")
        try:
            raw = {GZIP: gzip.decompress, ZLIB: zlib.decompress, PLAIN: bytes}[self.kind](self.data)
        except (OSError, EOFError, zlib.error) as e:
            raise RegionError(str(e)) from None
        return nbt.read(raw)

    def replaced(self, tree: object, name: str = "") -> Chunk:
        raw = nbt.write(tree, name)
        packed = {GZIP: lambda x: gzip.compress(x, mtime=0), ZLIB: zlib.compress, PLAIN: bytes}[self.kind](raw)
        return Chunk(self.index, self.kind, packed, self.time)


def sectors(size: int) -> int:
    """Sectors for a chunk of so many bytes with its 5-byte head; more than 255 can't be stored."""
    n = -(-size // SECTOR)
    if n > 255:
        raise RegionError("too large a chunk")
    return n


def read(raw: bytes) -> list[Chunk]:
    """The chunks of a file with their stored bytes, whatever their compression; a chunk whose bytes lie beyond the file's end has none and is left out."""
    if len(raw) < LEAST:
        raise RegionError("too small a file")
    offsets, times = struct.unpack_from(f">{CHUNKS}I", raw, 0), struct.unpack_from(f">{CHUNKS}I", raw, SECTOR)
    out = []
    for i, entry in enumerate(offsets):
        at, count = (entry >> 8) * SECTOR, entry & 255
        if not entry or at + 5 > len(raw):
            continue
        size, kind = struct.unpack_from(">iB", raw, at)
        if size < 1 or size + 4 > count * SECTOR:
            raise RegionError(f"chunk {i} has a bad size")
        if at + 4 + size <= len(raw):
            out.append(Chunk(i, kind, raw[at + 5 : at + 4 + size], times[i]))
    return out


def write(chunks: list[Chunk], now: int | None = None) -> bytes:
    """A file with the chunks packed from sector 2 on, by index; ``now`` replaces all times."""
    offsets, times, body, at = [0] * CHUNKS, [0] * CHUNKS, [], 2
    for c in sorted(chunks, key=lambda c: c.index):
        n = sectors(len(c.data) + 5)
        offsets[c.index], times[c.index] = at << 8 | n, c.time if now is None else now
        body.append((struct.pack(">iB", len(c.data) + 1, c.kind) + c.data).ljust(n * SECTOR, b"\0"))
        at += n
    return struct.pack(f">{CHUNKS}I", *offsets) + struct.pack(f">{CHUNKS}I", *times) + b"".join(body)
