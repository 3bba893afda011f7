"""Binary NBT (big-endian, modified UTF-8): reader and writer, with gzip or zlib around."""

from __future__ import annotations

import gzip
import struct
import zlib

from glyphmill.parse.tree import Array, Num

# Tag numbers.
_NAMES = {1: "byte", 2: "short", 3: "int", 4: "long", 5: "float", 6: "double"}
_NUMBERS = {v: k for k, v in _NAMES.items()}
_FORMS = {"byte": "b", "short": "h", "int": "i", "long": "q", "float": "f", "double": "d"}
_ARRAYS = {7: "byte", 11: "int", 12: "long"}
_ARRAY_NUMBERS = {v: k for k, v in _ARRAYS.items()}
STRING, LIST, COMPOUND = 8, 9, 10


class NbtError(ValueError):
    pass


def _text(raw: bytes) -> str:
    fixed = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    return fixed.encode("utf-16", "surrogatepass").decode("utf-16", "surrogatepass") if any("\ud800" <= c <= "\udfff" for c in fixed) else fixed


def _bytes(text: str) -> bytes:
    out = []
    for c in text:
        if c == "\0":
            out.append(b"\xc0\x80")
        elif c > "￿":
            n = ord(c) - 0x10000
            out.append((chr(0xD800 + (n >> 10)) + chr(0xDC00 + (n & 0x3FF))).encode("utf-8", "surrogatepass"))
        else:
            out.append(c.encode("utf-8", "surrogatepass"))
    raw = b"".join(out)
    if len(raw) > 65535:
        raise NbtError("too long a string")
    return struct.pack(">H", len(raw)) + raw


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str):
        size = struct.calcsize(">" + form)
        if self.at + size > len(self.raw):
            raise NbtError("the data ends early")
        out = struct.unpack_from(">" + form, self.raw, self.at)
        self.at += size
        return out

    def string(self) -> str:
        n = self.take("H")[0]
        if self.at + n > len(self.raw):
            raise NbtError("the data ends early")
        self.at += n
        return _text(self.raw[self.at - n : self.at])

    def value(self, tag: int, depth: int) -> object:
        if depth > 512:
            raise NbtError("too deep")
        if tag in _NAMES:
            return Num(_NAMES[tag], self.take(_FORMS[_NAMES[tag]])[0])
        if tag in _ARRAYS:
            n = self.take("i")[0]
            return Array(_ARRAYS[tag], list(self.take(f"{max(0, n)}{_FORMS[_ARRAYS[tag]]}")))
        if tag == STRING:
            return self.string()
        if tag == LIST:
            kind, n = self.take("Bi")
            if n > 0 and n > len(self.raw) - self.at:
                raise NbtError("the data ends early")
            return [self.value(kind, depth + 1) for _ in range(max(0, n))]
        if tag == COMPOUND:
            out = {}
            while kind := self.take("B")[0]:
                name = self.string()
                out[name] = self.value(kind, depth + 1)
            return out
        raise NbtError(f"tag {tag}")


def read(raw: bytes) -> tuple[str, object]:
    """(root name, tree)."""
    reader = _Reader(raw)
    tag = reader.take("B")[0]
    return reader.string(), reader.value(tag, 0)


def _tag(value: object) -> int:
    if isinstance(value, bool):
        return 1
    if isinstance(value, Num):
        return _NUMBERS[value.kind]
    if isinstance(value, Array):
        return _ARRAY_NUMBERS[value.kind]
    found = {str: STRING, list: LIST, dict: COMPOUND}.get(type(value))
    if found is None:
        raise NbtError(f"{type(value).__name__} has no tag")
    return found


def _payload(value: object) -> bytes:
    if isinstance(value, bool):
        return struct.pack(">b", value)
    if isinstance(value, Num):
        return struct.pack(">" + _FORMS[value.kind], value.value)
    if isinstance(value, Array):
        return struct.pack(f">i{len(value.values)}{_FORMS[value.kind]}", len(value.values), *value.values)
    if isinstance(value, str):
        return _bytes(value)
    if isinstance(value, list):
        tags = {_tag(v) for v in value}
        if len(tags) > 1:
            raise NbtError("a list of several types")
        return struct.pack(">Bi", tags.pop() if tags else 0, len(value)) + b"".join(map(_payload, value))
    return b"".join(bytes((_tag(v),)) + _bytes(k) + _payload(v) for k, v in value.items()) + b"\0"


def write(tree: object, name: str = "") -> bytes:
    return bytes((_tag(tree),)) + _bytes(name) + _payload(tree)


def read_gzip(raw: bytes) -> object:
    try:
        return read(gzip.decompress(raw))[1]
    except (OSError, EOFError, zlib.error) as e:
        raise NbtError(str(e)) from None


def write_gzip(tree: object, name: str = "") -> bytes:
    return gzip.compress(write(tree, name), mtime=0)
