"""Tolerant JSON: a normaliser for quotes and escapes, and a reader with switches that keeps key order."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from glyphmill.parse.tree import Num


@dataclass(frozen=True)
class Dialect:
    comments: bool = False
    trailing_comma: bool = False
    lenient: bool = False
    illegal_escape: bool = False
    single_quote: bool = False


FILE = Dialect(comments=True, trailing_comma=True, lenient=True, illegal_escape=True, single_quote=True)
COMMAND = Dialect(trailing_comma=True, illegal_escape=True)
MAX_DEPTH = 256


class JsonError(ValueError):
    pass


def standardize(text: str, dialect: Dialect) -> str:
    """Text with single-quoted strings and needless escapes turned into plain JSON.

    An opening single quote always becomes a double quote; with single_quote off its closing one doesn't,
    so such text doesn't parse.
    """
    out, single, double, i = [], False, False, 0
    while i < len(text):
        c = text[i]
        if c == "'" and not double:
            if not single:
                out.append('"')
                single = True
            else:
                out.append('"' if dialect.single_quote else c)
                single = False
        elif c == '"' and not single:
            out.append(c)
            double = not double
        elif c == '"':
            out.append('\\"' if dialect.single_quote else c)
        elif c == "\\" and (single or double) and i + 1 < len(text):
            following = text[i + 1]
            out.append("'" if following == "'" and (dialect.illegal_escape or dialect.single_quote) else c + following)
            i += 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


_BARE = re.compile(r"[^\s,:{}\[\]\"]+")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class _Reader:
    def __init__(self, text: str, dialect: Dialect):
        self.text, self.at, self.dialect = text, 0, dialect

    def skip(self) -> None:
        text = self.text
        while self.at < len(text):
            if text[self.at] in " \t\r\n":
                self.at += 1
            elif self.dialect.comments and text.startswith("//", self.at):
                end = text.find("\n", self.at)
                self.at = len(text) if end < 0 else end
            elif self.dialect.comments and text.startswith("/*", self.at):
                end = text.find("*/", self.at + 2)
                if end < 0:
                    raise JsonError("unclosed comment")
                self.at = end + 2
            else:
                return

    def peek(self) -> str:
        self.skip()
        return self.text[self.at : self.at + 1]

    def string(self) -> str:
        out, text, i = [], self.text, self.at + 1
        while True:
            if i >= len(text):
                raise JsonError("unclosed string")
            c = text[i]
            if c == '"':
                self.at = i + 1
                return "".join(out)
            if c == "\\":
                c = text[i + 1 : i + 2]
                if c == "u":
                    code = text[i + 2 : i + 6]
                    if not re.fullmatch("[0-9a-fA-F]{4}", code):
                        raise JsonError("bad escape")
                    out.append(chr(int(code, 16)))
                    i += 6
                    continue
                if c not in _ESCAPES or not c:
                    raise JsonError("bad escape")
                out.append(_ESCAPES[c])
                i += 2
                continue
            if c < " " and not self.dialect.lenient and c != "\t":
                raise JsonError("control character")
            out.append(c)
            i += 1

    def value(self, depth: int = 0) -> object:
        c = self.peek()
        if depth > MAX_DEPTH:
            raise JsonError("too deep")
        if c in ("{", "["):
            close, out = ("}", {}) if c == "{" else ("]", [])
            self.at += 1
            while self.peek() != close:
                if c == "{":
                    key = self.key()
                    if self.peek() != ":":
                        raise JsonError(f"expected ':' at {self.at}")
                    self.at += 1
                    out[key] = self.value(depth + 1)
                else:
                    out.append(self.value(depth + 1))
                following = self.peek()
                if following == ",":
                    self.at += 1
                    if self.peek() == close and not self.dialect.trailing_comma:
                        raise JsonError("trailing comma")
                elif following != close:
                    raise JsonError(f"expected ',' or {close!r} at {self.at}")
            self.at += 1
            return out
        if c == '"':
            return _surrogates(self.string())
        found = _BARE.match(self.text, self.at)
        if not found:
            raise JsonError(f"unexpected {c!r} at {self.at}")
        self.at = found.end()
        raw = found[0]
        if raw in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[raw]
        if _NUMBER.fullmatch(raw):
            if re.fullmatch(r"-?\d+", raw) and -(1 << 63) <= int(raw) < 1 << 63:
                return Num("long", int(raw), raw)
            return Num("double", float(raw), raw)
        if self.dialect.lenient:
            return raw
        raise JsonError(f"unexpected {raw!r}")

    def key(self) -> str:
        if self.peek() == '"':
            return _surrogates(self.string())
        found = _BARE.match(self.text, self.at)
        if not found or not self.dialect.lenient:
            raise JsonError(f"bad key at {self.at}")
        self.at = found.end()
        return found[0]


def _surrogates(text: str) -> str:
    if any("\ud800" <= c <= "\udfff" for c in text):
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def parse(text: str, dialect: Dialect = FILE) -> object:
    """The value of a whole text; numbers are Num with the text they came from."""
    if dialect.illegal_escape or dialect.single_quote:
        text = standardize(text, dialect)
    reader = _Reader(text, dialect)
    if not reader.peek():
        raise JsonError("empty")
    out = reader.value()
    if reader.peek():
        raise JsonError(f"unexpected text at {reader.at}")
    return out


def write(tree: object) -> str:
    """Compact JSON, keys in their order, numbers as they were written."""
    if isinstance(tree, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(v)}" for k, v in tree.items()) + "}"
    if isinstance(tree, list):
        return "[" + ",".join(map(write, tree)) + "]"
    if isinstance(tree, Num):
        return tree.raw if tree.raw is not None else json.dumps(tree.value)
    return json.dumps(tree, ensure_ascii=False)


def pretty(tree: object, indent: int = 0) -> str:
    """As write, with a line for each element and two spaces a level."""
    if isinstance(tree, dict | list) and tree:
        items = [f"{write(k)}: {pretty(v, indent + 1)}" for k, v in tree.items()] if isinstance(tree, dict) else [pretty(v, indent + 1) for v in tree]
        step, (left, right) = "\n" + "  " * indent, "{}" if isinstance(tree, dict) else "[]"
        return left + ",".join(f"{step}  {x}" for x in items) + step + right
    return write(tree)
