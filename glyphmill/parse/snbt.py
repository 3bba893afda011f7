"""SNBT: a reader that keeps the span of every value, and a writer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from glyphmill.parse.tree import SUFFIX, Array, Num, fits


class SnbtError(ValueError):
    pass


@dataclass
class Node:
    """A value at text[start:end]. ``value``: dict or list of nodes, str, bool, or a number; ``quote`` of strings: '"', "'" or ''."""

    kind: str
    value: object
    start: int
    end: int
    quote: str = ""


_KINDS = {"b": "byte", "s": "short", "i": "int", "l": "long", "f": "float", "d": "double"}
_NUMBER = re.compile(r"[\w\-+.]+")
_LITERAL = re.compile(r"[^\W_]*[\w.\-]*")
_ARRAYS = {"B": "byte", "I": "int", "L": "long"}
_BLANK = re.compile(r"\s*")
MAX_DEPTH = 256


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        self.at = _BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def expect(self, c: str) -> None:
        if self.peek() != c:
            raise SnbtError(f"expected {c!r} at {self.at}")
        self.at += 1

    def string(self, quote: str) -> Node:
        start, i, text = self.at, self.at + 1, self.text
        while i < len(text) and text[i] != quote:
            # in single quotes only \\ and \' are escapes
            i += 2 if text[i] == "\\" and (quote == '"' or text[i + 1 : i + 2] in ("\\", "'")) else 1
        if i >= len(text):
            raise SnbtError("unclosed string")
        self.at = i + 1
        inner = text[start + 1 : i]
        return Node("string", unescape(inner) if quote == '"' else inner, start, i + 1, quote)

    def number(self, kind: str | None) -> Node:
        start = self.at
        raw = _NUMBER.match(self.text, start)[0]
        self.at = start + len(raw)
        body, suffix = raw.replace("_", ""), None
        if body[-1:].isalpha():
            body, suffix = body[:-1], body[-1].lower()
        if suffix is not None and (suffix not in _KINDS or body[-1:].isalpha()):
            raise SnbtError(f"bad number {raw!r}")
        try:
            wanted = kind or (_KINDS[suffix] if suffix else None)
            if wanted in ("float", "double") or (wanted is None and "." in body):
                return Node(wanted or "double", float(body), start, self.at)
            value = int(body)
        except ValueError:
            raise SnbtError(f"bad number {raw!r}") from None
        wanted = wanted or ("int" if fits(value, "int") else "long")
        if not fits(value, wanted):
            raise SnbtError(f"{raw!r} is out of range")
        return Node(wanted, value, start, self.at)

    def literal(self) -> Node:
        start = self.at
        raw = _LITERAL.match(self.text, start)[0]
        if not raw:
            raise SnbtError(f"unknown character at {start}")
        self.at = start + len(raw)
        return Node("string", raw, start, self.at)

    def value(self, depth: int = 0, kind: str | None = None) -> Node:
        c = self.peek()
        if depth > MAX_DEPTH:
            raise SnbtError("too deep")
        if c == "{":
            return self.compound(depth)
        if c == "[":
            return self.list(depth)
        if c in ('"', "'") and c:
            return self.string(c)
        if c == "-" or "0" <= c <= "9" or (c == "." and self.text[self.at + 1 : self.at + 2].isdigit()):
            return self.number(kind)
        node = self.literal()
        if node.value in ("true", "false"):
            return Node("boolean", node.value == "true", node.start, node.end)
        return node

    def compound(self, depth: int) -> Node:
        start, out = self.at, {}
        self.at += 1
        while self.peek() != "}":
            c = self.peek()
            if c in ('"', "'") and c:
                key = self.string(c)
            elif c.isalpha() or c in ("_", ".") and c:
                key = self.literal()
            else:
                raise SnbtError(f"bad key at {self.at}")
            self.expect(":")
            out[key.value] = self.value(depth + 1)
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != "}":
                raise SnbtError(f"expected ',' or '}}' at {self.at}")
        self.at += 1
        return Node("compound", out, start, self.at)

    def list(self, depth: int) -> Node:
        start, out, kind = self.at, [], None
        self.at += 1
        found = re.compile(r"\s*([A-Za-z]+)\s*;").match(self.text, self.at)
        if found:
            kind = _ARRAYS.get(found[1])
            if kind is None:
                raise SnbtError(f"bad array {found[1]!r}")
            self.at = found.end()
        while self.peek() != "]":
            out.append(self.value(depth + 1, kind))
            if kind and (out[-1].kind != kind):
                raise SnbtError("an array's element of another type")
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != "]":
                raise SnbtError(f"expected ',' or ']' at {self.at}")
        self.at += 1
        return Node(f"{kind}_array" if kind else "list", out, start, self.at)


def parse(text: str) -> Node:
    """The value at the beginning; what follows it is ignored."""
    reader = _Reader(text)
    if not reader.peek():
        raise SnbtError("empty")
    return reader.value()


def parse_prefix(text: str) -> tuple[Node, int]:
    """The value at the beginning and where it ends."""
    reader = _Reader(text)
    if not reader.peek():
        raise SnbtError("empty")
    return reader.value(), reader.at


def to_tree(node: Node) -> object:
    if node.kind == "compound":
        return {k: to_tree(v) for k, v in node.value.items()}
    if node.kind == "list":
        return [to_tree(v) for v in node.value]
    if node.kind.endswith("_array"):
        return Array(node.kind[:-6], [v.value for v in node.value])
    return node.value if node.kind in ("string", "boolean") else Num(node.kind, node.value)


def unescape(text: str) -> str:
    """\\n, \\r, \\t and \\" as usual; any other escaped character is itself."""
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), text, flags=re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def quote(text: str) -> str:
    return f'"{escape(text)}"'


_BARE = re.compile(r"[A-Za-z0-9_.+\-]+")


def write(tree: object) -> str:
    """Compact text: strings in double quotes, keys bare where possible, numbers with their suffix."""
    if isinstance(tree, dict):
        return "{" + ",".join(f"{k if _BARE.fullmatch(k) else quote(k)}:{write(v)}" for k, v in tree.items()) + "}"
    if isinstance(tree, list):
        return "[" + ",".join(map(write, tree)) + "]"
    if isinstance(tree, Array):
        return f"[{tree.kind[0].upper()};" + ",".join(f"{v}{'b' if tree.kind == 'byte' else 'l' if tree.kind == 'long' else ''}" for v in tree.values) + "]"
    if isinstance(tree, bool):
        return "1b" if tree else "0b"
    if isinstance(tree, Num):
        return f"{tree.value}{SUFFIX[tree.kind]}"
    if isinstance(tree, str):
        return quote(tree)
    raise TypeError(f"{type(tree).__name__} has no SNBT form")


def pretty(tree: object, indent: int = 0) -> str:
    """Text with four-space indentation, as for dumps."""
    pad, inner = "    " * indent, "    " * (indent + 1)
    if isinstance(tree, dict) and tree:
        return "{\n" + ",\n".join(f"{inner}{k if _BARE.fullmatch(k) else quote(k)}: {pretty(v, indent + 1)}" for k, v in tree.items()) + f"\n{pad}}}"
    if isinstance(tree, list) and tree:
        return "[\n" + ",\n".join(inner + pretty(v, indent + 1) for v in tree) + f"\n{pad}]"
    return write(tree)
