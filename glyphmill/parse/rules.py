"""The translation rule language: shapes of components on both sides of an arrow, and raw lines.

    |text| ==> |text|           a literal, where & escapes the next character
    [ ... ] ==> [ ... ]         a list, one element per line
    (|text| newline |extra|)    a component with extra
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from glyphmill.parse import component, njson, snbt


class RuleError(ValueError):
    pass


#: A literal is a str, a list a list, a pair a tuple.
Shape = str | list | tuple


def _tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in " \t\r":
            i += 1
        elif c == "#":
            while i < len(text) and text[i] != "\n":
                i += 1
        elif c == "|":
            part, i = [], i + 1
            while i < len(text) and text[i] != "|":
                if text[i] == "&":
                    i += 1
                part.append(text[i : i + 1])
                i += 1
            if i >= len(text):
                raise RuleError("Unclosed literal")
            out.append(("literal", "".join(part)))
            i += 1
        elif text.startswith("==>", i):
            out.append(("arrow", ""))
            i += 3
        elif c in "[]()\n":
            out.append((c, ""))
            i += 1
        else:
            raise RuleError(f"unexpected {c!r}")
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def blank(self) -> None:
        while self.at < len(self.tokens) and self.tokens[self.at][0] == "\n":
            self.at += 1

    def take(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise RuleError(f"expected {kind!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def shape(self) -> Shape:
        if self.kind() == "literal":
            return self.take("literal")
        if self.kind() == "[":
            self.take("[")
            out = []
            self.blank()
            while self.kind() != "]":
                out.append(self.shape())
                self.blank()
            self.take("]")
            return out
        self.take("(")
        self.blank()
        left = self.shape()
        self.blank()
        right = self.shape()
        self.blank()
        self.take(")")
        return left, right


def parse(text: str) -> list[tuple[Shape, Shape]]:
    """The mappings of a file, in order."""
    parser, out = _Parser(_tokens(text)), []
    parser.blank()
    while parser.at < len(parser.tokens):
        left = parser.shape()
        parser.take("arrow")
        out.append((left, parser.shape()))
        if parser.at < len(parser.tokens):
            parser.take("\n")
        parser.blank()
    return out


def literal(text: str) -> str:
    return "|" + text.replace("&", "&&").replace("|", "&|") + "|"


def render(shape: Shape) -> str:
    """A shape as :func:`glyphmill.parse.component.to_rule` writes a component."""
    if isinstance(shape, str):
        return literal(shape)
    if isinstance(shape, list):
        return "[" + "\n".join(map(render, shape)) + "]"
    return f"({render(shape[0])}\n{render(shape[1])})"


def consistent(left: Shape, right: Shape) -> bool:
    """Whether both sides have the same shape."""
    if isinstance(left, str) or isinstance(right, str):
        return isinstance(left, str) and isinstance(right, str)
    return type(left) is type(right) and len(left) == len(right) and all(map(consistent, left, right))


def apply(tree: object, shape: Shape) -> object:
    """A component with its texts replaced by those of a shape; RuleError where they don't fit."""
    if isinstance(shape, list):
        if not isinstance(tree, list) or len(tree) != len(shape):
            raise RuleError("a list of another length")
        return [apply(t, s) for t, s in zip(tree, shape, strict=True)]
    if isinstance(tree, list):
        raise RuleError("a list where a text is asked for")
    if isinstance(shape, str):
        if isinstance(tree, dict) and "extra" in tree:
            raise RuleError("a component with extra")
        return component.replace_text(tree, shape)
    if not isinstance(tree, dict) or "extra" not in tree or not isinstance(shape[0], str):
        raise RuleError("a component without extra")
    extra = tree["extra"] if isinstance(tree["extra"], list) else [tree["extra"]]
    return {**component.replace_text(tree, shape[0]), "extra": apply(extra, shape[1])}


_RAW = re.compile(r"\s*\|(.*?)\|\s*==>\s*\|(.*?)\|\s*")


@dataclass
class RuleBook:
    """Rules on components, and translations of raw texts; a null target is written as its source."""

    rules: list[tuple[Shape, Shape]] = field(default_factory=list)
    raw: dict[str, str | None] = field(default_factory=dict)

    @staticmethod
    def read(text: str) -> RuleBook:
        """From a text with a ---mtl--- and then a ---raw--- section."""
        head, mark, rest = text.partition("---mtl---")
        rules, mark2, raw = rest.partition("---raw---")
        if not mark or not mark2 or head.strip():
            raise RuleError("both separators are needed")
        book = RuleBook(parse(rules))
        for line in raw.split("\n"):
            if line.strip() and not line.lstrip().startswith("#"):
                found = _RAW.fullmatch(line)
                if not found:
                    raise RuleError("No mapping item")
                book.raw[snbt.unescape(found[1])] = found[2]
        return book

    def write(self) -> str:
        out = ["---mtl---", *(f"{render(a)} ==> {render(b)}" for a, b in self.rules), "---raw---"]
        for source, target in self.raw.items():
            left = snbt.escape(source).replace('\\"', '"')
            out.append(f"|{left}| ==> |{left if target is None else target}|")
        return "\n".join(out) + "\n"


def decode(text: str) -> tuple[object, str] | None:
    """(component, json or snbt) of a text; a bare word is a string of tolerant JSON."""
    try:
        tree = njson.parse(text, njson.FILE)
        if component.is_text(tree):
            return tree, "json"
    except njson.JsonError:
        pass
    try:
        node, end = snbt.parse_prefix(text)
    except snbt.SnbtError:
        return None
    tree = snbt.to_tree(node)
    return (tree, "snbt") if not text[end:].strip() and component.is_text(tree) else None


def key(text: str) -> str | None:
    """The rule form of a text's component: rules whose left side renders to the same match it."""
    found = decode(text)
    return None if found is None else component.to_rule(found[0])


def translate(text: str, target: Shape) -> str | None:
    """A text rewritten by a matching rule's right side; None where it doesn't fit."""
    found = decode(text)
    if found is None:
        return None
    try:
        new = apply(found[0], target)
    except (RuleError, ValueError):
        return None
    return njson.write(new) if found[1] == "json" else snbt.write(new)


def todo(shape: Shape) -> Shape:
    """The shape with every literal replaced by TODO."""
    return "TODO" if isinstance(shape, str) else type(shape)(map(todo, shape))


def template(texts: list[str]) -> RuleBook:
    """Rules to fill in: texts with a rule form get a rule, others a raw line."""
    book = RuleBook()
    for text in texts:
        form = key(text)
        if form is None:
            book.raw[text] = "TODO"
        else:
            (left,) = [_Parser(_tokens(form)).shape()]
            if (left, todo(left)) not in book.rules:
                book.rules.append((left, todo(left)))
    return book
