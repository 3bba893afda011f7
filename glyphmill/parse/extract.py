"""Texts of trees and commands: flattening to pointers, pattern matching, and spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from glyphmill.parse import component, njson, pointer, snbt
from glyphmill.parse.commands import Command, after_run, parse_commands, utf16
from glyphmill.plans.patterns import CommandPattern, Kind, Patterns, PointerPattern, first_match


@dataclass
class Slice:
    """A text inside a command text; start and end (exclusive) are code points until :func:`command_texts` returns them."""

    start: int
    end: int
    content: str
    syntax: str | None
    format: str


@dataclass
class Found:
    """A text at a pointer. ``kind`` text; command (its slices in ``slices``); structure (its own texts in ``inner``)."""

    pointer: str
    format: str
    content: str
    kind: str = "text"
    slices: list[Slice] = field(default_factory=list)
    inner: list[Found] = field(default_factory=list)

    def leaves(self, outer: str = "") -> Iterator[tuple[str, str, str, str, str | None]]:
        """(outer pointer, inner pointer, format, text, syntax) of every text in it."""
        if self.kind == "text":
            yield (outer or self.pointer, self.pointer if outer else "", self.format, self.content, None)
        for s in self.slices:
            yield (outer or self.pointer, self.pointer if outer else "", s.format, unquoted(s.content, s.syntax), s.syntax)
        for f in self.inner:
            yield from f.leaves(outer or self.pointer)


def unquoted(text: str, syntax: str | None) -> str:
    """A string literal's content; other syntaxes are themselves."""
    if syntax == "DoubleQuoteString" and len(text) > 1:
        return snbt.unescape(text[1:-1])
    if syntax == "SingleQuoteString" and len(text) > 1:
        return snbt.unescape(text[1:-1])
    return text


def quoted(text: str, syntax: str | None) -> str:
    """A replacement as a literal: strings get double quotes whatever they had."""
    return snbt.quote(text) if syntax in ("DoubleQuoteString", "SingleQuoteString", "LiteralString") else text


def flatten(tree: object, whole: str, write, at: tuple = ()) -> Iterator[tuple[tuple, str, object]]:
    """(pointer, format, subtree) of strings and of whole text components, in document order.

    ``whole`` is the format of components kept whole (json_obj, nbt_obj); numbers and the like have no text.
    """
    if isinstance(tree, dict | list) and component.is_component(tree):
        yield at, whole, tree
    elif isinstance(tree, dict):
        for k, v in tree.items():
            yield from flatten(v, whole, write, (*at, k))
    elif isinstance(tree, list):
        for i, v in enumerate(tree):
            yield from flatten(v, whole, write, (*at, i))
    elif isinstance(tree, str):
        yield at, component.infer_format(tree), tree


def tree_texts(tree: object, patterns: list[PointerPattern] | None, whole: str, catalog: Patterns, depth: int = 0) -> Iterator[Found]:
    """Texts of a tree whose pointer a pattern matches; the pattern's kind says how a text is read on."""
    write = njson.write if whole == "json_obj" else snbt.write
    for at, fmt, value in flatten(tree, whole, write):
        where = pointer.encode(at)
        chosen = first_match(patterns, where)
        if chosen is not None:
            content = value if isinstance(value, str) else write(value)
            found = _as_kind(chosen.kind, where, fmt, content, catalog, depth)
            if found is not None:
                yield found


def _as_kind(kind: Kind, where: str, fmt: str, content: str, catalog: Patterns, depth: int) -> Found | None:
    if kind.type == "command":
        slices = command_texts(content, catalog)
        return Found(where, fmt, content, "command", slices) if slices else None
    if kind.type == "structure" and depth < 16:
        lists = {"nbt": catalog.nbt, "mcjson": catalog.mcjson, "command_data": catalog.data}
        is_json = kind.format.startswith("json")
        tree = component.read_json(content, njson.FILE) if is_json else component.read_snbt(content)
        if tree is None or tree is njson.JsonError:
            return None
        inner = list(tree_texts(tree, lists[kind.inherit], "json_obj" if is_json else "nbt_obj", catalog, depth + 1))
        return Found(where, kind.format, content, "structure", inner=inner) if inner else None
    return Found(where, fmt, content)


def json_texts(text: str, catalog: Patterns) -> list[Found]:
    """Texts of a JSON file; JsonError if it doesn't parse."""
    return list(tree_texts(njson.parse(text, njson.FILE), catalog.mcjson, "json_obj", catalog))


# --- commands -------------------------------------------------------------------------------------

# The forms of target selectors, their names, item stacks and blocks in commands.
_SELECTOR = re.compile(r"@[praesn]\[.*\]", re.S)
_NAME = re.compile(r"""name=(!?)("(?:\\.|.)*?"|'.*?'|\w[\w:]*|:[\w:]*|)[,\]]""", re.A)
_STACK = re.compile(r"(?P<id>[\w:.]+)(?:\[(?P<new>.*)\]|(?P<old>\{.*\}))?", re.A)
_BLOCK = re.compile(r"(?P<id>[\w:.]+)(?:\[.*?\])?(?P<snbt>\{.*\})", re.A)
_SYNTAX = {"compound": "Compound", "list": "List"}


class Unselected(ValueError):
    """A selection that doesn't apply: the whole argument is taken instead."""


def syntax_of(text: str) -> str:
    for quote, name in (("'", "SingleQuoteString"), ('"', "DoubleQuoteString")):
        if len(text) > 1 and text[0] == text[-1] == quote:
            return name
    return "LiteralString"


def _selector_names(command: Command) -> Iterator[Slice]:
    for arg in command.args:
        if _SELECTOR.fullmatch(arg.content):
            found = _NAME.search(arg.content)
            if found:
                yield Slice(arg.start + found.start(2), arg.start + found.end(2), found[2], syntax_of(found[2]), "plain_str")


def _node_texts(text: str, node: snbt.Node, at: tuple = ()) -> Iterator[tuple[tuple, snbt.Node]]:
    """(pointer, node) as flatten does, on nodes with spans."""
    if node.kind in ("compound", "list"):
        if component.is_component(snbt.to_tree(node)):
            yield at, node
            return
        for k, v in node.value.items() if node.kind == "compound" else enumerate(node.value):
            yield from _node_texts(text, v, (*at, k))
    elif node.kind == "string":
        yield at, node


def _node_slice(text: str, node: snbt.Node, offset: int) -> Slice:
    syntax = _SYNTAX.get(node.kind) or {'"': "DoubleQuoteString", "'": "SingleQuoteString", "": "LiteralString"}[node.quote]
    return Slice(offset + node.start, offset + node.end, text[node.start : node.end], syntax, "snbt_str")


def _snbt_entire(text: str, offset: int, catalog: Patterns) -> list[Slice]:
    try:
        node = snbt.parse(text)
    except snbt.SnbtError as e:
        raise Unselected(str(e)) from None
    return [_node_slice(text, n, offset) for at, n in _node_texts(text, node) if first_match(catalog.data, pointer.encode(at)) is not None]


def _item_properties(text: str, offset: int, catalog: Patterns) -> list[Slice]:
    """``key=value`` and ``!key`` parts of an item's component list."""
    out, i = [], 0
    while i < len(text):
        if text[i] in ", ":
            i += 1
        elif text[i] == "!":
            i = text.find(",", i) if "," in text[i:] else len(text)
        else:
            key, mark, _ = text[i:].partition("=")
            if not mark:
                break
            i += len(key) + 1
            try:
                node, size = snbt.parse_prefix(text[i:])
            except snbt.SnbtError as e:
                raise Unselected(str(e)) from None
            name = key.strip().removeprefix("minecraft:")
            if name in catalog.components:
                texts = list(_node_texts(text[i:], node))
                wanted = catalog.components[name]
                texts = texts if wanted is None and len(texts) == 1 else [x for x in texts if wanted and wanted.matches(pointer.encode(x[0]))]
                out += [_node_slice(text[i:], n, offset + i) for _, n in texts]
            i += size
    return out


def _select(arg: str, offset: int, how: str | dict | None, catalog: Patterns) -> list[Slice]:
    whole = lambda fmt, syntax=None: [Slice(offset, offset + len(arg), arg, syntax, fmt)]
    name = how if isinstance(how, str) else (how or {}).get("type")
    if name is None or name == "plain_entire":
        return whole("plain_str")
    if name == "text_component_entire":
        found = component.read_json(arg)
        if found is not njson.JsonError and component.is_text(found):
            return whole("json_str")
        tree = component.read_snbt(arg)
        if arg[:1] in ("{", "[", '"', "'") and component.is_text(tree):
            return whole("snbt_str")
        raise Unselected("no text component")
    if name == "snbt_entire":
        return _snbt_entire(arg, offset, catalog)
    if name == "with_info":
        return whole(how.get("format", "plain_str"), how.get("syntax"))
    if name == "item_stack":
        found = _STACK.fullmatch(arg)
        if not found:
            raise Unselected("no item")
        if found["new"] is not None:
            return _item_properties(found["new"], offset + found.start("new"), catalog)
        return _snbt_entire(found["old"], offset + found.start("old"), catalog) if found["old"] is not None else []
    if name == "block_state":
        found = _BLOCK.fullmatch(arg)
        if not found:
            raise Unselected("no block")
        return _snbt_entire(found["snbt"], offset + found.start("snbt"), catalog)
    raise ValueError(f"selection {name!r}")


def _pattern_hits(command: Command, p: CommandPattern, end: int, text: str, catalog: Patterns) -> Iterator[Slice]:
    if p.greedy is not None:
        k = max(1, p.greedy)
        if len(command.args) >= k:
            start = command.args[k - 1].start
            yield Slice(start, end, text[start:end], None, "plain_str")
        elif p.greedy:
            raise IndexError(f"no argument {p.greedy}")
        return
    for i, arg in enumerate(command.args, 1):
        if i in p.select and p.post.holds(command, arg.content):
            try:
                yield from _select(arg.content, arg.start, p.select[i], catalog)
            except Unselected:
                yield Slice(arg.start, arg.end, arg.content, None, "plain_str")


def one_command(command: Command, text: str, catalog: Patterns) -> list[Slice]:
    """Slices of one command, selector names before pattern hits; IndexError where a pattern asks for a missing argument."""
    if command.name in ("execute", "return"):
        inner = after_run(command)
        return one_command(inner, text, catalog) if inner else []
    end = command.args[-1].end if command.args else command.start + len(command.name)
    hits = [s for p in catalog.command.get(command.name, ()) if p.pre.holds(command) for s in _pattern_hits(command, p, end, text, catalog)]
    own = [s for s in _selector_names(command) if all(s.end <= h.start or h.end <= s.start for h in hits)]
    return own + hits


def command_texts(text: str, catalog: Patterns) -> list[Slice]:
    """Slices of all commands of a text, then of the regex patterns over the whole; spans are in UTF-16 units.

    A command whose pattern asks for a missing argument is left out.
    """
    out = []
    for command in parse_commands(text):
        try:
            out += one_command(command, text, catalog)
        except IndexError:
            continue
    for p in catalog.regexes:
        for m in re.finditer(p.regex, text):
            for group, info in p.groups.items():
                if m[group] is not None:
                    out.append(Slice(m.start(group), m.end(group), m[group], (info or {}).get("syntax"), (info or {}).get("format") or "plain_str"))
    for s, (a, b) in zip(out, utf16(text, [(s.start, s.end) for s in out]), strict=True):
        s.start, s.end = a, b
    return out


def nbt_texts(tree: object, catalog: Patterns) -> list[Found]:
    return list(tree_texts(tree, catalog.nbt, "nbt_obj", catalog))


__all__ = ["Found", "Slice", "command_texts", "flatten", "json_texts", "nbt_texts", "one_command", "quoted", "tree_texts", "unquoted"]
