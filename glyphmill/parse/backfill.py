"""Putting replacements back into trees and texts."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from glyphmill.parse import njson, pointer, snbt
from glyphmill.parse.commands import splice
from glyphmill.parse.extract import Found, Slice, quoted, syntax_of, unquoted


#: Says for each text, in order, what replaces it; None leaves it.
Pick = Callable[[str], str | None]


def replace_found(found: Found, pick: Pick) -> str | None:
    """The content with its texts replaced, or None if nothing of it is to be.

    ``pick`` is asked for the texts in the order of Found.leaves. Commands come back even where nothing
    in them is replaced.
    """
    if found.kind == "text":
        return pick(found.content)
    if found.kind == "command":
        spans = []
        for s in found.slices:
            new = pick(unquoted(s.content, s.syntax))
            spans.append((s.start, s.end, s.content if new is None else quoted(new, s.syntax)))
        return splice(found.content, spans)
    new = [(f.pointer, f.format, r) for f in found.inner if (r := replace_found(f, pick)) is not None and r != f.content]
    if not new:
        return None
    if found.format.startswith("json"):
        return njson.write(fill(njson.parse(found.content, njson.FILE), new, "json_obj"))
    return snbt.write(fill(snbt.to_tree(snbt.parse(found.content)), new, "nbt_obj"))


def replaced_tree(tree: object, found: list[Found], pick: Pick, whole: str) -> object | None:
    """The tree with the texts of all it holds, commands and structures too, replaced; None if nothing changes."""
    new = [(f.pointer, f.format, r) for f in found if (r := replace_found(f, pick)) is not None and r != f.content]
    return fill(tree, new, whole) if new else None


def replaced_commands(text: str, slices: list[Slice], pick: Pick) -> str | None:
    """A function file with its slices replaced; None if nothing changes."""
    new = [(s.start, s.end, to, s.syntax) for s in slices if (to := pick(s.content)) is not None]
    return spans_file(text, new) if new else None


def by_mapping(mapping: dict[str, str | None]) -> Pick:
    """A text as it stands, or else the content of a string literal, looked up in a mapping."""

    def pick(text: str) -> str | None:
        found = mapping.get(text)
        return mapping.get(unquoted(text, syntax_of(text))) if found is None else found

    return pick


def by_ordinal(replacements: dict[int, str]) -> Pick:
    """The n-th text asked for gets the n-th replacement."""
    count = itertools.count()
    return lambda text: replacements.get(next(count))


def _trie(replacements: list[tuple[str, str, str]]) -> dict:
    """{point: branch}, with (format, text) of the first replacement of an end under None."""
    root: dict = {}
    for where, fmt, text in replacements:
        at = root
        for p in pointer.decode(where):
            at = at.setdefault(p, {})
        at.setdefault(None, []).append((fmt, text))
    return root


class NotText(ValueError):
    pass


def fill(tree: object, replacements: list[tuple[str, str, str]], whole: str) -> object:
    """The tree with (pointer, format, text) replacements; pointers that lead nowhere are ignored.

    ``whole`` (json_obj or nbt_obj) replaces a map or list by a text that parses; lists of an NBT tree that
    are gone through become lists of compounds, as the format asks for one type.
    """
    return _fill(tree, _trie(replacements), whole)


def _parse(text: str, whole: str) -> object:
    try:
        return njson.parse(text, njson.FILE) if whole == "json_obj" else snbt.to_tree(snbt.parse(text))
    except ValueError:
        return None


def _fill(tree: object, branch: dict, whole: str) -> object:
    ends = branch.get(None, ())
    if isinstance(tree, str):
        return next((text for fmt, text in ends if fmt.endswith("_str")), tree)
    for fmt, text in ends:
        if fmt == whole and isinstance(tree, dict | list) and (new := _parse(text, whole)) is not None:
            return new
    if isinstance(tree, dict):
        return {k: _fill(v, branch[k], whole) if k in branch else v for k, v in tree.items()}
    if isinstance(tree, list) and any(isinstance(k, int) for k in branch):
        out = [_fill(v, branch[i], whole) if i in branch else v for i, v in enumerate(tree)]
        return [_compound(v) for v in out] if whole == "nbt_obj" and not all(isinstance(v, str) for v in out) else out
    return tree


def _compound(value: object) -> object:
    if isinstance(value, dict):
        return value
    if isinstance(value, str):
        return {"text": value}
    raise NotText(f"a list element of type {type(value).__name__}")


def spans_file(text: str, spans: list[tuple[int, int, str, str | None]]) -> str:
    """A function file with (start, end, replacement, syntax) spans replaced; string syntaxes get double quotes."""
    return splice(text, [(s, e, quoted(new, syntax)) for s, e, new, syntax in spans])
