"""Pointers into trees: ``>#key`` for a map entry and ``>3`` for a list element, joined."""

from __future__ import annotations

Point = str | int


def encode(points: tuple[Point, ...] | list[Point]) -> str:
    """The wire form; ``>`` inside a key is written ``&>``."""
    return "".join(f">{p}" if isinstance(p, int) else ">#" + p.replace(">", "&>") for p in points)


def decode(text: str) -> tuple[Point, ...]:
    """Points of a wire form. Repeated ``>`` count once, ``''`` is the root, anything malformed raises ValueError."""
    if not text:
        return ()
    if text[0] != ">":
        raise ValueError("a pointer starts with '>'")
    segments, part, i = [], None, 0
    while i < len(text):
        c = text[i]
        if c == ">":
            if part:
                segments.append(part)
            part = ""
        elif c == "&" and text[i + 1 : i + 2] == ">":
            part += ">"
            i += 1
        else:
            part += c
        i += 1
    if not part:
        raise ValueError("a pointer doesn't end with '>'")
    segments.append(part)
    points: list[Point] = []
    for s in segments:
        head, mark, key = s.partition("#")
        if mark:
            points.append(key)
        else:
            points.append(int(head))
    return tuple(points)


def access(tree: object, points: tuple[Point, ...]) -> str:
    """The string at a pointer; IndexError, KeyError or TypeError say what is missing."""
    for p in points:
        if isinstance(p, int):
            if not isinstance(tree, list):
                raise TypeError("not a list")
            if not 0 <= p < len(tree):
                raise IndexError(p)
        elif not isinstance(tree, dict):
            raise TypeError("not a map")
        tree = tree[p]
    if not isinstance(tree, str):
        raise TypeError("not a string")
    return tree
