"""Command lines of function files: names and arguments with their spans.

Positions are code points inside a text and end exclusive; :func:`utf16` turns them into UTF-16 units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Arg:
    content: str
    start: int
    end: int


@dataclass
class Command:
    raw: str
    name: str
    start: int
    args: list[Arg] = field(default_factory=list)
    macro: bool = False


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_PAIRS = {"}": "{", "]": "["}


def lines(text: str):
    """(offset, line) without line ends."""
    at = 0
    while at <= len(text):
        found = _LINE.match(text, at)
        yield at, found[0].rstrip("\r\n")
        if found.end() == at or (found.end() == len(text) and text[-1:] not in "\r\n"):
            return
        at = found.end()


def parse_line(line: str, offset: int = 0) -> Command | None:
    """The command of a line; None for blank lines, comments and lines that aren't commands."""
    i = len(line) - len(line.lstrip(" "))
    macro = line[i : i + 1] == "$"
    i += macro
    if not macro and line[i : i + 1] == "/":
        i += 1
    if not line[i : i + 1].isalpha():
        return None
    parts, open_, quote, start, j = [], [], "", i, i
    while j < len(line):
        c = line[j]
        if quote:
            if c == "\\":
                j += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "{[":
            open_.append(c)
        elif c in "}]":
            if not open_ or open_.pop() != _PAIRS[c]:
                return None
        elif c == " " and not open_:
            parts.append((start, j))
            start = j + 1
        j += 1
    parts.append((start, len(line)))
    if len(parts) > 1 and parts[-1][0] == parts[-1][1]:
        parts.pop()
    (a, b), rest = parts[0], parts[1:]
    return Command(line.lstrip(), line[a:b], offset + i, [Arg(line[s:e], offset + s, offset + e) for s, e in rest], macro)


def parse_commands(text: str) -> list[Command]:
    return [c for at, line in lines(text) if (c := parse_line(line, at)) is not None]


def after_run(command: Command) -> Command | None:
    """What ``execute`` and ``return`` run: the command after the first ``run``; without one, the arguments as a command."""
    k = next((i for i, a in enumerate(command.args) if a.content == "run"), -1)
    rest = command.args[k + 1 :]
    if not rest:
        return None
    base = rest[0].start
    raw = command.raw[len(command.raw) - (command.args[-1].end - base) :] if command.args else ""
    return Command(raw, rest[0].content, base, rest[1:], command.macro)


def utf16(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans as UTF-16 spans, both end exclusive."""
    wide = [i for i, c in enumerate(text) if c > "￿"]
    if not wide:
        return spans
    from bisect import bisect_left

    move = lambda i: i + bisect_left(wide, i)
    return [(move(s), move(e)) for s, e in spans]


class OverlapError(ValueError):
    pass


def splice(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans (UTF-16, end exclusive) replaced; overlapping ones raise OverlapError."""
    raw, out, at = text.encode("utf-16-le", "surrogatepass"), [], 0
    for s, e, new in sorted(spans, key=lambda x: x[:2]):
        if 2 * s < at:
            raise OverlapError("Replacements cannot overlap with each other")
        out += [raw[at : 2 * s], new.encode("utf-16-le", "surrogatepass")]
        at = 2 * e
    return b"".join([*out, raw[at:]]).decode("utf-16-le", "surrogatepass")
