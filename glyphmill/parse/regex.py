"""Regular expressions as worlds' pattern files write them: Java's named groups, closed ranges, groups that took no part as None."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

_NAMED = re.compile(r"\(\?<(?=[A-Za-z])")
_REFERENCE = re.compile(r"\\k<(\w+)>")
_IN_REPLACEMENT = re.compile(r"\\(.)|\$(?:\{(\w+)\}|(\d))", re.S)


@dataclass(frozen=True)
class Group:
    value: str
    range: tuple[int, int]


class Match:
    """One match; ranges are closed, and an empty match ends before it begins."""

    def __init__(self, found: re.Match):
        self._found = found
        self.value, self.range = found[0], (found.start(), found.end() - 1)

    def group(self, which: int | str) -> Group | None:
        value = self._found[which]
        return None if value is None else Group(value, (self._found.start(which), self._found.end(which) - 1))

    @property
    def values(self) -> list[str]:
        """The whole match and its groups; '' for those that took no part."""
        return [self._found[0], *(x or "" for x in self._found.groups())]


class Pattern:
    def __init__(self, pattern: str, flags: int = 0):
        self.pattern = pattern
        self._compiled = re.compile(_REFERENCE.sub(r"(?P=\1)", _NAMED.sub("(?P<", pattern)), flags)

    @staticmethod
    def literal(text: str) -> Pattern:
        return Pattern(re.escape(text))

    def matches(self, text: str) -> bool:
        """Whether the whole text matches."""
        return self._compiled.fullmatch(text) is not None

    def contains(self, text: str) -> bool:
        return self._compiled.search(text) is not None

    def find(self, text: str, start: int = 0) -> Match | None:
        if not 0 <= start <= len(text):
            raise IndexError(start)
        found = self._compiled.search(text, start)
        return Match(found) if found else None

    def find_all(self, text: str, start: int = 0) -> Iterator[Match]:
        if not 0 <= start <= len(text):
            raise IndexError(start)
        return map(Match, self._compiled.finditer(text, start))

    def entire(self, text: str) -> Match | None:
        found = self._compiled.fullmatch(text)
        return Match(found) if found else None

    def match_at(self, text: str, at: int) -> Match | None:
        found = self._compiled.match(text, at)
        return Match(found) if found else None

    def _expanded(self, replacement: str) -> Callable[[re.Match], str]:
        return lambda m: _IN_REPLACEMENT.sub(lambda r: r[1] if r[1] is not None else (m[r[2] if r[2] and not r[2].isdigit() else int(r[2] or r[3])] or ""), replacement)

    def replace(self, text: str, replacement: str | Callable[[Match], str]) -> str:
        """All matches replaced; in a replacement text $1 and ${name} stand for groups, a backslash takes the next character as it is."""
        return self._compiled.sub((lambda m: replacement(Match(m))) if callable(replacement) else self._expanded(replacement), text)

    def replace_first(self, text: str, replacement: str) -> str:
        return self._compiled.sub(self._expanded(replacement), text, count=1)

    def split(self, text: str, limit: int = 0) -> list[str]:
        """Parts between matches, at most ``limit`` of them if that isn't 0; empty ones stay."""
        if limit < 0:
            raise ValueError("a limit below 0")
        out, at = [], 0
        for m in self._compiled.finditer(text):
            if limit and len(out) + 1 >= limit:
                break
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]


def escape(text: str) -> str:
    return re.escape(text)


def escape_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")
