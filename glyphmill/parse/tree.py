"""Values of the format-neutral tree: dict, list, str, bool, None, and numbers that know their width."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Num:
    """A number of a kind (byte short int long float double); ``raw`` keeps how a text wrote it."""

    kind: str
    value: int | float
    raw: str | None = None


@dataclass
class Array:
    """A typed array of a kind (byte int long)."""

    kind: str
    values: list[int]


SUFFIX = {"byte": "b", "short": "s", "int": "", "long": "L", "float": "f", "double": "d"}
BITS = {"byte": 8, "short": 16, "int": 32, "long": 64}


def fits(value: int, kind: str) -> bool:
    return -(1 << BITS[kind] - 1) <= value < 1 << BITS[kind] - 1


def plain(tree: object) -> object:
    """The tree with numbers as Python's and arrays as lists."""
    if isinstance(tree, Num):
        return tree.value
    if isinstance(tree, Array):
        return list(tree.values)
    if isinstance(tree, dict):
        return {k: plain(v) for k, v in tree.items()}
    if isinstance(tree, list):
        return [plain(v) for v in tree]
    return tree
