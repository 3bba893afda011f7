"""Conversions between JSON, NBT and SNBT trees, with the number widths that each way chooses."""

from __future__ import annotations

import struct

from glyphmill.parse.nbt import NbtError
from glyphmill.parse.tree import Array, Num, fits

# The style flags that components write as booleans.
_FLAGS = frozenset("bold italic underlined strikethrough obfuscated interpret hat".split())


def json_to_nbt(tree: object) -> object:
    """Numbers become int, long, float or double, whichever is the first to hold them exactly; booleans bytes. Nulls, empty and mixed lists have no form."""
    if isinstance(tree, dict):
        return {k: json_to_nbt(v) for k, v in tree.items()}
    if isinstance(tree, list):
        out = [json_to_nbt(v) for v in tree]
        if not out:
            raise NbtError("an empty list has no type")
        if len({(type(v), getattr(v, "kind", None)) for v in out}) > 1:
            raise NbtError("a list of several types")
        return out
    if isinstance(tree, bool):
        return Num("byte", int(tree))
    if isinstance(tree, Num):
        if isinstance(tree.value, int):
            kind = next((k for k in ("int", "long") if fits(tree.value, k)), None)
            return Num(kind, tree.value) if kind else Num("double", float(tree.value))
        single = struct.unpack(">f", struct.pack(">f", tree.value))[0] if abs(tree.value) < 3.4e38 else None
        return Num("float" if single == tree.value else "double", tree.value)
    if tree is None:
        raise NbtError("null has no tag")
    return tree


def nbt_to_json(tree: object) -> object:
    """Numbers keep their value, arrays become lists."""
    if isinstance(tree, dict):
        return {k: nbt_to_json(v) for k, v in tree.items()}
    if isinstance(tree, list):
        return [nbt_to_json(v) for v in tree]
    if isinstance(tree, Array):
        return [Num("long", v, str(v)) for v in tree.values]
    if isinstance(tree, Num):
        return Num(tree.kind, tree.value, str(tree.value))
    return tree


def neutral(tree: object) -> object:
    """The format-neutral form: typed arrays as lists of numbers of that type."""
    if isinstance(tree, dict):
        return {k: neutral(v) for k, v in tree.items()}
    if isinstance(tree, list):
        return [neutral(v) for v in tree]
    if isinstance(tree, Array):
        return [Num(tree.kind, v) for v in tree.values]
    return tree


def normal_component(tree: object) -> object:
    """A component with style flags as booleans whatever wrote them; unknown fields stay as they are."""
    if isinstance(tree, list):
        return [normal_component(v) for v in tree]
    if not isinstance(tree, dict):
        return tree
    out = {}
    for k, v in tree.items():
        if k in _FLAGS and isinstance(v, Num):
            out[k] = bool(v.value)
        else:
            out[k] = normal_component(v) if k in ("extra", "with", "separator") else v
    if "nbt" in out:
        out.setdefault("interpret", False)
    return out
