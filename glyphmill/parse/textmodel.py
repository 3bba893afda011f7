"""Text components as objects of eight kinds: read from a tree, edited, and written back with unknown fields kept."""

from __future__ import annotations

from dataclasses import dataclass, field

from glyphmill.parse.component import MANAGED, is_shorthand, is_translate_key, kind_of, readable
from glyphmill.parse.tree import Num

# The fields that each kind has besides style and extra, the first of which it can't be without.
OWN = {
    "text": ("text",),
    "translate": ("translate", "fallback", "with"),
    "keybind": ("keybind",),
    "score": ("score",),
    "selector": ("selector", "separator"),
    "nbt": ("nbt", "interpret", "block", "entity", "storage", "separator"),
    "object": ("object",),
    "sprite": ("sprite",),
}
FLAGS = ("bold", "italic", "underlined", "strikethrough", "obfuscated")
STYLES = ("color", *FLAGS, "font")
_NESTED = ("separator",)


class ComponentError(ValueError):
    pass


def _flag(value: object) -> object:
    return bool(value.value) if isinstance(value, Num) else value


@dataclass
class Single:
    """A component with one content. ``own`` holds the kind's fields, ``style`` colour, flags and font; None is absent."""

    kind: str
    raw: dict | str
    own: dict = field(default_factory=dict)
    style: dict = field(default_factory=dict)
    extra: Single | Many | None = None

    def tree(self) -> dict | str:
        """The component as a tree: fields that were edited in place of the old ones, all others as they were."""
        own = {k: _out(v) for k, v in self.own.items()}
        if isinstance(self.raw, str):
            if self.extra is None and not any(v is not None for v in self.style.values()):
                return self.own["text"]
            base: dict = {}
        else:
            base = {k: v for k, v in self.raw.items() if k != "" or not is_shorthand(self.raw)}
        made = base | own | {k: self.style.get(k) for k in STYLES} | {"extra": None if self.extra is None else self.extra.tree()}
        if self.kind == "nbt" and made.get("interpret") is None:
            made["interpret"] = False
        managed = {*OWN[self.kind], *STYLES, "extra"}
        return {k: v for k, v in made.items() if v is not None or k not in managed}

    def plain_style(self) -> bool:
        """No colour and no flag is set."""
        return all(self.style.get(k) is None for k in ("color", *FLAGS))

    def unmanaged(self) -> list[str]:
        """Fields outside of text, extra and style, which simplifying would lose."""
        return [] if isinstance(self.raw, str) else sorted(k for k in self.raw if k not in MANAGED and k != "")


@dataclass
class Many:
    """A list of components."""

    parts: list

    def tree(self) -> list:
        return [x.tree() for x in self.parts]


def _out(value: object) -> object:
    if isinstance(value, Single | Many):
        return value.tree()
    return [_out(v) for v in value] if isinstance(value, list) else value


def read(tree: object) -> Single | Many:
    """The component of a tree; ComponentError where it has no kind, or lacks its kind's content."""
    if isinstance(tree, str):
        return Single("text", tree, {"text": tree}, {})
    if isinstance(tree, list):
        return Many([read(x) for x in tree])
    if not isinstance(tree, dict):
        raise ComponentError("a component is a string, a list or a map")
    if "type" in tree and not isinstance(tree["type"], str):
        raise ComponentError("type must be a string")
    try:
        kind = kind_of(tree)
    except ValueError as e:
        raise ComponentError(str(e)) from None
    first = OWN[kind][0]
    own = {k: tree.get(k) for k in OWN[kind]}
    if kind == "text" and own["text"] is None and is_shorthand(tree):
        own["text"] = tree[""]
    if own[first] is None:
        raise ComponentError(f"{first} must exist")
    own = {k: read(v) if k in _NESTED and v is not None else [read(x) for x in v] if k == "with" and isinstance(v, list) and all(isinstance(x, str | list | dict) for x in v) else v for k, v in own.items()}
    if "interpret" in own:
        own["interpret"] = _flag(own["interpret"])
    style = {k: _flag(tree[k]) if k in FLAGS else tree[k] for k in STYLES if tree.get(k) is not None}
    return Single(kind, tree, own, style, read(tree["extra"]) if tree.get("extra") is not None else None)


def copied(c: Single | Many) -> Single | Many:
    return read(c.tree())


def flattened(c: Single | Many) -> list:
    return list(c.parts) if isinstance(c, Many) else [c]


def joined(c: Single | Many, others: list) -> Single | Many:
    """A copy with further components: at the end of a list, or as extra of a single one."""
    out = copied(c)
    if isinstance(out, Many):
        out.parts += others
    else:
        out.extra = Many([*others]) if out.extra is None else joined(out.extra, others)
    return out


def with_text(c: Single, text: str) -> Single:
    """A copy with another text; kinds without a text stay as they are."""
    out = copied(c)
    if out.kind == "text":
        out.own["text"] = text
    return out


def substituted(c: Single, text: str | None, extra: Single | Many | None) -> Single:
    """A copy with another extra, and where a text is given with that as its text, or as a translatable one's fallback."""
    out = copied(c)
    if text is not None and out.kind in ("text", "translate"):
        out.own["text" if out.kind == "text" else "fallback"] = text
    out.extra = extra
    return out


def has_text(c: Single | Many | None) -> bool:
    """Plain and translatable components have text; selectors by separator or extra, others by extra."""
    if c is None:
        return False
    if isinstance(c, Many):
        return any(map(has_text, c.parts))
    if c.kind in ("text", "translate"):
        return True
    return (c.kind == "selector" and has_text(c.own.get("separator"))) or has_text(c.extra)


def is_pure_key(c: Single | Many) -> bool:
    """A translation key and nothing else that a reader would see."""
    return isinstance(c, Single) and c.kind == "translate" and not c.own.get("with") and c.own.get("fallback") is None and c.extra is None and is_translate_key(str(c.own["translate"]))


def has_readable(c: Single | Many | None) -> bool:
    """Whether a reader would see letters that can be translated."""
    if c is None or (isinstance(c, Single) and is_pure_key(c)):
        return False
    if isinstance(c, Many):
        return any(map(has_readable, c.parts))
    if c.kind == "text":
        return readable(str(c.own["text"])) or has_readable(c.extra)
    if c.kind == "selector":
        return has_readable(c.own.get("separator")) or has_readable(c.extra)
    if c.kind == "translate":
        inside = [x for x in c.own.get("with") or [] if isinstance(x, Single | Many)]
        return readable(str(c.own["translate"])) or readable(str(c.own.get("fallback") or "")) or any(map(has_readable, inside)) or has_readable(c.extra)
    return has_text(c.extra)
