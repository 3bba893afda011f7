"""Text components: recognising them, reading what a reader would see, simplifying, stripping and matching by shape."""

from __future__ import annotations

import re

from glyphmill.parse import njson, snbt
from glyphmill.parse.tree import Array, Num

# The field names of text components.
FIELDS = frozenset(
    """type text translate fallback with score selector separator keybind nbt source block entity storage interpret
    plain object atlas sprite player hat extra color shadow_color font bold italic underlined strikethrough obfuscated
    insertion click_event hover_event clickEvent hoverEvent""".split()
)
STRUCTURAL = frozenset("extra with hover_event click_event hoverEvent clickEvent score separator player shadow_color".split())
KINDS = ("text", "translate", "keybind", "score", "selector", "nbt", "object", "sprite")
STYLE = frozenset("color bold italic underlined strikethrough obfuscated".split())
MANAGED = frozenset("type text extra".split()) | STYLE
_TRANSLATE_KEY = re.compile(r"[\w.]+\.+[\w.]+", re.A)


def is_shorthand(tree: dict) -> bool:
    return "text" not in tree and isinstance(tree.get(""), str)


def is_component(tree: object) -> bool:
    """Whether a map or list is a text component; empty ones are."""
    if isinstance(tree, dict):
        return is_shorthand(tree) or all(k in FIELDS and (k in STRUCTURAL or not isinstance(v, dict | list | Array)) for k, v in tree.items())
    if isinstance(tree, list):
        return all(isinstance(x, str) or (isinstance(x, dict | list) and is_component(x)) for x in tree)
    return False


def is_text(tree: object) -> bool:
    return isinstance(tree, str) or (isinstance(tree, dict | list) and is_component(tree))


def read_snbt(text: str) -> object:
    """The tree of an SNBT text, or None where it doesn't parse (NBT has no null)."""
    try:
        return snbt.to_tree(snbt.parse(text))
    except snbt.SnbtError:
        return None


def read_json(text: str, dialect: njson.Dialect = njson.COMMAND) -> object:
    """The tree of a JSON text, or njson.JsonError itself where it doesn't parse."""
    try:
        return njson.parse(text, dialect)
    except njson.JsonError:
        return njson.JsonError


def _wrapped(text: str, quotes: str = "\"'") -> bool:
    return len(text) > 1 and any(text[0] == a and text[-1] == b for a, b in (*((q, q) for q in quotes), "[]", "{}"))


def is_snbt(text: str) -> bool:
    """Whether a quoted or bracketed text is SNBT."""
    return _wrapped(text) and read_snbt(text) is not None


def is_json(text: str, dialect: njson.Dialect | None = None) -> bool:
    """Whether a quoted or bracketed text is JSON of a dialect, the standard's if none is given."""
    dialect = dialect or njson.Dialect()
    return _wrapped(text, "\"'" if dialect.single_quote else '"') and read_json(text, dialect) is not njson.JsonError


def infer_format(text: str) -> str:
    """snbt_str, json_str or plain_str: SNBT is tried first, and only components count."""
    if is_text(read_snbt(text)) and text.strip()[:1] in ('{', '[', '"', "'"):
        return "snbt_str"
    found = read_json(text)
    return "json_str" if found is not njson.JsonError and not isinstance(found, str) and is_text(found) else "plain_str"


def kind_of(tree: object) -> str:
    """plain, many, or the name of the component's content; ValueError if it has none."""
    if isinstance(tree, str):
        return "text"
    if isinstance(tree, list):
        return "many"
    if isinstance(tree, dict):
        named = tree.get("type")
        if isinstance(named, str) and named in (*KINDS, "translatable"):
            return {"translatable": "translate"}.get(named, named)
        for kind in KINDS:
            if kind in tree:
                return kind
        if is_shorthand(tree):
            return "text"
    raise ValueError("no text component")


def readable(text: str) -> bool:
    """Whether a text has a letter or mark."""
    import unicodedata

    return any(unicodedata.category(c)[0] in "LM" for c in text)


def is_translate_key(text: str) -> bool:
    return bool(_TRANSLATE_KEY.fullmatch(text))


def is_pure_key(tree: object) -> bool:
    return isinstance(tree, dict) and kind_of(tree) == "translate" and not {"with", "fallback", "extra"} & tree.keys() and is_translate_key(str(tree.get("translate")))


def _children(tree: dict, key: str) -> list:
    found = tree.get(key)
    return found if isinstance(found, list) else [found] if found is not None else []


def has_readable(tree: object) -> bool:
    """Whether a component shows text of letters that can be translated; pure translation keys don't."""
    if isinstance(tree, str):
        return readable(tree)
    if isinstance(tree, list):
        return any(has_readable(x) for x in tree if isinstance(x, str | list | dict))
    kind = kind_of(tree)
    if kind == "translate":
        if is_pure_key(tree):
            return False
        own = readable(str(tree.get("fallback") or tree.get("translate") or "")) or any(has_readable(x) for x in _children(tree, "with") if isinstance(x, str | list | dict))
    elif kind == "text":
        own = readable(str(tree.get("text", tree.get("", ""))))
    else:
        own = kind == "selector" and any(has_readable(x) for x in _children(tree, "separator"))
    return own or any(has_readable(x) for x in _children(tree, "extra") if isinstance(x, str | list | dict))


def replace_text(tree: object, text: str) -> object:
    """The component with its own text replaced; a translatable one gets it as its fallback."""
    if isinstance(tree, str):
        return text
    if not isinstance(tree, dict):
        raise ValueError("a list has no text of its own")
    return {**{k: v for k, v in tree.items() if k != ""}, "fallback" if kind_of(tree) == "translate" else "text": text}


def simplify(tree: object) -> object:
    """Unstyled plain components as strings, with extra as flat lists."""
    if isinstance(tree, list):
        return [simplify(x) for x in tree]
    if isinstance(tree, dict) and kind_of(tree) == "text":
        text = tree.get("text", tree.get(""))
        if not (tree.keys() - {"type", "text", "extra", ""}):
            extra = _children(tree, "extra")
            if not extra:
                return text
            return [text, *(y for x in extra for y in (lambda z: z if isinstance(z, list) else [z])(simplify(x)))]
        if "extra" in tree:
            return {**tree, "extra": [simplify(x) for x in _children(tree, "extra")]}
    return tree


def to_rule(tree: object) -> str | None:
    """The rule-language form of a component's shape: |text|, (text newline extra), [element newline ...]; None with other content."""
    if isinstance(tree, str):
        return "|" + tree.replace("&", "&&").replace("|", "&|") + "|"
    if isinstance(tree, list):
        parts = [to_rule(x) for x in tree]
        return None if None in parts else "[" + "\n".join(parts) + "]"
    if isinstance(tree, dict):
        try:
            if kind_of(tree) != "text":
                return None
        except ValueError:
            return None
        own = to_rule(str(tree.get("text", tree.get("", ""))))
        if "extra" not in tree:
            return own
        extra = to_rule(_children(tree, "extra"))
        return None if extra is None else f"({own}\n{extra})"
    return None


def strip(text: str, fmt: str) -> tuple[str, str, bool]:
    """(kind, text to translate, whether it was a list of one).

    no_component: a plain text; untranslatable: nothing readable; simplified: the only text of a
    component; cannot_strip: the whole component has to be translated.
    """
    if fmt == "plain_str":
        return "no_component", text, False
    tree = read_snbt(text) if fmt in ("snbt_str", "nbt_obj") else read_json(text)
    if tree is None or tree is njson.JsonError or isinstance(tree, Num | bool | Array):
        return "no_component", text, False
    single = isinstance(tree, list) and len(tree) == 1
    if isinstance(tree, list) and not single:
        return ("cannot_strip", text, False) if is_text(tree) else ("no_component", text, False)
    inner = tree[0] if single else tree
    try:
        if not is_text(inner):
            return "no_component", text, False
        if not has_readable(inner):
            return "untranslatable", text, single
        if isinstance(inner, str):
            return "simplified", inner, single
        if isinstance(inner, dict) and kind_of(inner) == "text" and "extra" not in inner:
            return "simplified", str(inner.get("text", inner.get(""))), single
    except ValueError:
        return "no_component", text, False
    return "cannot_strip", text, False


def destrip(text: str, fmt: str, translated: str | None) -> str | None:
    """A translation put back into the component it was stripped from; None stays untranslated."""
    if translated is None:
        return None
    kind, _, single = strip(text, fmt)
    if kind != "simplified":
        return translated
    tree = read_snbt(text) if fmt in ("snbt_str", "nbt_obj") else read_json(text)
    new = replace_text(tree[0] if single else tree, translated)
    new = [new] if single else new
    return snbt.write(new) if fmt in ("snbt_str", "nbt_obj") else njson.write(new)
