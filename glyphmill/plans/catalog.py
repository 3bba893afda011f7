"""Builtin catalogs. The patterns and tables are fixed values of the game's data formats."""

from __future__ import annotations

from glyphmill.plans.patterns import ANY, COMMAND, CommandPattern, Condition, Kind, Patterns, PointerPattern, all_of, at, equal, none_of, one_of, regex


def _right(value: str, kind: Kind | None = None) -> PointerPattern:
    return PointerPattern("right", value, kind=kind or Kind())


def _regex(value: str, kind: Kind | None = None) -> PointerPattern:
    return PointerPattern("regex", value, kind=kind or Kind())


# Pointers that hold text.
_ITEM = [_regex(rf">#components>#(minecraft:)?{x}(>#raw)?$") for x in ("custom_name", "item_name", "text_display", "description")] + [
    _regex(r">#components>#(minecraft:)?lore(>\d+>#raw)?$"),
    _regex(r">#components>#(minecraft:)?written_book_content>#(?:pages|title|author)(?:>\d+>#(?:raw|filtered))?$"),
    _regex(r">#components>#(minecraft:)?writable_book_content>#pages(?:>\d+>#(?:raw|filtered))?$"),
]

# Pointers in NBT of worlds.
NBT = _ITEM + [
    _right(">#Command", COMMAND),
    _right(">#CustomName"),
    *(_right(f">#{a}>#{b}") for a in ("display", "SkullOwner") for b in ("Name", "Lore")),
    _regex(r"#instrument>#description$"),
    _regex(r"#attribute_modifiers>#modifiers>\d+>#display>#value$"),
    _regex(r">#Entities>\d+>#text$"),
    _regex(r">#Entities>\d+>#description$"),
    _regex(r">#Entities>\d+>#raw_text$"),
    *(_right(f">#Book>#tag>#{x}") for x in ("title", "author", "pages", "display", "filtered_pages", "filtered_title")),
    _regex(r">#TileEntities>\d+>#Text\d$"),
    _regex(r">#tag>#(pages|title|author)$"),
    _regex(r">#block_entities>\d+>#(front|back)_text>#(filtered_)?messages(>\d+>#raw)?$"),
    _regex(r">#block_entities>\d+>#LastOutput$"),
    _regex(r">#block_entities>\d+>#description$"),
    _right("#banners>#name"),
]

# Pointers in JSON files of packs.
MCJSON = _ITEM + [
    _right(">#display>#title"),
    _right(">#display>#description"),
    _right(">#display>#Name"),
    _regex(r">#display>#Lore$"),
    _right(">#CustomName"),
    _regex(r">#(front|back)_text>#messages$"),
    _regex(r">#pages"),
    _right(">#title"),
    _right(">#author"),
    _right(">#external_title"),
    _regex(r">#(?:yes|no|after_action|exit_action|actions>\d+)>#(?:label|tooltip)$"),
    _regex(r">#functions>\d+>#(name|lore)$"),
    _regex(r">#functions>\d+>#entity>#name$"),
    _regex(r">#functions>\d+>#modifiers>\d+>#name$"),
    _regex(r">\d+>#lore"),
    _regex(r">#functions>\d+>#tag$", Kind("structure", "snbt_str", "nbt")),
    _right(">#description"),
]

# Pointers in the data of commands.
DATA = NBT + [
    PointerPattern("equal", ">#name"),
    _right(">#text"),
    _right(">#CustomName"),
    _regex(r"^>#(?:title|external_title)$"),
    _regex(r">#(?:yes|no|after_action|exit_action|actions>\d+)>#(?:label|tooltip)$"),
    _regex(r"^>#body>\d+>#contents$"),
    _regex(r"^>#dialogs>\d+>#(?:title|external_title)$"),
    _regex(r"^>#inputs>\d+>#label$"),
    _regex(r"^>#body>\d+>#description$"),
]

# Item components that hold text.
COMPONENTS: dict[str, PointerPattern | None] = {
    **dict.fromkeys(("custom_name", "item_name", "text_display", "description", "lore")),
    "written_book_content": _regex(r">#(?:text|author|pages)$"),
    "writable_book_content": _right("pages"),
}

TC, SN, IS = "text_component_entire", "snbt_entire", "item_stack"
_J = {"type": "with_info", "format": "json_str", "syntax": None}
_ID = regex(r"^(?:[\w\-./]+:)?[\w\-./]+$")
_BRACE = regex(r"^\{")
_IS_TC = Condition("matches", call=lambda command, arg: _component(arg))
_IS_JSON = Condition("matches", call=lambda command, arg: _json(arg))


def _component(arg: str) -> bool:
    from glyphmill.parse import component, njson

    found = component.read_json(arg)
    return (found is not njson.JsonError and component.is_text(found)) or component.is_text(component.read_snbt(arg))


def _json(arg: str) -> bool:
    from glyphmill.parse import component, njson

    return arg[:1] in ('{', '[', '"') and component.read_json(arg) is not njson.JsonError


def _exact(n: int) -> Condition:
    return Condition("with_size", number=n, strict=True)


def _most(n: int) -> Condition:
    return Condition("with_size", number=n)


def _args(**texts: str) -> list[Condition]:
    return [at(int(k[1:]), v) for k, v in texts.items()]


def _any_of(position: int, *texts: str) -> Condition:
    return at(position, one_of(*map(equal, texts)))


def _one(command: str, pre: Condition, position: int, how: object, *post: Condition) -> CommandPattern:
    return CommandPattern(command, pre, None, {position: how}, all_of(*post) if post else ANY)


def _items() -> list[CommandPattern]:
    out = [
        _one("item", _exact(5), 5, SN, *_args(c1="modify", c2="entity"), none_of(_ID)),
        _one("item", _exact(7), 7, SN, *_args(c1="modify", c2="block"), none_of(_ID)),
    ]
    for verb in ("replace", "fill", "override"):
        extra = [none_of(_ID)] if verb == "fill" else []
        out.append(_one("item", _most(6), 6, IS, *_args(c1=verb, c2="entity", c5="with"), *extra))
        out.append(_one("item", _most(8), 8, IS, *_args(c1=verb, c2="block", c7="with"), *extra))
        out.append(_one("item", _exact(9), 9, SN, *_args(c1=verb, c2="entity", c5="from", c6="entity"), none_of(_ID)))
        crossed = one_of(all_of(*_args(c2="entity", c5="from", c6="block")), all_of(*_args(c2="block", c7="from", c8="entity")))
        out.append(_one("item", _exact(11), 11, SN, at(1, verb), crossed, none_of(_ID)))
        out.append(_one("item", _exact(13), 13, SN, *_args(c1=verb, c2="block", c7="from", c8="block"), none_of(_ID)))
    return out


# Which arguments of which commands hold text.
COMMANDS: list[CommandPattern] = [
    *(CommandPattern(c, greedy=0) for c in ("say", "me", "teammsg")),
    *(CommandPattern(c, _most(2), greedy=2) for c in ("tell", "msg", "w", "kick")),
    _one("tellraw", _exact(2), 2, TC),
    _one("title", _exact(3), 3, TC, none_of(at(2, "times"))),
    _one("dialog", _exact(3), 3, SN, at(1, "show"), _BRACE),
    _one("bossbar", _exact(3), 3, TC, at(1, "add")),
    _one("bossbar", _most(4), 4, TC, *_args(c1="set", c3="name")),
    _one("scoreboard", _exact(5), 5, TC, at(1, "objectives"), one_of(at(2, "add"), all_of(*_args(c2="modify", c4="displayname")))),
    _one("scoreboard", _exact(6), 6, TC, *_args(c1="objectives", c2="modify", c4="numberformat", c5="fixed")),
    _one("scoreboard", _exact(6), 6, TC, *_args(c1="players", c2="display", c3="name")),
    _one("scoreboard", _exact(7), 7, TC, *_args(c1="players", c2="display", c3="numberformat", c6="fixed")),
    _one("team", _exact(4), 4, TC, at(1, "modify"), _any_of(3, "displayName", "prefix", "suffix")),
    _one("team", _exact(3), 3, TC, at(1, "add")),
    _one("data", _exact(7), 7, TC, at(1, "modify"), _any_of(2, "entity", "storage"), *_args(c5="set", c6="value"), _IS_TC),
    _one("data", _exact(9), 9, TC, *_args(c1="modify", c2="block", c7="set", c8="value"), _IS_TC),
    _one("data", all_of(_most(4), regex("merge (entity|storage)")), 4, SN, _BRACE),
    _one("data", all_of(_most(6), regex("merge block")), 6, SN, _BRACE),
    _one("give", _most(2), 2, IS),
    *_items(),
    *(_one("replaceitem", _exact(n), n, _J, at(1, "block"), _IS_JSON) for n in (10, 11)),
    *(_one("replaceitem", _exact(n), n, _J, at(1, "entity"), _IS_JSON) for n in (8, 9)),
    _one("setblock", _most(5), 5, SN, _BRACE),
    _one("summon", _exact(5), 5, SN),
]


def builtin() -> Patterns:
    by_name: dict[str, list[CommandPattern]] = {}
    for p in COMMANDS:
        by_name.setdefault(p.command, []).append(p)
    return Patterns(NBT, MCJSON, by_name, DATA, COMPONENTS)
