"""Patterns on pointers and commands, their JSON forms, and their meaning."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.parse.commands import Command


@dataclass(frozen=True)
class Kind:
    """What a matched content is: text, command, or structure (a nested tree with a format and a pattern list)."""

    type: str = "text"
    format: str = "snbt_str"
    inherit: str = "nbt"


TEXT, COMMAND = Kind(), Kind("command")


@functools.lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?<", "(?P<") if re.search(r"\(\?<[A-Za-z]", pattern) else pattern, re.A)


@dataclass(frozen=True)
class PointerPattern:
    """``equal``, ``right`` (ends with) or ``regex`` (found in) on a pointer's wire form."""

    type: str
    value: str
    negative: bool = False
    kind: Kind = TEXT

    def matches(self, pointer: str) -> bool:
        if self.type == "equal":
            found = pointer == self.value
        elif self.type == "right":
            found = pointer.endswith(self.value)
        else:
            found = bool(_compiled(self.value).search(pointer))
        return found != self.negative

    def column(self, pointer: Column) -> Column:
        """The same as a Spark predicate, which optimisers can see through."""
        found = {"equal": lambda: pointer == F.lit(self.value), "right": lambda: pointer.endswith(self.value), "regex": lambda: pointer.rlike(self.value)}[self.type]()
        return ~found if self.negative else found

    def to_json(self) -> dict:
        out = {"type": self.type, {"equal": "value", "right": "right", "regex": "regex"}[self.type]: self.value}
        if self.negative:
            out["negative"] = True
        if self.kind != TEXT:
            out["kind"] = {"type": "command"} if self.kind.type == "command" else {"type": "structure", "format": self.kind.format, "inherit_from": self.kind.inherit}
        return out

    @staticmethod
    def from_json(raw: dict) -> PointerPattern:
        kind = raw.get("kind") or {}
        made = TEXT if not kind or kind["type"] == "text" else Kind(kind["type"], kind.get("format", "snbt_str"), kind.get("inherit_from", "nbt"))
        return PointerPattern(raw["type"], raw.get("value", raw.get("right", raw.get("regex"))), raw.get("negative", False), made)


def first_match(patterns: list[PointerPattern] | None, pointer: str) -> PointerPattern | None:
    """The first pattern of a list that matches; with no list (None) everything matches as text."""
    if patterns is None:
        return PointerPattern("right", "")
    return next((p for p in patterns if p.matches(pointer)), None)


def any_match(patterns: list[PointerPattern] | None, pointer: Column) -> Column:
    return F.lit(True) if patterns is None else functools.reduce(lambda a, b: a | b, (p.column(pointer) for p in patterns), F.lit(False))


def first_match_index(patterns: list[PointerPattern], pointer: Column) -> Column:
    """Number of the first pattern in list order that matches, or null."""
    return F.coalesce(*(F.when(p.column(pointer), F.lit(i)) for i, p in enumerate(patterns)), F.lit(None).cast("int"))


@dataclass(frozen=True)
class Condition:
    """Conditions on commands (pre) and on commands with an argument (post).

    any, and, or, none (no nested one holds), regex (found in the command's or argument's text),
    with_size (argument count: at most ``number``, or exactly if strict), at (the nested condition on
    another argument), contain, equal, and matches (a Python callable, without JSON form).
    """

    type: str
    conditions: tuple[Condition, ...] = ()
    text: str = ""
    number: int = 0
    strict: bool = False
    call: Callable | None = None

    def holds(self, command: Command, arg: str | None = None) -> bool:
        t = self.type
        if t == "any":
            return True
        if t == "and":
            return all(c.holds(command, arg) for c in self.conditions)
        if t == "or":
            return any(c.holds(command, arg) for c in self.conditions)
        if t == "none":
            return not any(c.holds(command, arg) for c in self.conditions)
        if t == "with_size":
            return len(command.args) == self.number if self.strict else len(command.args) <= self.number
        if t == "regex":
            return bool(_compiled(self.text).search(command.raw if arg is None else arg))
        if t == "at":
            if not 1 <= self.number <= len(command.args):
                raise IndexError(f"no argument {self.number}")
            return self.conditions[0].holds(command, command.args[self.number - 1].content)
        if t == "contain":
            return self.text in (arg or "")
        if t == "equal":
            return arg == self.text
        if t == "matches":
            return bool(self.call(command, arg))
        raise ValueError(f"condition {t!r}")

    def column(self, raw: Column, args: Column, arg: Column | None = None) -> Column:
        """The same over a command's text and its array of argument texts."""
        t = self.type
        nested = [c.column(raw, args, arg) for c in self.conditions] if t != "at" else []
        if t == "any":
            return F.lit(True)
        if t in ("and", "or", "none"):
            joined = functools.reduce((lambda a, b: a & b) if t == "and" else (lambda a, b: a | b), nested, F.lit(t == "and"))
            return ~joined if t == "none" else joined
        if t == "with_size":
            return F.size(args) == self.number if self.strict else F.size(args) <= self.number
        if t == "at":
            return self.conditions[0].column(raw, args, F.try_element_at(args, F.lit(self.number)))
        subject = raw if arg is None else arg
        return {"regex": lambda: subject.rlike(self.text), "contain": lambda: subject.contains(self.text), "equal": lambda: subject == self.text}[t]()

    def to_json(self) -> dict:
        if self.type == "matches":
            raise ValueError("a Python condition has no JSON form")
        out: dict = {"type": self.type}
        if self.type in ("and", "or", "none"):
            out["conditions"] = [c.to_json() for c in self.conditions]
        elif self.type == "with_size":
            out |= {"size": self.number, "strict": self.strict}
        elif self.type == "regex":
            out["regex"] = self.text
        elif self.type == "at":
            out |= {"position": self.number, "condition": self.conditions[0].to_json()}
        elif self.type in ("contain", "equal"):
            out["content"] = self.text
        return out

    @staticmethod
    def from_json(raw: dict) -> Condition:
        t = raw["type"]
        if t in ("and", "or", "none"):
            return Condition(t, tuple(map(Condition.from_json, raw["conditions"])))
        if t == "with_size":
            return Condition(t, number=raw["size"], strict=raw.get("strict", False))
        if t == "at":
            return Condition(t, (Condition.from_json(raw["condition"]),), number=raw["position"])
        return Condition(t, text=raw.get("regex", raw.get("content", "")))


ANY = Condition("any")


def all_of(*c: Condition) -> Condition:
    return c[0] if len(c) == 1 else Condition("and", c)


def equal(text: str) -> Condition:
    return Condition("equal", text=text)


def at(position: int, condition: Condition | str) -> Condition:
    return Condition("at", (equal(condition) if isinstance(condition, str) else condition,), number=position)


def none_of(*c: Condition) -> Condition:
    return Condition("none", c)


def one_of(*c: Condition) -> Condition:
    return Condition("or", c)


def regex(pattern: str) -> Condition:
    return Condition("regex", text=pattern)


@dataclass(frozen=True)
class CommandPattern:
    """Which arguments of a command hold text. ``greedy``: the rest of the line from a position (0: all); else ``select`` by 1-based position."""

    command: str
    pre: Condition = ANY
    greedy: int | None = None
    select: dict[int, str | dict | None] = field(default_factory=dict)
    post: Condition = ANY

    def to_json(self) -> dict:
        selector = {"type": "greedy", "position": self.greedy} if self.greedy is not None else {"type": "non_greedy", "indexes": {str(k): {"type": v} if isinstance(v, str) else v for k, v in self.select.items()}}
        return {"command": self.command, "pre": self.pre.to_json(), "selector": selector, "post": self.post.to_json()}

    @staticmethod
    def from_json(raw: dict) -> CommandPattern:
        s = raw["selector"]
        pre, post = (Condition.from_json(raw[k]) if raw.get(k) else ANY for k in ("pre", "post"))
        if s["type"] == "greedy":
            return CommandPattern(raw["command"], pre, s["position"], {}, post)
        select = {int(k): (v["type"] if v and set(v) == {"type"} else v) for k, v in s["indexes"].items()}
        return CommandPattern(raw["command"], pre, None, select, post)


@dataclass(frozen=True)
class RegexPattern:
    """Groups of a regular expression over a whole command text; each with an optional syntax and format."""

    regex: str
    groups: dict[int, dict | None]

    @staticmethod
    def from_json(raw: dict) -> RegexPattern:
        return RegexPattern(raw["regex"], {int(k): v for k, v in raw["groups"].items()})


@dataclass(frozen=True)
class Patterns:
    """All pattern lists of an extraction. None instead of a list switches that filter off."""

    nbt: list[PointerPattern] | None
    mcjson: list[PointerPattern] | None
    command: dict[str, list[CommandPattern]]
    data: list[PointerPattern] | None
    components: dict[str, PointerPattern | None] = field(default_factory=dict)
    regexes: list[RegexPattern] = field(default_factory=list)

    def with_custom(self, mode: str = "append", **lists) -> Patterns:
        """With own lists appended to the builtin ones, or in their place (mode='replace')."""
        new = dict(self.__dict__)
        for name, own in lists.items():
            if name == "command":
                merged = {} if mode == "replace" else {k: list(v) for k, v in self.command.items()}
                for p in own:
                    merged.setdefault(p.command, []).append(p)
                new[name] = merged
            else:
                new[name] = own if mode == "replace" or own is None else [*(new[name] or []), *own]
        return Patterns(**new)


def read_patterns(path: str, what: type) -> list:
    """Patterns of a JSON file on the driver, with comments and trailing commas."""
    from glyphmill.parse import njson
    from glyphmill.parse.tree import plain

    with open(path, encoding="utf-8") as f:
        return [what.from_json(x) for x in plain(njson.parse(f.read(), njson.Dialect(comments=True, trailing_comma=True)))]


def json_schema(what: str) -> str:
    """JSON Schema of the pattern files: command, data_pointer or command_regex."""
    condition = {"type": "object", "required": ["type"], "properties": {"type": {"enum": ["any", "and", "or", "none", "with_size", "regex", "at", "contain", "equal"]}, "conditions": {"type": "array", "items": {"$ref": "#/$defs/condition"}}, "condition": {"$ref": "#/$defs/condition"}, "size": {"type": "integer"}, "strict": {"type": "boolean"}, "position": {"type": "integer"}, "regex": {"type": "string"}, "content": {"type": "string"}}}
    items = {
        "command": {"type": "object", "required": ["command", "selector"], "properties": {"command": {"type": "string"}, "pre": {"$ref": "#/$defs/condition"}, "post": {"$ref": "#/$defs/condition"}, "selector": {"type": "object", "required": ["type"], "properties": {"type": {"enum": ["greedy", "non_greedy"]}, "position": {"type": "integer"}, "indexes": {"type": "object"}}}}},
        "data_pointer": {"type": "object", "required": ["type"], "properties": {"type": {"enum": ["equal", "right", "regex"]}, "value": {"type": "string"}, "right": {"type": "string"}, "regex": {"type": "string"}, "negative": {"type": "boolean"}, "kind": {"type": "object"}}},
        "command_regex": {"type": "object", "required": ["regex", "groups"], "properties": {"regex": {"type": "string"}, "groups": {"type": "object"}}},
    }[what]
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "array", "items": items, "$defs": {"condition": condition}}, indent=2)
