"""Column functions: all of them built-in expressions, so they stay in generated code and can be pushed down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = "↠nl↠"


def escaped(c: Column) -> Column:
    """Backslash, quote, line feed, carriage return and tab as escapes."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def append_escaped(c: Column) -> Column:
    """As escaped, but double quotes stay."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    """The reverse: \\n, \\r, \\t and any other escaped character for itself. U+E000 stands in for a backslash meanwhile."""
    hold = ""
    c = F.replace(c, F.lit("\\\\"), F.lit(hold))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(F.regexp_replace(c, r"(?s)\\(.)", "$1"), F.lit(hold), F.lit("\\"))


def double_quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), escaped(c), F.lit('"'))


def single_quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))


def surrounded_by(c: Column, left: str, right: str | None = None) -> Column:
    right = left if right is None else right
    return c.startswith(left) & c.endswith(right) & (F.length(c) >= len(left) + len(right))


def double_unquoted(c: Column) -> Column:
    """Null if the quotes are missing."""
    return F.when(surrounded_by(c, '"'), unescaped(c.substr(F.lit(2), F.length(c) - 2)))


def single_unquoted(c: Column) -> Column:
    return F.when(surrounded_by(c, "'"), unescaped(c.substr(F.lit(2), F.length(c) - 2)))


def quoted_as(c: Column, syntax: Column) -> Column:
    """A replacement for a span of this syntax: string kinds get double quotes."""
    return F.when(syntax.isin("SingleQuoteString", "DoubleQuoteString", "LiteralString"), double_quoted(c)).otherwise(c)


def substring_after(c: Column, mark: str) -> Column:
    """What follows the first mark, or null without one."""
    at = F.instr(c, mark)
    return F.when(at > 0, c.substr(at + len(mark), F.length(c)))


def remove_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c)))


def remove_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), c.substr(F.lit(1), F.length(c) - len(suffix)))


def hide_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(NEWLINE))


def show_newlines(c: Column) -> Column:
    return F.replace(c, F.lit(NEWLINE), F.lit("\n"))


def readable(c: Column) -> Column:
    """Has a letter or mark."""
    return c.rlike(r"[\p{L}\p{M}]")


def not_blank(c: Column) -> Column:
    return c.rlike(r"[^\s\u0085   -     　]")


def is_translate_key(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_.]+\.+[A-Za-z0-9_.]+$")


def is_namespaced_id(c: Column) -> Column:
    return c.rlike(r"^(?:[A-Za-z0-9_\-./]+:)?[A-Za-z0-9_\-./]+$")


def has_component_field(c: Column) -> Column:
    """Has a quoted field name of a text component."""
    return c.rlike(r'"(?:text|translate|selector|score|nbt|keybind)"\s*:\s*')


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def token_estimate(c: Column) -> Column:
    """Tokens of a text: its UTF-16 length over 1.5."""
    return (utf16_length(c) / F.lit(1.5)).cast("int")


def ceil_div(a: Column, b: int) -> Column:
    return ((a + (b - 1)) / b).cast("long")


def sector_count(size: Column) -> Column:
    """4096-byte sectors for so many bytes; more than 255 is an error."""
    n = ceil_div(size, 4096)
    return F.when(n > 255, F.raise_error(F.lit("too large a chunk"))).otherwise(n)


def chunk_place(entry: Column) -> tuple[Column, Column]:
    """First sector and number of sectors of a region header's 32-bit entry."""
    return F.shiftrightunsigned(entry, 8), entry.bitwiseAND(255)


def necessary_sectors(entry: Column) -> Column:
    """Aggregate: the sectors that a region file with these header entries needs, the two of the header at least."""
    first, count = chunk_place(entry)
    return F.greatest(F.lit(2), F.max(F.when(entry != 0, first + count))).cast("long")


def pointer_key(c: Column) -> Column:
    """A map key as a step of a pointer."""
    return F.concat(F.lit(">#"), F.replace(c, F.lit(">"), F.lit("&>")))


def pointer_index(c: Column) -> Column:
    return F.concat(F.lit(">"), c.cast("string"))


def ranges_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Of closed ranges."""
    return F.greatest(s1, s2) <= F.least(e1, e2)


def normal_path(path: Column) -> Column:
    """A relative path without empty and '.' steps, each '..' taking back the step before; one that leads out is null."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("steps"), F.lit(True).alias("inside"))

    def go(state: Column, step: Column) -> Column:
        steps, inside = state["steps"], state["inside"]
        up = F.struct(F.when(F.size(steps) > 0, F.slice(steps, 1, F.size(steps) - 1)).otherwise(steps).alias("steps"), (inside & (F.size(steps) > 0)).alias("inside"))
        on = F.struct(F.concat(steps, F.array(step)).alias("steps"), inside.alias("inside"))
        return F.when(step.isin("", "."), state).when(step == "..", up).otherwise(on)

    return F.aggregate(F.split(path, "/"), start, go, lambda s: F.when(s["inside"], F.array_join(s["steps"], "/")))


def code_point(c: Column) -> Column:
    """The character of a code point; null where there is none."""
    valid = c.between(0, 0xD7FF) | c.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, c).otherwise(0).cast("long")), 8, "0")), "UTF-32"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.when(file_name(path).contains("."), F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)).otherwise(F.lit(""))
