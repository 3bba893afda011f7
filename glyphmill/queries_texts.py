"""Queries over texts: components, catalogs, rules, column functions and the rest of the translation loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as fx
from glyphmill.functions.udfs import exploded, scalar
from glyphmill.operators import batches, extraction, translation
from glyphmill.parse import backfill, component, extract, njson, regex, rules, textmodel
from glyphmill.plans import catalog
from glyphmill.plans.patterns import CommandPattern, Condition, RegexPattern, first_match
from glyphmill.queries import _spans, _t, query


def _case(cases: list[str], by: str = "p_partkey") -> str:
    return f"CASE {by} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spark(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- components -------------------------------------------------------------------------------------

_SHAPES = [
    ("""{"text":"'||p_name||'"}""", True, True, True),
    ("""["'||p_name||'",{"text":"x"}]""", True, True, True),
    ("""["'||p_name||'",{"odd":1}]""", False, None, None),
    ("""{"":"'||p_name||'"}""", True, True, True),
    ("""{"":1}""", False, None, None),
    ("""[]""", True, False, False),
    ("""{"translate":"a.b.c"}""", True, True, False),
    ("""{"translate":"a.b.c","fallback":"'||p_name||'"}""", True, True, True),
    ("""{"keybind":"key.jump"}""", True, False, False),
    ("""{"keybind":"key.jump","extra":["'||p_name||'"]}""", True, True, True),
    ("""{"selector":"@a","separator":{"text":", "}}""", True, True, False),
    ("""{"text":"12 - 3"}""", True, True, False),
    ("""{"text":"","extra":[{"text":"'||p_name||'"}]}""", True, True, True),
    ("""["'||p_name||'",3]""", False, None, None),
]


def _shape(i: int, quote) -> str:
    return "||".join(x if j % 2 else quote(x) for j, x in enumerate(_SHAPES[i][0].replace("'||p_name||'", "\0p_name\0").split("\0")))


def _flag(x: bool | None) -> str:
    return "CAST(NULL AS BOOLEAN)" if x is None else str(x).upper()


@query("SELECT p_partkey, " + ", ".join(_case([_flag(s[k]) for s in _SHAPES]) + f" AS {n}" for k, n in ((1, "is_component"), (2, "has_text"), (3, "readable"))) + " FROM part")
def component_shapes(spark, sf):
    """Lists, shorthands and each kind of content: whether they are components, have text, and show letters."""
    rows = _t(spark, sf, "part").selectExpr("p_partkey", _case([_shape(i, _spark) for i in range(len(_SHAPES))]) + " AS t")

    def run(text: str):
        tree = component.read_json(text)
        if not component.is_component(tree):
            yield {"is_component": False, "has_text": None, "readable": None}
            return
        own = textmodel.read(tree)
        yield {"is_component": True, "has_text": textmodel.has_text(own), "readable": textmodel.has_readable(own)}

    return exploded(rows, run, "is_component boolean, has_text boolean, readable boolean", "t").drop("t")


_KINDS = [
    ("text", '"text":"a"', '"text":"{}"'),
    ("translate", '"translate":"a","fallback":"b"', '"translate":"{}","fallback":"b"'),
    ("keybind", '"keybind":"a"', '"keybind":"{}"'),
    ("score", '"score":{"name":"a","f":7}', '"score":{"name":"{}","f":7}'),
    ("selector", '"selector":"a"', '"selector":"{}"'),
    ("nbt", '"nbt":"a","entity":"@s"', '"nbt":"{}","entity":"@s","interpret":false'),
    ("object", '"object":"a"', '"object":"{}"'),
    ("sprite", '"sprite":"a"', '"sprite":"{}"'),
]


def _edited(i: int) -> str:
    left, right = _KINDS[i][2].split("{}")
    base, more = (right[:-18], right[-18:]) if right.endswith(',"interpret":false') else (right, "")
    return f"concat({_sql('{' + left)}, p_name, {_sql(base + ',\"future\":42,\"bold\":true' + more + '}')})"


@query(f"SELECT p_partkey, {_case([_sql(k[0]) for k in _KINDS])} AS kind, {_case([_edited(i) for i in range(len(_KINDS))])} AS edited FROM part")
def component_edit(spark, sf):
    """Each kind read, its content edited, and written: unknown fields stay, flags become booleans."""
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "p_name", _case([_spark("{" + k[1] + ',"future":42,"bold":true}') for k in _KINDS]) + " AS t")

    def run(name: str, text: str):
        own = textmodel.read(njson.parse(text))
        first = textmodel.OWN[own.kind][0]
        own.own[first] = {**own.own[first], "name": name} if own.kind == "score" else name
        yield {"kind": own.kind, "edited": njson.write(own.tree())}

    return exploded(rows, run, "kind string, edited string", "p_name", "t").select("p_partkey", "kind", "edited")


@query("SELECT p_partkey, concat('{\"text\":\"', p_name, '\",\"extra\":[\"', p_type, '\"]}') AS plus, concat('{\"translate\":\"a.b\",\"fallback\":\"', p_name, '\",\"extra\":\"', p_type, '\"}') AS substituted, CAST(3 AS INT) AS parts, concat('{\"text\":\"', p_name, '\",\"color\":\"red\",\"click\":1}') AS styled, FALSE AS plain, 'click' AS unmanaged FROM part")
def component_operations(spark, sf):
    """Joining, substituting, flattening, and setting and removing style."""

    def run(name: str, kind: str):
        plus = textmodel.joined(textmodel.read(name), [textmodel.read(kind)])
        new = textmodel.substituted(textmodel.read({"translate": "a.b"}), name, textmodel.read(kind))
        many = textmodel.joined(textmodel.read(["x", "y"]), [textmodel.read(kind)])
        styled = textmodel.read({"text": "x", "bold": True, "click": 1})
        styled = textmodel.with_text(styled, name)
        styled.style |= {"color": "red", "bold": None}
        tree = styled.tree()
        yield {"plus": njson.write(plus.tree()), "substituted": njson.write(new.tree()), "parts": len(textmodel.flattened(many)), "styled": njson.write({k: tree[k] for k in ("text", "color", "click") if k in tree}), "plain": styled.plain_style(), "unmanaged": ",".join(styled.unmanaged())}

    return exploded(_t(spark, sf, "part").select("p_partkey", "p_name", "p_type"), run, "plus string, substituted string, parts int, styled string, plain boolean, unmanaged string", "p_name", "p_type").drop("p_name", "p_type")


_FORMATS = [
    ("""{text:"'||p_name||'"}""", "snbt_str", True, False),
    ("""{"text":"'||p_name||'"}""", "snbt_str", True, True),
    ("""{"text":"'||p_name||'","color":1e5}""", "json_str", False, True),
    ("""'||p_name||'""", "plain_str", False, False),
    ("""{odd:1}""", "plain_str", True, False),
    ("""{"odd":1,"n":null}""", "plain_str", True, True),
    (""""'||p_name||'\"""".replace("\\", ""), "snbt_str", True, True),
    ("""{text:""", "plain_str", False, False),
    ("""[3b]""", "plain_str", True, False),
]


def _format(i: int, quote) -> str:
    return "||".join(x if j % 2 else quote(x) for j, x in enumerate(_FORMATS[i][0].replace("'||p_name||'", "\0p_name\0").split("\0")))


@query("SELECT p_partkey, " + _case([_sql(f[1]) for f in _FORMATS]) + " AS format, " + _case([str(f[2]).upper() for f in _FORMATS]) + " AS is_snbt, " + _case([str(f[3]).upper() for f in _FORMATS]) + " AS is_json FROM part")
def infer_format(spark, sf):
    """SNBT before JSON before plain text, and only components count; whether a text parses at all as either."""
    rows = _t(spark, sf, "part").selectExpr("p_partkey", _case([_format(i, _spark) for i in range(len(_FORMATS))]) + " AS t")
    return rows.select("p_partkey", scalar(component.infer_format, "string", "t").alias("format"), scalar(component.is_snbt, "boolean", "t").alias("is_snbt"), scalar(component.is_json, "boolean", "t").alias("is_json"))


# --- catalogs ---------------------------------------------------------------------------------------

_J, _S = ('{"text":"', '"}'), ('"', '"')
#: (before, opening, closing, after, syntax, format): a command with a text that the catalog finds; no format: it finds none.
_COMMANDS = [
    ("me ", "", "", "", None, "plain_str"), ("teammsg ", "", "", "", None, "plain_str"), ("tell @a ", *_S, "", None, "plain_str"), ("msg @a ", *_S, "", None, "plain_str"),
    ("w @a ", *_S, "", None, "plain_str"), ("kick @a ", *_S, "", None, "plain_str"), ("title @a subtitle ", *_J, "", None, "json_str"), ("title @a times ", "", "", "", None, None),
    ("dialog show @a {title:", *_S, "}", "DoubleQuoteString", "snbt_str"), ("dialog clear @a {title:", *_S, "}", None, None), ("bossbar add a:b ", *_J, "", None, "json_str"),
    ("bossbar set a:b name ", *_J, "", None, "json_str"), ("bossbar set a:b color ", *_J, "", None, None), ("scoreboard objectives add a dummy ", *_J, "", None, "json_str"),
    ("scoreboard objectives modify a displayname ", *_J, "", None, "json_str"), ("scoreboard objectives modify a numberformat fixed ", *_J, "", None, "json_str"),
    ("scoreboard players display name @s a ", *_J, "", None, "json_str"), ("scoreboard players display numberformat @s a fixed ", *_J, "", None, "json_str"),
    ("team modify t prefix ", *_J, "", None, "json_str"), ("team modify t suffix ", *_J, "", None, "json_str"), ("team modify t displayName ", *_J, "", None, "json_str"), ("team modify t color ", *_J, "", None, None),
    ("team add t ", *_J, "", None, "json_str"), ("data modify entity @s CustomName set value ", *_J, "", None, "json_str"), ("data modify block 1 2 3 CustomName set value ", *_J, "", None, "json_str"),
    ("data merge storage a:b {x:{text:[1,2],odd:1},name:", *_S, "}", "DoubleQuoteString", "snbt_str"), ("data merge block 1 2 3 {odd:0,CustomName:", *_S, "}", "DoubleQuoteString", "snbt_str"),
    ("give @s stick[minecraft:custom_name=", "'", "'", "]", "SingleQuoteString", "snbt_str"), ("give @s stick[damage=3,odd=", "'", "'", "]", None, None),
    ("item modify entity @s weapon {function:x,name:", *_S, "}", "DoubleQuoteString", "snbt_str"), ("item modify block 1 2 3 c {function:x,name:", *_S, "}", "DoubleQuoteString", "snbt_str"),
    ("item replace entity @s weapon with stick[item_name=", "'", "'", "]", "SingleQuoteString", "snbt_str"), ("item replace block 1 2 3 c with stick[item_name=", "'", "'", "]", "SingleQuoteString", "snbt_str"),
    ("item replace entity @s weapon from entity @p weapon {function:x,name:", *_S, "}", "DoubleQuoteString", "snbt_str"),
    ("item replace entity @s weapon from block 1 2 3 c {function:x,name:", *_S, "}", "DoubleQuoteString", "snbt_str"),
    ("item replace block 1 2 3 c from block 4 5 6 c {function:x,name:", *_S, "}", "DoubleQuoteString", "snbt_str"),
    ("replaceitem entity @s slot stick 1 0 0 ", *_J, "", None, "json_str"), ("replaceitem block 1 2 3 slot stick 1 0 0 ", *_J, "", None, "json_str"), ("replaceitem entity @s slot stick 1 0 0 ", "", "", "", None, None),
    ("setblock 1 2 3 chest {odd:0,CustomName:", *_S, "}", "DoubleQuoteString", "snbt_str"), ("summon zombie 1 2 3 {odd:0,CustomName:", *_S, "}", "DoubleQuoteString", "snbt_str"),
    ("summon zombie 1 2 3 {odd:", *_S, "}", None, None), ("execute as @a at @s run teammsg ", "", "", "", None, "plain_str"), ("return run say ", "", "", "", None, "plain_str"), ("unknown @a ", *_J, "", None, None),
]


def _command_rows() -> str:
    rows = [(i, *c) for i, c in enumerate(_COMMANDS) if c[5]]
    values = ", ".join(f"({i}, {len(before)}, {_sql(left)}, {_sql(right)}, {_sql(syntax) if syntax else 'NULL'}, {_sql(fmt)})" for i, before, left, right, _, syntax, fmt in rows)
    return f"""SELECT p_partkey, CAST(pos AS INT) AS "start", CAST(pos + length(concat(l, p_name, r)) - 1 AS INT) AS "end", concat(l, p_name, r) AS content, syntax, format
    FROM part JOIN (VALUES {values}) v(i, pos, l, r, syntax, format) ON p_partkey % {len(_COMMANDS)} = i"""


@query(_command_rows())
def command_catalog(spark, sf):
    """Every kind of command that the catalog reads, and neighbours that it doesn't."""
    line = _case([f"concat({_spark(before + left)}, p_name, {_spark(right + after)})" for before, left, right, after, _, _ in _COMMANDS])
    return _spans(spark, sf, line, "p_partkey")


#: Pointers with {} for a number, and which of the catalogs (n: NBT, j: JSON, d: command data) match them.
_POINTERS = [
    (">#Items>{}>#components>#minecraft:custom_name", "njd"), (">#components>#lore>{}>#raw", "njd"), (">#components>#lore>{}>#other", ""), (">#components>#written_book_content>#pages>{}>#filtered", "njd"),
    (">#components>#writable_book_content>#pages>{}", "j"), (">#block_entities>{}>#Command", "nd"), (">#Entities>{}>#CustomName", "njd"), (">#display>#Name", "njd"), (">#SkullOwner>#Name", "nd"),
    (">#x>{}>#instrument>#description", "njd"), (">#attribute_modifiers>#modifiers>{}>#display>#value", "nd"), (">#Entities>{}>#text", "nd"), (">#Entities>{}>#raw_text", "nd"), (">#Book>#tag>#pages", "njd"),
    (">#TileEntities>{}>#Text1", "nd"), (">#TileEntities>{}>#TextA", ""), (">#tag>#author", "njd"), (">#block_entities>{}>#front_text>#filtered_messages>2>#raw", "nd"), (">#block_entities>{}>#LastOutput", "nd"),
    (">#data>#banners>#name", "nd"), (">#display>#title", "j"), (">#title", "jd"), (">#pages>{}>#x", "j"), (">#actions>{}>#label", "jd"), (">#functions>{}>#name", "j"), (">#functions>{}>#entity>#name", "j"),
    (">#functions>{}>#modifiers>{}>#name", "j"), (">#name", "d"), (">#x>#name", ""), (">#text", "d"), (">#body>{}>#contents", "d"), (">#dialogs>{}>#external_title", "jd"), (">#inputs>{}>#label", "d"),
    (">#body>{}>#description", "jd"), (">#Pos>{}", ""), (">#functions>{}>#tag", "j"), (">#back_text>#messages", "j"), (">#x>#external_title", "j"),
]


@query("SELECT p_partkey, " + ", ".join(f"{_case([str(k in p[1]).upper() for p in _POINTERS])} AS {n}" for k, n in (("n", "nbt"), ("j", "mcjson"), ("d", "command_data"))) + " FROM part")
def pointer_catalogs(spark, sf):
    """Which of the three pointer catalogs hold a pointer."""
    made = _case([f"replace({_spark(p[0])}, '{{}}', CAST(p_size AS STRING))" for p in _POINTERS])
    rows = _t(spark, sf, "part").selectExpr("p_partkey", f"{made} AS p")
    return rows.select("p_partkey", *(scalar(lambda p, c=c: first_match(c, p) is not None, "boolean", "p").alias(n) for c, n in ((catalog.NBT, "nbt"), (catalog.MCJSON, "mcjson"), (catalog.DATA, "command_data"))))


@query("SELECT p_partkey, CAST(4 AS INT) AS \"start\", CAST(12 + length(p_type) + length(p_name) AS INT) AS \"end\", concat('@p[name=', p_type, ']') || p_name AS content FROM part")
def selector_inside_text(spark, sf):
    """A selector's name that lies in a text which is found anyway isn't found twice."""
    return _spans(spark, sf, "concat('say @p[name=', p_type, ']', p_name)", "p_partkey").select("p_partkey", "start", "end", "content")


@query("SELECT l_orderkey, l_linenumber, greatest(l_linenumber, CAST(l_quantity AS INT)) <= least(l_linenumber + 3, CAST(l_quantity AS INT) + 2) AS overlap FROM lineitem")
def range_overlap(spark, sf):
    q = F.col("l_quantity").cast("int")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fx.ranges_overlap(F.col("l_linenumber"), F.col("l_linenumber") + 3, q, q + 2).alias("overlap"))


# --- rules ------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('{"text":"', p_brand, '","color":"red"}') WHEN 1 THEN concat('["', p_brand, '",{"text":"', p_type, '"}]') ELSE concat('{"text":"', p_brand, '","extra":["', p_type, '"]}') END AS target,
p_partkey % 3 <> 1 AS consistent FROM part""")
def rule_apply(spark, sf):
    """A rule's right side put into a component of its shape: literals, lists, and pairs; and whether two shapes are alike."""
    rows = _t(spark, sf, "part").selectExpr(
        "p_partkey", """CASE p_partkey % 3 WHEN 0 THEN concat('{"text":"', p_name, '","color":"red"}') WHEN 1 THEN concat('["', p_name, '",{"text":"x"}]') ELSE concat('{"text":"', p_name, '","extra":["x"]}') END AS t""",
        "CASE p_partkey % 3 WHEN 0 THEN concat('|', p_brand, '|') WHEN 1 THEN concat('[|', p_brand, '|\n|', p_type, '|]') ELSE concat('(|', p_brand, '|\n[|', p_type, '|])') END AS r",
        "CASE p_partkey % 3 WHEN 0 THEN '|a|' WHEN 1 THEN '[|a|]' ELSE '(|a|\n[|b|])' END AS other",
    )

    def run(text: str, rule: str, other: str):
        ((left, right),) = rules.parse(f"{rule} ==> {other}")
        yield {"target": rules.translate(text, left), "consistent": rules.consistent(left, right)}

    return exploded(rows, run, "target string, consistent boolean", "t", "r", "other").select("p_partkey", "target", "consistent")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('---mtl---', chr(10), '[|', p_name, '|', chr(10), '|', p_type, '|] ==> [|TODO|', chr(10), '|TODO|]', chr(10), '---raw---', chr(10))
ELSE concat('---mtl---', chr(10), '---raw---', chr(10), '|', p_name, '\\n{| ==> |TODO|', chr(10)) END AS book FROM part""")
def rule_template(spark, sf):
    """The rule book to fill in of a component, or of a text that isn't one, as it's written and read again."""
    rows = _t(spark, sf, "part").selectExpr("p_partkey", """CASE WHEN p_partkey % 2 = 0 THEN concat('["', p_name, '",{"text":"', p_type, '"}]') ELSE concat(p_name, '\n{') END AS t""")
    return rows.select("p_partkey", scalar(lambda t: rules.RuleBook.read(rules.template([t]).write()).write(), "string", "t").alias("book"))


# --- column functions -------------------------------------------------------------------------------


@query("SELECT p_partkey, concat(p_name, '\"\\n') AS escaped, CASE WHEN p_size % 2 = 0 THEN concat('\"', p_name, '\"') ELSE p_name END AS quoted, CASE WHEN p_name LIKE '% %' THEN substring(p_name, instr(p_name, ' ') + 1) END AS after, CASE WHEN p_type LIKE 'S%' THEN substring(p_type, 2) END AS no_prefix, CASE WHEN p_type LIKE '%R' THEN left(p_type, length(p_type) - 1) END AS no_suffix, p_size % 3 = 0 AS surrounded FROM part")
def string_parts(spark, sf):
    rows = _t(spark, sf, "part").withColumn("syntax", F.when(F.col("p_size") % 2 == 0, F.lit("LiteralString")))
    wrapped = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<"), "p_name", F.lit(">"))).otherwise(F.concat(F.lit("<"), "p_name"))
    return rows.select(
        "p_partkey", fx.append_escaped(F.concat("p_name", F.lit('"\n'))).alias("escaped"), F.coalesce(fx.quoted_as(F.col("p_name"), F.col("syntax")), "p_name").alias("quoted"), fx.substring_after(F.col("p_name"), " ").alias("after"),
        fx.remove_prefix(F.col("p_type"), "S").alias("no_prefix"), fx.remove_suffix(F.col("p_type"), "R").alias("no_suffix"), fx.surrounded_by(wrapped, "<", ">").alias("surrounded"),
    )


@query("SELECT p_partkey, chr(CAST(65 + p_partkey % 50000 AS INT)) AS letter, concat('f', p_partkey) AS stem, CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat('a/', p_type) END AS path, sha1(p_name) AS digest FROM part")
def path_and_digest(spark, sf):
    """Characters of code points, file stems, normal paths (null where they lead out) and the digest that downloads are checked by."""
    path = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("a/../../"), "p_type")).otherwise(F.concat(F.lit("./a//b/../"), "p_type"))
    point = (65 + F.col("p_partkey") % 50000).cast("int")
    return _t(spark, sf, "part").select("p_partkey", fx.code_point(point).alias("letter"), fx.file_stem(F.concat(F.lit("x.y/f"), "p_partkey", F.lit(".json"))).alias("stem"), fx.normal_path(path).alias("path"), F.sha1("p_name").alias("digest"))


@query("SELECT lang, count(*) AS texts, CAST(sum(CAST(floor(length(text) / 1.5) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_usage(spark, sf):
    """Tokens of all texts of a language, as estimated for a budget."""
    return batches.usage(_t(spark, sf, "documents"), "lang")


@query("SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INT) AS parts, regexp_replace(p_name, '([a-z]+) ', '\\1-', 'g') AS replaced, CAST(strpos(p_name, ' ') - 2 AS INT) AS first_end, regexp_full_match(p_type, '[A-Z]+') AS whole FROM part")
def regex_operations(spark, sf):
    """Splitting, replacing with groups by number and name, closed ranges, and whole matches."""
    words = regex.Pattern("(?<word>[a-z]+) ")

    def run(name: str, kind: str):
        found = words.find(name)
        yield {"parts": len(regex.Pattern(" ").split(name)), "replaced": words.replace(name, "${word}-"), "first_end": found.group("word").range[1] if found else -2, "whole": regex.Pattern("[A-Z]+").matches(kind)}

    return exploded(_t(spark, sf, "part").select("p_partkey", "p_name", "p_type"), run, "parts int, replaced string, first_end int, whole boolean", "p_name", "p_type").drop("p_name", "p_type")


# --- the model --------------------------------------------------------------------------------------


@query("SELECT DISTINCT p_type AS term, concat(p_type, '!') AS meaning FROM part UNION ALL SELECT 'zz', 'given'")
def term_extraction(spark, sf):
    """Terms that a model names for chunks of texts, the later of repeated ones winning, over given ones."""

    def model(text: str) -> str:
        words = sorted({line.split(" ")[-1] for line in text.split("\n") if line})
        return njson.write({w: w + "!" for w in words} | {"": "no", "blank": " "})

    texts = _t(spark, sf, "part").selectExpr("concat(p_name, ' ', p_type) AS text").distinct()
    return translation.terms_of(texts, model, {"zz": "given"}, budget=256)


@query("SELECT DISTINCT p_name AS source, CASE WHEN length(p_name) % 5 <> 0 THEN concat(p_name, '~') END AS target FROM part")
def translate_untranslated(spark, sf):
    """Texts that a model leaves out stay out of the mapping of what is new, and are null in the results."""

    def model(message: str) -> str:
        lines = [x.partition("] ") for x in message.split(translation.START + "\n")[1].split("\n")]
        body = "\n".join(f"{a}] {t}~" for a, _, t in lines if len(t) % 5)
        return f"{translation.TRANSLATED}\n{body}\n{translation.TERMS}\n{{}}\n{translation.END}"

    texts = _t(spark, sf, "part").selectExpr("'plain_str' AS format", "p_name AS text").distinct()
    return translation.translate(texts, model, budget=64).select("source", "target")




# --- own patterns -----------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 26 ELSE 5 END AS INT) AS "start", CASE p_partkey % 4 WHEN 2 THEN concat('"', p_name, '"') WHEN 0 THEN p_type ELSE concat('"', p_name, '"') END AS content,
    CASE p_partkey % 4 WHEN 1 THEN 'DoubleQuoteString' WHEN 2 THEN 'DoubleQuoteString' END AS syntax, CASE p_partkey % 4 WHEN 1 THEN 'json_str' WHEN 2 THEN 'snbt_str' ELSE 'plain_str' END AS format FROM part
    WHERE p_partkey % 4 <> 3 OR length(p_name) % 2 = 0"""
)
def selection_kinds(spark, sf):
    """Arguments taken whole, with a given format, as block states, and under a condition in Python."""
    own = catalog.builtin().with_custom(command=[
        CommandPattern("one", select={1: "plain_entire"}), CommandPattern("two", select={1: {"type": "with_info", "format": "json_str", "syntax": "DoubleQuoteString"}}),
        CommandPattern("three", select={1: "block_state"}), CommandPattern("four", select={1: None}, post=Condition("matches", call=lambda command, arg: len(arg) % 2 == 0)),
    ])
    line = """CASE p_partkey % 4 WHEN 0 THEN concat('one ', p_type, ' x') WHEN 1 THEN concat('two "', p_name, '"') WHEN 2 THEN concat('three a:b[c=d]{CustomName:"', p_name, '"}') ELSE concat('four "', p_name, '"') END AS line"""
    rows = _t(spark, sf, "part").selectExpr("p_partkey", line)
    return extraction.command_spans(rows, "line", own).select("p_partkey", "start", "content", "syntax", "format")


@query("SELECT p_partkey, CAST(i AS INT) AS ordinal, CASE i WHEN 0 THEN concat('x ', p_type) ELSE p_type END AS content, CASE i WHEN 1 THEN 'DoubleQuoteString' END AS syntax FROM part, (VALUES (0), (1)) v(i)")
def regex_patterns(spark, sf):
    """Groups of a regular expression over the whole text come after the commands' texts."""
    own = catalog.builtin().with_custom(regexes=[RegexPattern.from_json({"regex": r"x (\w+)", "groups": {"1": {"syntax": "DoubleQuoteString"}}})])
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat('say x ', p_type) AS line")
    return extraction.command_spans(rows, "line", own).select("p_partkey", "ordinal", "content", "syntax")


@query("SELECT p_partkey, '>#display>#Name' AS pointer, p_name AS content FROM part UNION ALL SELECT p_partkey, '>#list>1', concat('{text:\"', p_type, '\"}') FROM part")
def snbt_texts(spark, sf):
    """Texts of an SNBT tree with all filters off: strings, and whole components."""

    def run(text: str):
        tree = component.read_snbt(text)
        for f in extract.tree_texts(tree, None, "nbt_obj", catalog.builtin()):
            yield {"pointer": f.pointer, "content": f.content}

    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat('{display:{Name:\"', p_name, '\"},list:[{a:1b},{text:\"', p_type, '\"}],n:', p_size, '}') AS t")
    return exploded(rows, run, "pointer string, content string", "t").drop("t")


@query("SELECT l_orderkey, l_linenumber, concat('say ', l_returnflag, 'X and ', l_linestatus) AS filled FROM lineitem")
def replaced_by_position(spark, sf):
    """The second of three spans replaced by its place in the list."""

    def run(flag: str, status: str) -> str:
        slices = [extract.Slice(4, 5, flag, None, "plain_str"), extract.Slice(5, 6, "-", None, "plain_str"), extract.Slice(11, 12, status, None, "plain_str")]
        return backfill.replaced_commands(f"say {flag}- and {status}", slices, backfill.by_ordinal({1: "X"}))

    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalar(run, "string", "l_returnflag", "l_linestatus").alias("filled"))
