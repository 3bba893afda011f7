import gzip

import pytest

from glyphmill.functions.udfs import escape_special, unescape_special
from glyphmill.operators import translation
from glyphmill.parse import anvil, backfill, commands, component, extract, nbt, njson, pointer, rules, snbt
from glyphmill.parse.tree import Array, Num, plain
from glyphmill.plans import catalog
from glyphmill.plans.patterns import CommandPattern, Condition, PointerPattern, RegexPattern, first_match, json_schema

BUILTIN = catalog.builtin()
TEXT = """tellraw @p [{"selector":"@s"},{"text":"door"}]

# a comment with say "nothing"
tellraw @p {"text":"gate","extra":[{"text":"key"}]}
custom "stone brick" c{hard:3b, light:0s}

tell @p "\\"Quote\\": {\\"text\\": \\"in it\\"} 🜂"

\\\\ not a command

say all that follows

execute at @a run say three words 7

$say $(who) and others"""


def hits(text):
    return [(s.content, s.format, s.syntax) for s in extract.command_texts(text, BUILTIN)]


def test_command_lines():
    found = commands.parse_commands(TEXT)
    assert [c.name for c in found] == ["tellraw", "tellraw", "custom", "tell", "say", "execute", "say"]
    assert found[-1].macro and not found[0].macro
    assert [a.content for a in found[2].args] == ['"stone brick"', "c{hard:3b, light:0s}"]
    assert [c.name for c in commands.parse_commands("say a\r\nsay b\rsay c\n\tsay d\n")] == ["say"] * 3
    assert commands.parse_line("c a  b").args[1].content == ""
    assert commands.parse_line("c {[}]") is None and commands.parse_line("c {a").args[0].content == "{a"


def test_backfill_of_all_spans():
    spans = [(s.start, s.end, "{X}", None) for s in extract.command_texts(TEXT, BUILTIN)]
    assert backfill.spans_file(TEXT, spans).split("\n") == [
        "tellraw @p {X}", "", '# a comment with say "nothing"', "tellraw @p {X}", 'custom "stone brick" c{hard:3b, light:0s}', "", "tell @p {X}", "", "\\\\ not a command", "",
        "say {X}", "", "execute at @a run say {X}", "", "$say {X}",
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("say Hello world everyone", [("Hello world everyone", "plain_str", None)]),
        ('tellraw @a {"text":"Hello","color":"red"}', [('{"text":"Hello","color":"red"}', "json_str", None)]),
        ('bossbar add test:bar {text:"Boss Bar"}', [('{text:"Boss Bar"}', "snbt_str", None)]),
        ("title @a times 1 2 3", []),
        ("title @a title Foobar", [("Foobar", "plain_str", None)]),
        ('give @p stick{display:{Name:"text"}}', [('"text"', "snbt_str", "DoubleQuoteString")]),
        ("give @p stick[!lore,item_name='x',damage=1]", [("'x'", "snbt_str", "SingleQuoteString")]),
        ("give @p stick", []),
        ("give @p stick 3", []),
        ('item modify entity @p weapon.mainhand {function:"minecraft:set_name",name:"Modifier name"}', [('"Modifier name"', "snbt_str", "DoubleQuoteString")]),
        ("item modify entity @p weapon.mainhand my:modifier", []),
        ("execute as @p run execute at @e run say deep hello", [("deep hello", "plain_str", None)]),
        ("kill @p[name=foo:bar]", [("foo:bar", "plain_str", "LiteralString")]),
        ('kill @p[name="hello"]', [('"hello"', "plain_str", "DoubleQuoteString")]),
        ("kill @p[name=!foo]", [("foo", "plain_str", "LiteralString")]),
        ("say @p[name=foo]", [("@p[name=foo]", "plain_str", None)]),
        ("tell @a", []),
        ("minecraft:say x", []),
        ('data merge entity @s {CustomName:"n",Health:1f}', [('"n"', "snbt_str", "DoubleQuoteString")]),
        ("scoreboard objectives add a dummy Title", [("Title", "plain_str", None)]),
        ('team modify t prefix {"text":"P"}', [('{"text":"P"}', "json_str", None)]),
    ],
)
def test_command_catalog(text, expected):
    assert hits(text) == expected


def test_selectors_requote_and_wide_characters():
    text = "title @e[name='Foo'] title Foobar"
    name = extract.command_texts(text, BUILTIN)[0]
    assert backfill.spans_file(text, [(name.start, name.end, "Bar", name.syntax)]) == 'title @e[name="Bar"] title Foobar'
    text = "say 🫧\nsay b"
    spans = extract.command_texts(text, BUILTIN)
    assert [(s.start, s.end) for s in spans] == [(4, 6), (11, 12)]
    assert backfill.spans_file(text, [(s.start, s.end, "z", None) for s in spans]) == "say z\nsay z"
    with pytest.raises(commands.OverlapError, match="cannot overlap"):
        commands.splice("0123456789", [(4, 7, "a"), (5, 8, "b")])


def test_regex_patterns_come_after():
    own = BUILTIN.with_custom(regexes=[RegexPattern.from_json({"regex": r'\{area:\s*(".*?")}', "groups": {"1": {"syntax": "DoubleQuoteString"}}})])
    assert [s.content for s in extract.command_texts('say {area: "x"}', own)] == ['{area: "x"}', '"x"']


def test_pattern_json():
    raw = {"command": "data", "pre": {"type": "with_size", "size": 2, "strict": True}, "selector": {"type": "non_greedy", "indexes": {"2": {"type": "snbt_entire"}}}, "post": {"type": "at", "position": 1, "condition": {"type": "regex", "regex": "a|b"}}}
    p = CommandPattern.from_json(raw)
    assert p.to_json() == raw
    own = BUILTIN.with_custom(command=[p])
    assert [s.content for s in extract.command_texts("data xa {odd:t,CustomName:n}", own)] == ["n"]
    assert extract.command_texts("data xc {CustomName:n}", own) == []
    assert PointerPattern.from_json({"type": "right", "right": ">#x", "negative": True}).matches(">#y")
    assert all('"$defs"' in json_schema(x) for x in ("command", "data_pointer", "command_regex"))
    assert not Condition("none", (Condition("any"),)).holds(commands.parse_line("c x"))


def test_pointers():
    p = ("a", 0, "b", "op>=&a&")
    assert pointer.encode(p) == ">#a>0>#b>#op&>=&a&"
    assert pointer.decode(">#a>0>#b>#op&>=&a&") == pointer.decode(">>>>>>>>#a>0>>>>#b>>>>>>#op&>=&a&") == p
    assert pointer.decode("") == ()
    for bad in ("#a", ">#a>", ">x"):
        with pytest.raises(ValueError):
            pointer.decode(bad)
    assert pointer.access({"a": ["x"]}, ("a", 0)) == "x"
    for bad, error in ((("b",), KeyError), (("a", 1), IndexError), (("a",), TypeError)):
        with pytest.raises(error):
            pointer.access({"a": ["x"]}, bad)


@pytest.mark.parametrize("where", [">#>#block_entities>5>#front_text>#messages>0>#raw", ">#Items>0>#components>#minecraft:custom_name", ">#Items>0>#components>#lore>3>#raw", ">#display>#Name", ">#Command", ">#TileEntities>0>#Text1"])
def test_nbt_catalog_matches(where):
    assert first_match(catalog.NBT, where)


def test_catalogs_do_not_match_others():
    assert first_match(catalog.NBT, ">#unrelated>#path>#here") is None
    assert first_match(catalog.MCJSON, ">#functions>0>#modifiers>0>#name")
    assert first_match(catalog.MCJSON, ">#title>#color") is None
    assert first_match(None, ">#anything")
    assert first_match(catalog.NBT, ">#x>#Command").kind.type == "command"


def test_snbt_spans_and_numbers():
    node = snbt.parse("[I; 1, 2, 3]")
    assert (node.start, node.end, [n.start for n in node.value]) == (0, 12, [4, 7, 10])
    for bad in ("[I; 1.0, 10.0]", "[X; 1, 2, 3]", "{1:2}", "{a:1", "300b", "1xy", ""):
        with pytest.raises(snbt.SnbtError):
            snbt.parse(bad)
    assert (snbt.parse("114514").kind, snbt.parse("11451419198100000").kind) == ("int", "long")
    assert plain(snbt.to_tree(snbt.parse("{a:[1,2,],'b c':\"x\\\"\\ny\",c:'it\\'s',d:true,e:.5f,}"))) == {"a": [1, 2], "b c": 'x"\ny', "c": "it\\'s", "d": True, "e": 0.5}
    text = '{a:1b,b:[L;1l,2l],"c d":["x"],e:{f:-3s}}'
    assert snbt.write(snbt.to_tree(snbt.parse(text))) == text


@pytest.mark.parametrize(
    ("flags", "text", "parses"),
    [
        ({"single_quote": True}, "'hi'", True), ({}, "'hi'", False), ({"single_quote": True}, "'a \"b\" c'", True),
        ({"illegal_escape": True}, '"it\\\'s"', True), ({}, '"it\\\'s"', False), ({"trailing_comma": True}, "[1,]", True), ({}, "[1,]", False),
        ({"comments": True}, "/* a */ [1] // b", True), ({}, "[1] // b", False), ({"lenient": True}, "{a: b}", True), ({}, "{a: b}", False), ({}, '{"a":1} x', False),
    ],
)
def test_json_dialects(flags, text, parses):
    try:
        njson.parse(text, njson.Dialect(**flags))
        assert parses
    except njson.JsonError:
        assert not parses


def test_json_keeps_order_and_numbers():
    text = '{"b":1.50,"a":[null,true,-7,"é\\n"],"":{}}'
    assert njson.write(njson.parse(text)) == text


LOOT = r'''{"pools":[{"rolls":1,"entries":[{"type":"minecraft:item","functions":[{"function":"minecraft:set_nbt","tag":"{display:{Name:'{\"text\":\"Wayfinder\",\"italic\":false}',Lore:['{\"text\":\"Wayfinder\"}','{\"text\":\"Old\"}']},HideFlags:1,Enchantments:[{id:\"minecraft:unbreaking\",lvl:1s}]}"}]}]}]}'''


def test_structure_inside_json():
    (found,) = extract.json_texts(LOOT, BUILTIN)
    assert (found.pointer, found.kind) == (">#pools>0>#entries>0>#functions>0>#tag", "structure")
    assert [(f.pointer, f.format) for f in found.inner] == [(">#display>#Name", "snbt_str"), (">#display>#Lore", "nbt_obj")]
    assert found.inner[1].content == r'["{\"text\":\"Wayfinder\"}","{\"text\":\"Old\"}"]'
    new = backfill.replace_found(found, lambda text: text.replace("Wayfinder", "Seeker"))
    out = njson.write(backfill.fill(njson.parse(LOOT), [(found.pointer, "snbt_str", new)], "json_obj"))
    assert r'''{display:{Name:\"{\\\"text\\\":\\\"Seeker\\\",\\\"italic\\\":false}\",Lore:[\"{\\\"text\\\":\\\"Seeker\\\"}\",\"{\\\"text\\\":\\\"Old\\\"}\"]},HideFlags:1,Enchantments:[{id:\"minecraft:unbreaking\",lvl:1s}]}''' in out


def test_command_inside_nbt():
    (found,) = extract.nbt_texts({"": {"tag": {"Command": "say Hello"}}}, BUILTIN)
    assert (found.pointer, found.slices[0].content) == (">#>#tag>#Command", "Hello")
    assert backfill.replace_found(found, {}.get) == "say Hello" and backfill.replace_found(found, {"Hello": "Hi"}.get) == "say Hi"


def test_tree_backfill():
    tree = {"l": ["a", {"text": "b"}], "o": {"text": "x"}, "n": Num("int", 1)}
    out = backfill.fill(tree, [(">#l>1>#text", "snbt_str", "B"), (">#o", "nbt_obj", "{text:y}"), (">#l>9", "snbt_str", "?"), (">#z", "snbt_str", "?")], "nbt_obj")
    assert out == {"l": [{"text": "a"}, {"text": "B"}], "o": {"text": "y"}, "n": Num("int", 1)}
    with pytest.raises(backfill.NotText):
        backfill.fill({"l": [Num("int", 1), {"text": "b"}]}, [(">#l>1>#text", "snbt_str", "B")], "nbt_obj")
    assert backfill.fill({"a": "x"}, [(">#a", "snbt_str", "1"), (">#a", "plain_str", "2")], "nbt_obj") == {"a": "1"}


def test_components():
    assert component.is_component({}) and component.is_component([]) and component.is_component({"": "x", "odd": 1})
    assert not component.is_component({"text": {"text": "x"}}) and not component.is_component([Num("int", 1)])
    assert [component.is_translate_key(x) for x in ("effect.minecraft.levitation", "abc", "Okey.", ".obj")] == [True, False, False, False]
    assert component.simplify({"text": "a", "extra": [{"text": "b"}, {"text": "c", "color": "red"}]}) == ["a", "b", {"text": "c", "color": "red"}]
    assert component.replace_text({"translate": "a.b", "future_field": 1}, "x") == {"translate": "a.b", "future_field": 1, "fallback": "x"}
    assert component.strip('[{"color":"gray","text":"Key recipes"}]', "json_str") == ("simplified", "Key recipes", True)
    assert component.strip('{"translate": "abc.efg.ghi", "color": "red"}', "json_str")[0] == "untranslatable"
    assert component.strip('{"no": "a component"}', "json_str")[0] == "no_component"
    assert component.destrip('[{"color":"gray","text":"Key"}]', "json_str", "Clé") == '[{"color":"gray","text":"Clé"}]'


def test_nbt_and_regions():
    tree = {"a": Num("byte", -1), "b": [Num("long", 1 << 40)], "c": Array("int", [1, 2]), "d": "é😀\0", "e": {}, "f": [], "g": Num("double", 0.5)}
    assert nbt.read(nbt.write(tree, "root")) == ("root", tree)
    raw = gzip.decompress(nbt.write_gzip(tree))
    for cut in range(len(raw)):
        with pytest.raises(nbt.NbtError):
            nbt.read(raw[:cut])
    chunks = [anvil.Chunk(i, kind, b"", 5).replaced({"i": Num("int", i)}) for i, kind in ((0, 1), (7, 2), (1023, 3))]
    file = anvil.write(chunks)
    assert anvil.read(file) == chunks and len(file) == 5 * anvil.SECTOR
    assert [c.time for c in anvil.read(anvil.write(chunks, 9))] == [9, 9, 9]
    broken = bytearray(file)
    broken[3 * 4096 + 4] = 4  # an unknown compression
    kept = anvil.read(bytes(broken))
    assert [(c.index, c.kind) for c in kept] == [(0, 1), (7, 4), (1023, 3)] and anvil.write(kept) == bytes(broken)
    with pytest.raises(anvil.RegionError):
        kept[1].tree()
    with pytest.raises(anvil.RegionError):
        anvil.read(b"x" * 100)


def test_rules():
    book = rules.RuleBook.read("---mtl---\n# names\n|Shimamura| ==> |岛村|\n[\n|a|\n(|b|\n|c|)\n] ==> [|A|\n(|B|\n|C|)]\n---raw---\n|Adachi| ==> |安达|\n")
    assert book.raw == {"Adachi": "安达"} and len(book.rules) == 2 and all(rules.consistent(*r) for r in book.rules)
    assert rules.translate("Shimamura", "岛村") == '"岛村"'
    assert rules.RuleBook.read(book.write()).rules == book.rules
    assert rules.key('{"text":"a|b"}') == "|a&|b|" and rules.key('{"translate":"x"}') is None
    assert rules.template(['{"text":"Hello"}', '{"translate":"item.name"}', "Raw line", '{"text":"World"}']).write().split("\n")[:3] == ["---mtl---", "|Hello| ==> |TODO|", "|World| ==> |TODO|"]
    for bad in ("|a ==> |b|", "---raw---\n---mtl---"):
        with pytest.raises(rules.RuleError):
            rules.RuleBook.read(bad) if "---" in bad else rules.parse(bad)


def test_model_protocol():
    response = f'{translation.TRANSLATED}\n[0] a\n[1] b\n[2] c\n{translation.TERMS}\n{{"Iroha": "彩叶"}}\n{translation.END}'
    assert translation.parse_response(response, 3) == (["a", "b", "c"], {"Iroha": "彩叶"})
    with pytest.raises(translation.ResponseError):
        translation.parse_response(response, 2)
    calls = []

    def model(text):
        calls.append(text)
        body = text.split(translation.START + "\n")[1].split("\n")
        if len(calls) == 1:
            return "nonsense"
        return translation.TRANSLATED + "\n" + "\n".join(x.upper() for x in body) + f"\n{translation.TERMS}\n{{}}\n{translation.END}"

    rows, _ = translation.translate_chunk(['{"text":"hi","color":"red"}', '{"translate":"a.b"}', '{"text":"two\\nlines"}'], "json_str", {"Hi": "X", "no": "Y"}, model)
    assert rows[0] == ('{"text":"hi","color":"red"}', '{"text":"HI","color":"red"}', "translated") and rows[1][1:] == (None, "untranslatable")
    assert len(calls) == 2 and calls[0].startswith("Hi => X\n" + translation.START)
    chunks = [("plain_str", ["a"]), ("plain_str", ["b"])]
    learnt = iter([{"a": "1"}, {}])
    seen = []

    def teaching(text):
        seen.append(text)
        import json

        return f"{translation.TRANSLATED}\n[0] ok\n{translation.TERMS}\n{json.dumps(next(learnt))}\n{translation.END}"

    assert [t for _, t in translation.translate_in_turn(chunks, teaching, {})] == [{"a": "1"}, {"a": "1"}]


def test_special_characters():
    text = "a\tb\nc​\ue001﻿"
    assert escape_special(text) == "a$UNICODE_0009$b\nc$UNICODE_200B$$UNICODE_E001$$UNICODE_FEFF$"
    assert unescape_special(escape_special(text)) == text
