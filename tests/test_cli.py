import json

import pytest

from glyphmill import cli
from glyphmill.parse import convert, nbt, njson
from glyphmill.parse.tree import Array, Num

from .test_world import root  # noqa: F401


def test_tools(capsys, tmp_path):
    assert cli.main(["test-command", "say hi"]) == 0 and "4..5 plain_str - hi" in capsys.readouterr().out
    cli.main(["test-pointer", ">#CustomName"])
    assert "no match" not in capsys.readouterr().out
    cli.main(["schema", "command"])
    assert json.loads(capsys.readouterr().out)["type"] == "array"
    (tmp_path / "pool.json").write_text(json.dumps(['{"text":"Hello"}', "Raw line"]))
    cli.main(["rules-template", str(tmp_path / "pool.json"), str(tmp_path / "t.txt")])
    assert (tmp_path / "t.txt").read_text() == "---mtl---\n|Hello| ==> |TODO|\n---raw---\n|Raw line| ==> |TODO|\n"


def test_extract_pool_build(spark, root, tmp_path):  # noqa: F811
    for what in ("region", "datapack"):
        cli.main([f"{what}-extract", root, str(tmp_path / what)])
        cli.main(["pool", str(tmp_path / what), str(tmp_path / f"{what}-pool"), "--kind", what])
    assert sorted(r.text for r in spark.read.json(str(tmp_path / "region-pool")).collect()) == ["Hello", "Other"]
    assert [r.text for r in spark.read.json(str(tmp_path / "datapack-pool")).collect()] == ["Hello"]
    groups = spark.read.json(str(tmp_path / "region")).collect()
    assert sorted((g.dimension, [e.chunk_index for e in g.extractions]) for g in groups) == [("nether", [9]), ("overworld", [0, 5])]
    (tmp_path / "m.json").write_text(json.dumps({"Hello": "Hi"}))
    cli.main(["build", root, str(tmp_path / "m.json"), str(tmp_path / "out")])
    assert "say Hi" in (tmp_path / "out/datapacks/own/data/f/a.mcfunction").read_text()
    cli.main(["snbt", root, str(tmp_path / "dumps")])
    assert "CustomName" in (tmp_path / "dumps/region/r.0.-1.mca.txt").read_text()
    for name, value in (("a", {"k": "one", "q": "x"}), ("b", {"k": "eins", "z": "zwei"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    cli.main(["combine-languages", str(tmp_path / "a.json"), str(tmp_path / "b.json"), str(tmp_path / "pairs")])
    assert sorted((r.source, r.target) for r in spark.read.json(str(tmp_path / "pairs")).collect()) == [("one", "eins"), ("z", "zwei")]


def test_conversions():
    tree = convert.json_to_nbt(njson.parse('{"a":1,"b":3000000000,"c":0.5,"d":0.1,"e":true,"f":["x"]}'))
    assert [tree[k].kind for k in "abcde"] == ["int", "long", "float", "double", "byte"]
    for bad in ("[]", "[1,0.5]", "null", '{"a":null}'):
        try:
            convert.json_to_nbt(njson.parse(bad))
            raise AssertionError(bad)
        except nbt.NbtError:
            pass
    assert njson.write(convert.nbt_to_json({"a": Array("int", [1, 2]), "b": Num("short", 3)})) == '{"a":[1,2],"b":3}'
    assert convert.normal_component({"bold": Num("byte", 1), "nbt": "x", "odd": Num("byte", 1)}) == {"bold": True, "nbt": "x", "odd": Num("byte", 1), "interpret": False}


def test_replacement_groups(spark, root, tmp_path):  # noqa: F811
    for what in ("region", "datapack"):
        cli.main([f"{what}-extract", root, str(tmp_path / what)])
    (tmp_path / "m.json").write_text(json.dumps({"Hello": "Hi"}))
    cli.main(["unpool", str(tmp_path / "region"), str(tmp_path / "m.json"), str(tmp_path / "new"), "--kind", "region"])
    cli.main(["region-backfill", root, str(tmp_path / "new"), str(tmp_path / "out")])
    cli.main(["region-extract", str(tmp_path / "out"), str(tmp_path / "again")])
    assert sorted(e.content for g in spark.read.json(str(tmp_path / "again")).collect() for e in g.extractions) == ["Hi", "Hi", "Other"]
    cli.main(["replace-all", str(tmp_path / "datapack"), str(tmp_path / "same"), "--kind", "datapack", "--text", "T"])
    cli.main(["datapack-backfill", root, str(tmp_path / "same"), str(tmp_path / "out2")])
    assert (tmp_path / "out2/datapacks/own/data/f/a.mcfunction").read_text() == 'say T\nkill @e[name="T"]\n'


def test_project(spark, root, tmp_path, capsys):  # noqa: F811
    folder, model = str(tmp_path / "project"), ["--model", "tests.fake_model:upper"]
    cli.main(["project", "init", folder, "--world", root])
    cli.main(["project", "update", folder])
    assert "2 texts" in capsys.readouterr().out
    cli.main(["project", "terms", folder, "--model", "tests.fake_model:terms"])
    assert json.loads((tmp_path / "project/terms.json").read_text()) == {"Hello": "HELLO", "Other": "OTHER"}
    cli.main(["project", "translate", folder, *model])
    cli.main(["project", "update", folder])
    assert "0 texts to translate" in capsys.readouterr().out
    cli.main(["project", "build", folder, "--output", str(tmp_path / "out")])
    assert "say HELLO" in (tmp_path / "out/datapacks/own/data/f/a.mcfunction").read_text()
    with pytest.raises(FileExistsError):
        cli.main(["project", "init", folder, "--world", root])
    (tmp_path / "pool.json").write_text('{"text":"One Two","format":"plain_str"}\n{"text":"three"}\n')
    cli.main(["translate", str(tmp_path / "pool.json"), str(tmp_path / "t"), *model])
    assert sorted(r.target for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["ONE TWO", "THREE"]
    cli.main(["terms", str(tmp_path / "pool.json"), str(tmp_path / "w"), "--model", "tests.fake_model:terms"])
    assert sorted(r.term for r in spark.read.json(str(tmp_path / "w")).collect()) == ["One", "Two"]
