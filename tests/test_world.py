import io
import json
import zipfile

import pytest

from glyphmill.operators import translation
from glyphmill.parse import anvil, nbt
from glyphmill.parse.tree import Num
from glyphmill.plans.project import Project
from glyphmill.sources import world
from glyphmill.streaming import pools


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "world"
    (base / "region").mkdir(parents=True)
    (base / "DIM-1" / "region").mkdir(parents=True)
    (base / "datapacks" / "own" / "data" / "f").mkdir(parents=True)
    (base / "level.dat").write_bytes(nbt.write_gzip({"Data": {"DataVersion": Num("int", 3000)}}))
    chunk = lambda i, name: anvil.Chunk(i, anvil.ZLIB, b"", 3).replaced({"block_entities": [{"id": "c", "CustomName": name}], "n": Num("int", i)})
    (base / "region" / "r.0.-1.mca").write_bytes(anvil.write([chunk(0, "Hello"), chunk(5, "Other")]))
    (base / "DIM-1" / "region" / "r.2.3.mca").write_bytes(anvil.write([chunk(9, "Hello")]))
    (base / "region" / "r.1.mca").write_bytes(b"x" * 9000)
    (base / "region" / "r.4.4.mca").write_bytes(b"small")
    (base / "datapacks" / "own" / "data" / "f" / "a.mcfunction").write_text("say Hello\nkill @e[name=Hello]\n")
    (base / "datapacks" / "own" / "data" / "f" / "bad.json").write_text("{")
    (base / "datapacks" / "own" / "data" / "f" / "note.txt").write_text("say Hello")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("data/t.json", json.dumps({"display": {"title": "Hello", "n": 1}}))
        z.writestr("__MACOSX/t.json", "{}")
        z.writestr("keep.bin", b"\x00\x01")
    (base / "datapacks" / "zipped.zip").write_bytes(out.getvalue())
    return str(base)


def test_scan(spark, root):
    assert world.data_version(spark, root) == 3000
    regions = world.regions(spark, root)
    assert sorted((r.dimension, r.kind, r.x, r.z) for r in regions.collect()) == [("nether", "terrain", 2, 3), ("overworld", "terrain", 0, -1)]
    texts = world.region_texts(regions).collect()
    assert sorted((r.dimension, r.chunk_index, r.outer_pointer, r.content) for r in texts) == [
        ("nether", 9, ">#block_entities>0>#CustomName", "Hello"), ("overworld", 0, ">#block_entities>0>#CustomName", "Hello"), ("overworld", 5, ">#block_entities>0>#CustomName", "Other"),
    ]
    packs = world.pack_texts(world.pack_files(spark, root)).collect()
    assert sorted((r.source, r.path, r.content) for r in packs if not r.error) == [("own", "data/f/a.mcfunction", "Hello"), ("own", "data/f/a.mcfunction", "Hello"), ("zipped.zip", "data/t.json", "Hello")]
    assert [r.path for r in packs if r.error] == ["data/f/bad.json"]
    assert "Index 5:" in world.region_dump(regions).first().dump
    with pytest.raises(ValueError):
        world.data_version(spark, root + "/region")


def test_build(spark, root, tmp_path):
    target = str(tmp_path / "out")
    mapping = spark.createDataFrame([("Hello", "Bonjour"), ("Other", None)], "source string, target string")
    project = Project(root)
    assert project.missing(spark, mapping).collect() == []
    assert project.build(spark, mapping, target) == 4
    names = sorted((r.path, r.chunk_index, r.content) for r in world.region_texts(world.regions(spark, target)).collect())
    assert [n[2] for n in names] == ["Bonjour", "Bonjour", "Other"]
    with open(f"{target}/datapacks/own/data/f/a.mcfunction") as f:
        assert f.read() == 'say Bonjour\nkill @e[name="Bonjour"]\n'
    with zipfile.ZipFile(f"{target}/datapacks/zipped.zip") as z:
        assert json.loads(z.read("data/t.json")) == {"display": {"title": "Bonjour", "n": 1}} and z.read("keep.bin") == b"\x00\x01"


def test_build_keeps_commands_structures_and_chunks_of_any_kind(spark, tmp_path):
    base, target = tmp_path / "w", str(tmp_path / "out")
    (base / "region").mkdir(parents=True)
    (base / "datapacks" / "p").mkdir(parents=True)
    (base / "level.dat").write_bytes(nbt.write_gzip({"Data": {"DataVersion": Num("int", 3000)}}))
    tree = {"block_entities": [{"id": "command_block", "Command": 'execute run tellraw @e[name="Bob"] {"text":"Hello"}'}, {"id": "b", "Command": "say Hello"}, {"id": "c", "Command": "say Keep"}]}
    chunks = [anvil.Chunk(0, anvil.ZLIB, b"", 3).replaced(tree), anvil.Chunk(1, 4, b"LZ4 bytes", 4), anvil.Chunk(2, 130, b"", 5), anvil.Chunk(3, anvil.GZIP, b"broken", 6)]
    (base / "region" / "r.0.0.mca").write_bytes(anvil.write(chunks))
    bad = (b"\0\0\2\1".ljust(8192, b"\0") + b"\x7f\xff\xff\xff").ljust(12288, b"\0")  # one chunk, larger than its sectors
    (base / "region" / "r.0.1.mca").write_bytes(bad)
    loot = {"functions": [{"function": "minecraft:set_nbt", "tag": "{display:{Name:'Hello'},x:1s}"}]}
    (base / "datapacks" / "p" / "t.json").write_text(json.dumps(loot))
    (base / "datapacks" / "p" / "f.mcfunction").write_text("give @s minecraft:stick[item_name='Hello']\n# say Hello\n")
    nested = {"": {"tag": {"Command": "say Hello"}}}
    (base / "datapacks" / "p" / "n.nbt").write_bytes(nbt.write_gzip(nested))
    mapping = spark.createDataFrame([('{"text":"Hello"}', '{"text":"Salut"}'), ("Hello", "Bonjour"), ("Bob", "Bill")], "source string, target string")
    assert Project(str(base)).build(spark, mapping, target) == 4
    new = anvil.read((tmp_path / "out" / "region" / "r.0.0.mca").read_bytes())
    assert [(c.index, c.kind, c.data, c.time) for c in new[1:]] == [(1, 4, b"LZ4 bytes", 4), (2, 130, b"", 5), (3, anvil.GZIP, b"broken", 6)]
    assert [b["Command"] for b in new[0].tree()["block_entities"]] == ['execute run tellraw @e[name="Bill"] {"text":"Salut"}', "say Bonjour", "say Keep"]
    assert (tmp_path / "out" / "region" / "r.0.1.mca").read_bytes() == bad
    assert json.loads((tmp_path / "out" / "datapacks" / "p" / "t.json").read_text())["functions"][0]["tag"] == '{display:{Name:"Bonjour"},x:1s}'
    assert (tmp_path / "out" / "datapacks" / "p" / "f.mcfunction").read_text() == "give @s minecraft:stick[item_name=\"Bonjour\"]\n# say Hello\n"
    assert nbt.read_gzip((tmp_path / "out" / "datapacks" / "p" / "n.nbt").read_bytes()) == {"": {"tag": {"Command": "say Bonjour"}}}
    rows = world.region_chunks(world.regions(spark, str(base))).collect()
    assert sorted((r.chunk_index is None, r.chunk_index or 0, r.error is None) for r in rows) == [(False, 0, True), (False, 1, False), (False, 2, False), (False, 3, False), (True, 0, False)]
    assert {r.path: r.dump is None for r in world.region_dump(world.regions(spark, str(base))).collect()} == {"region/r.0.0.mca": False, "region/r.0.1.mca": True}
    assert world.typed_chunks(world.regions(spark, str(base)), "terrain").count() == 1


def test_replacements_by_ordinal(spark, root):
    regions, packs = world.regions(spark, root), world.pack_files(spark, root)
    rows = world.region_texts(regions).selectExpr("path", "chunk_index", "ordinal", "concat(content, chunk_index) AS replacement")
    new = world.replaced_regions(regions, rows).withColumn("k", world.F.lit(1))
    assert sorted(r.content for r in world.region_texts(new).collect()) == ["Hello0", "Hello9", "Other5"]
    rows = world.pack_texts(packs).where("error IS NULL").selectExpr("source", "path", "ordinal", "CASE WHEN ordinal = 1 THEN concat(content, 2) END AS replacement")
    (new,) = world.replaced_packs(packs, rows).collect()
    assert bytes(new.content) == b'say Hello\nkill @e[name="Hello2"]\n'


def test_files_leading_out_are_refused(spark, tmp_path):
    for path in ("../x", "/x", "a/../../x"):
        with pytest.raises(Exception, match="leads out"):
            world.write_files(spark.createDataFrame([(path, bytearray(b"x"))], "path string, content binary"), str(tmp_path / "o"))


def test_translation_of_what_is_missing(spark, root):
    def model(text):
        from glyphmill.operators.translation import END, START, TERMS, TRANSLATED

        return TRANSLATED + "\n" + "\n".join(x.upper() for x in text.split(START + "\n")[1].split("\n")) + f"\n{TERMS}\n{{}}\n{END}"

    mapping = spark.createDataFrame([("Hello", "Bonjour")], "source string, target string")
    full = Project(root).translated(spark, mapping, model)
    assert sorted(map(tuple, full.collect())) == [("Hello", "Bonjour"), ("Other", "OTHER")]
    assert translation.exported(translation.translate(spark.createDataFrame([], "format string, text string"), model)).collect() == []


def test_stream_pools_each_text_once(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), ("  ",), ("12",)], "text string")
    for i in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        pools.run_to(pools.new_texts(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
