"""Queries over worlds: regions, chunks and packs, made from table columns, rewritten and read back."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from glyphmill.functions.udfs import exploded, scalar
from glyphmill.operators import extraction, interchange, mapping
from glyphmill.parse import anvil, nbt, njson, snbt
from glyphmill.parse.tree import Array, Num
from glyphmill.queries import _t, query, region_files
from glyphmill.sources import world


def _named_regions(spark, sf, *more):
    """One region a part, with more of its columns: a command block, a sign and a chunk of a compression that isn't decoded."""

    def build(key: int, name: str, kind: str) -> bytes:
        tree = {"block_entities": [{"id": "command_block", "Command": f'execute run tellraw @a[name="{kind}"] {{"text":"{name}"}}'}, {"id": "sign", "CustomName": name, "n": Num("long", int(key))}]}
        return anvil.write([anvil.Chunk(int(key) % 1000, anvil.ZLIB, b"", 0).replaced(tree), anvil.Chunk(1000, 4, kind.encode(), 9)])

    # Parts are dealt out while they are small: a region is a hundred times its part, and a small table is one task.
    part = _t(spark, sf, "part").withColumn("path", F.col("p_partkey").cast("string")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return part.select("path", *more, scalar(build, "binary", "p_partkey", "p_name", "p_type").alias("content"))


def _part_names(spark, sf):
    """p_name and the component of it -> capitals; p_type -> p_type and a star."""
    part = _t(spark, sf, "part")
    names = part.select(F.col("p_name").alias("source"), F.upper("p_name").alias("target"))
    whole = [F.concat(F.lit('{"text":"'), c, F.lit('"}')) for c in (F.col("source"), F.col("target"))]
    kinds = part.select(F.col("p_type").alias("source"), F.concat("p_type", F.lit("*")).alias("target"))
    return names.unionByName(names.select(whole[0].alias("source"), whole[1].alias("target"))).unionByName(kinds).distinct()


_BACKFILLED = """SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_partkey % 1000 AS INT) AS chunk_index, CAST(n AS INT) AS ordinal,
 CASE n WHEN 0 THEN concat(p_type, '{}') WHEN 1 THEN concat('{{"text":"', {}, '"}}') ELSE {} END AS content FROM part, (VALUES (0), (1), (2)) v(n)"""


@query(_BACKFILLED.format("*", "upper(p_name)", "upper(p_name)") + " UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1000, 9, p_type FROM part")
def region_backfill(spark, sf):
    """Texts in commands and out of them put back by a mapping; the chunk that isn't decoded keeps its bytes and time."""
    regions = _named_regions(spark, sf)
    texts = world.region_texts(regions).where("error IS NULL")
    done = world.translated_regions(regions, texts, _part_names(spark, sf))

    def kept(content):
        yield from ({"chunk_index": c.index, "ordinal": c.time, "content_text": c.data.decode()} for c in anvil.read(bytes(content)) if c.kind == 4)

    raw = exploded(done, kept, "chunk_index int, ordinal int, content_text string", "content", drop=["content"]).select("path", "chunk_index", "ordinal", F.col("content_text").alias("content"))
    return world.region_texts(done).where("error IS NULL").select("path", "chunk_index", "ordinal", "content").unionByName(raw)


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_partkey % 1000 AS INT) AS chunk_index, CAST(n AS INT) AS ordinal, CASE WHEN n = p_size % 3 THEN concat('new', n) ELSE CASE n WHEN 0 THEN p_type WHEN 1 THEN concat('{\"text\":\"', p_name, '\"}') ELSE p_name END END AS content FROM part, (VALUES (0), (1), (2)) v(n)")
def region_replaced(spark, sf):
    """One of each chunk's three texts replaced by its number."""
    regions = _named_regions(spark, sf, "p_size")
    rows = world.region_texts(regions).where("error IS NULL AND ordinal = p_size % 3").selectExpr("path", "chunk_index", "ordinal", "concat('new', ordinal) AS replacement")
    return world.region_texts(world.replaced_regions(regions, rows)).where("error IS NULL").select("path", "chunk_index", "ordinal", "content")


@query("SELECT p_brand, p_partkey // 1024 AS region, CAST(p_partkey % 1024 AS INT) AS chunk_index, CAST(1 + p_partkey % 1024 % 3 AS INT) AS compression, CAST(7 AS BIGINT) AS time, concat('{id:', p_partkey, 'L,name:\"', p_name, '\"}') AS snbt FROM part")
def region_chunks(spark, sf):
    return world.region_chunks(region_files(spark, sf)).where("error IS NULL").drop("error")


@query("SELECT p_brand, p_partkey // 1024 AS region, CAST(1024 - count(*) AS INT) AS empty, CAST(count(*) AS INT) AS full FROM part GROUP BY ALL")
def region_dump(spark, sf):
    """Chunks that a dump shows, and those that it says are empty."""
    dumps = world.region_dump(region_files(spark, sf))
    return dumps.select("p_brand", "region", F.regexp_count("dump", F.lit("<empty_chunk>")).alias("empty"), F.regexp_count("dump", F.lit("name: ")).alias("full"))


@query("SELECT p_partkey, p_size AS x, -p_size AS z, CAST(2 AS INT) AS n, p_type AS second FROM part")
def typed_chunks_entities(spark, sf):
    def build(key: int, size: int, kind: str) -> bytes:
        tree = {"DataVersion": Num("int", 3000), "Position": Array("int", [int(size), -int(size)]), "Entities": [{"id": "a"}, {"id": kind}]}
        return anvil.write([anvil.Chunk(int(key) % 1024, anvil.PLAIN, b"", 0).replaced(tree)])

    rows = _t(spark, sf, "part").select("p_partkey", scalar(build, "binary", "p_partkey", "p_size", "p_type").alias("content"))
    return world.typed_chunks(rows, "entities").selectExpr("p_partkey", "chunk_x AS x", "chunk_z AS z", "chunk_n_entities AS n", "chunk_ids[1] AS second")


@query("SELECT p_partkey, CAST(2 AS INT) AS sections, p_size + 1 AS records FROM part")
def typed_chunks_poi(spark, sf):
    def build(key: int, size: int) -> bytes:
        tree = {"DataVersion": Num("int", 3000), "Sections": {"0": {"Records": [{"type": "x"}] * int(size)}, "1": {"Records": [{"type": "y"}]}}}
        return anvil.write([anvil.Chunk(int(key) % 1024, anvil.GZIP, b"", 0).replaced(tree)])

    rows = _t(spark, sf, "part").select("p_partkey", scalar(build, "binary", "p_partkey", "p_size").alias("content"))
    return world.typed_chunks(rows, "poi").selectExpr("p_partkey", "chunk_n_sections AS sections", "chunk_n_records AS records")


# --- packs ------------------------------------------------------------------------------------------


def _packs(spark, sf):
    """Three files a part: a function, a loot table with SNBT in it, and NBT with a command."""
    part = _t(spark, sf, "part")
    function = part.select("p_brand", F.concat(F.lit("f"), "p_partkey", F.lit(".mcfunction")), F.encode(F.concat(F.lit("# say "), "p_name", F.lit("\nsay "), "p_name", F.lit("\nkill @e[name="), "p_type", F.lit("]\n")), "UTF-8"))
    loot = part.select("p_brand", F.concat(F.lit("t"), "p_partkey", F.lit(".json")), F.encode(F.concat(F.lit('{"functions":[{"tag":"{display:{Name:\''), "p_name", F.lit("'}}\"}]}")), "UTF-8"))
    tree = scalar(lambda name: nbt.write_gzip({"": {"tag": {"Command": f"say {name}"}}}), "binary", "p_name")
    data = part.select("p_brand", F.concat(F.lit("n"), "p_partkey", F.lit(".nbt")), tree)
    return function.union(loot).union(data).toDF("source", "path", "content")


_PACK_TEXTS = """SELECT p_brand AS source, concat(CASE n WHEN 2 THEN 't' WHEN 3 THEN 'n' ELSE 'f' END, p_partkey, CASE n WHEN 2 THEN '.json' WHEN 3 THEN '.nbt' ELSE '.mcfunction' END) AS path,
 CASE WHEN n = 1 THEN 1 ELSE 0 END AS ordinal, CASE n WHEN 2 THEN '>#functions>0>#tag' WHEN 3 THEN '>#>#tag>#Command' END AS outer_pointer,
 CASE WHEN n = 1 THEN {} ELSE {} END AS content FROM part, (VALUES (0), (1), (2), (3)) v(n)"""


@query(_PACK_TEXTS.format("p_type", "p_name"))
def pack_texts(spark, sf):
    """The texts of functions, JSON and NBT of packs."""
    return world.pack_texts(_packs(spark, sf)).where("error IS NULL").select("source", "path", "ordinal", "outer_pointer", "content")


@query(_PACK_TEXTS.format("concat('\"', p_type, '*\"')", "upper(p_name)"))
def pack_backfill(spark, sf):
    """They are put back by a mapping; a selector's name gets quotes, a comment stays."""
    packs = _packs(spark, sf)
    texts = world.pack_texts(packs).where("error IS NULL")
    done = world.translated_packs(packs, texts, _part_names(spark, sf))
    return world.pack_texts(done).where("error IS NULL").select("source", "path", "ordinal", "outer_pointer", "content")


def _archives(spark, sf):
    def build(key: int, name: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("data/", "")
            z.writestr("data/a.json", json.dumps({"title": name}))
            z.writestr("keep.bin", bytes(int(key) % 7))
        return out.getvalue()

    return _t(spark, sf, "part").select(F.concat("p_partkey", F.lit(".zip")).alias("source"), scalar(build, "binary", "p_partkey", "p_name").alias("content"))


@query("SELECT concat(p_partkey, '.zip') AS source, 'data/a.json' AS path, CAST(13 + length(p_name) AS INT) AS size FROM part UNION ALL SELECT concat(p_partkey, '.zip'), 'keep.bin', CAST(p_partkey % 7 AS INT) FROM part")
def archive_entries(spark, sf):
    """The files in archives, folders left out."""
    return world.archive_entries(_archives(spark, sf)).select("source", "path", F.octet_length("content").alias("size"))


@query("SELECT concat(p_partkey, '.zip') AS source, 'data/a.json' AS path, concat('{\"title\":\"', upper(p_name), '\"}') AS text FROM part WHERE p_size % 2 = 0 UNION ALL SELECT concat(p_partkey, '.zip'), 'keep.bin', repeat(chr(48), CAST(p_partkey % 7 AS INT)) FROM part WHERE p_size % 2 = 0")
def archive_rewrite(spark, sf):
    """One entry replaced in the archives of parts of even size; the other is copied."""
    part = _t(spark, sf, "part").where("p_size % 2 = 0")
    new = part.select(F.concat("p_partkey", F.lit(".zip")).alias("source"), F.lit("data/a.json").alias("path"), F.encode(F.concat(F.lit('{"title":"'), F.upper("p_name"), F.lit('"}')), "UTF-8").alias("content"))
    done = world.archive_entries(world.filled_archives(_archives(spark, sf), new))
    return done.select("source", "path", F.translate(F.decode("content", "UTF-8"), "\0", "0").alias("text"))


@query("SELECT p_partkey, '>#Items>0>#components>#minecraft:custom_name' AS outer_pointer, p_name AS content FROM part UNION ALL SELECT p_partkey, '>#Items>1>#CustomName', p_type FROM part")
def nbt_leaves(spark, sf):
    def build(name: str, kind: str) -> bytes:
        return nbt.write_gzip({"Items": [{"id": "a", "components": {"minecraft:custom_name": name}}, {"id": "b", "CustomName": kind}]})

    rows = _t(spark, sf, "part").select("p_partkey", scalar(build, "binary", "p_name", "p_type").alias("content_bytes"))
    return extraction.nbt_leaves(rows, "content_bytes").where("error IS NULL").select("p_partkey", "outer_pointer", "content")


# --- records ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand AS source, CAST(i AS INT) AS ordinal, CASE i WHEN 0 THEN p_name ELSE p_type END AS content FROM part, (VALUES (0), (1)) v(i)")
def group_files(spark, sf):
    """Extraction groups as people write them: comments, trailing commas, fields that nothing knows."""
    text = """concat('[ // a comment\n {"type":"datapack","source":"', p_brand, '","path":"', p_partkey, '","odd":[1,],"extractions":[{"ordinal":0,"content":"', p_name, '",}, /* one more */ {"ordinal":1,"content":"', p_type, '"},],},]') AS t"""
    groups = interchange.parsed_groups(_t(spark, sf, "part").selectExpr(text), "t", "datapack")
    return interchange.from_groups(groups, "datapack").selectExpr("CAST(path AS BIGINT) AS p_partkey", "source", "ordinal", "content")


@query("SELECT concat('{', chr(10), '  \"name\": \"', p_name, '\",', chr(10), '  \"sizes\": [', chr(10), '    ', p_size, ',', chr(10), '    null', chr(10), '  ]', chr(10), '}') AS pretty, concat('{\"name\":\"', p_name, '\",\"sizes\":[', p_size, ',null]}') AS compact, p_partkey FROM part")
def json_writers(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat('{\"name\":\"', p_name, '\",\"sizes\":[', p_size, ',null]}') AS t")
    return rows.select("p_partkey", scalar(lambda t: njson.pretty(njson.parse(t)), "string", "t").alias("pretty"), scalar(lambda t: njson.write(njson.parse(t)), "string", "t").alias("compact"))


@query("SELECT kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN 'region' ELSE 'datapack' END AS kind FROM part) GROUP BY kind")
def groups_by_type(spark, sf):
    """A mixed table of groups split by type, each part counted, and united again."""
    mixed = _t(spark, sf, "part").selectExpr("p_partkey AS k", "CASE WHEN p_size % 3 = 0 THEN 'region' ELSE 'datapack' END AS type")
    parts = interchange.by_type(mixed, "region", "datapack")
    out = [frame.groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum("k").alias("keys")) for kind, frame in parts.items()]
    return out[0].unionByName(out[1])


@query("SELECT p_brand AS source, p_type AS path, p_partkey AS ordinal, concat(upper(p_name), '!') AS replacement FROM part WHERE p_size % 2 = 0")
def groups_unpooled(spark, sf):
    """A mapping applied to extraction groups: replacement groups hold the texts that have a target."""
    part = _t(spark, sf, "part")
    leaves = part.selectExpr("p_brand AS source", "p_type AS path", "CAST(p_partkey AS INT) AS ordinal", "concat(p_name, p_partkey) AS content")
    to = part.selectExpr("concat(p_name, p_partkey) AS source", "CASE WHEN p_size % 2 = 0 THEN concat(upper(p_name), '!') END AS target")
    groups = interchange.unpooled(interchange.to_groups(leaves, "datapack"), to, "datapack")
    return interchange.from_groups(groups, "datapack").selectExpr("source", "path", "CAST(ordinal AS BIGINT) AS ordinal", "replacement")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10 + CAST(l_quantity AS INT) % 13, l_linenumber) AS INT) AS place FROM lineitem")
def display_order(spark, sf):
    spans = _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_linenumber * 10 + CAST(l_quantity AS INT) % 13 AS start", "l_linenumber AS end")
    return mapping.in_display_order(spans, "l_orderkey").select("l_orderkey", "l_linenumber", "place")


@query("SELECT p_partkey, concat('{a:[', p_size, ',', p_size + 1, '],b:', p_size, ',t:\"', p_name, '\"}') AS json_text, concat('[', p_size, ',', p_size + 1, ']') AS plain FROM part")
def nbt_to_json(spark, sf):
    """Typed arrays become lists of numbers, numbers keep their value, both as JSON and in the neutral form."""
    from glyphmill.parse import convert

    def run(name: str, size: int):
        tree = {"a": Array("int", [int(size), int(size) + 1]), "b": Num("short", int(size)), "t": name}
        yield {"json_text": njson.write(convert.nbt_to_json(tree)).replace('"a"', "a").replace('"b"', "b").replace('"t"', "t"), "plain": snbt.write(convert.neutral(tree)["a"])}

    return exploded(_t(spark, sf, "part").select("p_partkey", "p_name", "p_size"), run, "json_text string, plain string", "p_name", "p_size").drop("p_name", "p_size")
