"""Worlds as tables: region files, their chunks, and data packs in folders or archives, read and written.

Files are listed and read by Spark's ``binaryFile`` source, so any store that it reads will do. A region
or an archive is one row and one unit of work; a chunk or an entry is a row of its own from there on.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import double_unquoted, extension, single_unquoted
from glyphmill.functions.udfs import exploded, scalar
from glyphmill.operators.extraction import LEAVES, SPANS, _error, _leaves
from glyphmill.parse import anvil, backfill, extract, nbt, njson, snbt
from glyphmill.plans.catalog import builtin
from glyphmill.plans.patterns import Patterns

#: From this data version on, all dimensions lie below ``dimensions``.
NEW_LAYOUT = 4774


def files(spark: SparkSession, root: str, glob: str = "*", below: str = "") -> DataFrame:
    """(path, content, length) of all files below a folder, or below a folder or file in it; path is relative to ``root``. None where there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    place = f"{root.rstrip('/')}/{below}".rstrip("/")
    if below and not exists(spark, place):
        return spark.createDataFrame([], "path string, content binary, length long")
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    return found.load(place).select(relative.alias("path"), "content", "length")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store that Spark reads has such a file or folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def copy_folder(spark: SparkSession, source: str, target: str) -> int:
    """Copy all files below a folder, hidden ones too; how many. The driver lists their names, executors copy them in pieces; files that are there are replaced."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, found, names = fs.resolvePath(at).toUri().getPath().rstrip("/"), fs.listFiles(at, True), []
    while found.hasNext():
        names.append((found.next().getPath().toUri().getPath().removeprefix(base + "/"),))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (old, from_), (new, to) = _store(source), _store(target)
        for part in parts:
            for path in part["path"]:
                with old.open_input_stream(f"{from_}/{path}") as content:
                    _put(new, f"{to}/{path}", iter(lambda: content.read(1 << 20), b""))
            yield part

    paths = spark.createDataFrame(names, "path string")
    return paths.repartition(max(1, min(len(names), 8 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "path string").count()


def _store(root: str):
    """Arrow's file system for a folder, and the folder's path there."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
    return store, base.rstrip("/")


def _put(store, path: str, pieces: Iterable[bytes]) -> None:
    """Write a file beside its place and move it there, so that a task that is run again does no harm."""
    store.create_dir(posixpath.dirname(path), recursive=True)
    with store.open_output_stream(path + "._tmp") as out:
        for piece in pieces:
            out.write(piece)
    store.move(path + "._tmp", path)


def data_version(spark: SparkSession, root: str) -> int | None:
    """The version in level.dat; ValueError if there is no such file, None if it doesn't tell."""
    rows = files(spark, root, below="level.dat").collect()
    if not rows:
        raise ValueError("no level.dat: not a world")
    try:
        return nbt.read_gzip(bytes(rows[0].content))["Data"]["DataVersion"].value
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def region_place(path: Column) -> Column:
    """struct(dimension, kind, x, z) of a region file's path in a world, or null: r.<x>.<z>.mca below region, poi or entities of a known dimension."""
    m = lambda i: F.regexp_extract(path, r"^(?:(DIM-1|DIM1|dimensions/[^/]+/[^/]+)/)?(region|poi|entities)/r\.(-?\d+)\.(-?\d+)\.mca$", i)
    x, z = m(3).try_cast("int"), m(4).try_cast("int")
    old = F.when(m(1) == "", "overworld").when(m(1) == "DIM-1", "nether").when(m(1) == "DIM1", "the_end")
    dimension = F.coalesce(old, F.regexp_replace(F.regexp_replace(m(1), "^dimensions/", ""), "^minecraft/", ""))
    kind = F.when(m(2) == "region", "terrain").otherwise(m(2))
    return F.when(x.isNotNull() & z.isNotNull(), F.struct(dimension.alias("dimension"), kind.alias("kind"), x.alias("x"), z.alias("z")))


def in_layout(path: Column, new: bool) -> Column:
    """Whether a file belongs to a world of the new layout (all below dimensions) or the old one (own folders; dimensions for other namespaces)."""
    return path.startswith("dimensions/") if new else ~path.startswith("dimensions/minecraft/")


def has_new_layout(spark: SparkSession, root: str) -> bool:
    """By the data version, or where that isn't known by there being a folder of dimensions."""
    version = data_version(spark, root)
    if version is not None:
        return version >= NEW_LAYOUT
    return not files(spark, root, "*.mca").where(F.col("path").startswith("dimensions/")).select("path").isEmpty()


def regions(spark: SparkSession, root: str) -> DataFrame:
    """(path, dimension, kind, x, z, content) of the region files that are large enough."""
    found = files(spark, root, "*.mca").where(F.col("length") >= anvil.LEAST)
    found = found.where(in_layout(F.col("path"), has_new_layout(spark, root)))
    return found.withColumn("p", region_place(F.col("path"))).where("p IS NOT NULL").select("path", "p.*", "content")


def region_texts(regions: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """One row per text of all chunks; what can't be read is a row with ``error``, and the rest goes on."""
    catalog = patterns or builtin()

    def run(content: bytes) -> Iterator[dict]:
        try:
            chunks = anvil.read(bytes(content))
        except ValueError as e:
            yield {"chunk_index": None} | _error(e)[0]
            return
        for c in chunks:
            try:
                rows = _leaves(extract.nbt_texts(c.tree(), catalog))
            except ValueError as e:
                rows = _error(e)
            yield from ({"chunk_index": c.index} | r for r in rows)

    return exploded(regions.withColumnRenamed("content", "_bytes"), run, "chunk_index int, " + LEAVES, "_bytes", drop=["_bytes"])


def _chunks(content: bytes) -> list[anvil.Chunk]:
    """The chunks of a region, or none where it can't be read."""
    try:
        return anvil.read(bytes(content))
    except anvil.RegionError:
        return []


def region_chunks(regions: DataFrame) -> DataFrame:
    """(…, chunk_index, compression, time, snbt, error) of every chunk; of one that can't be decoded snbt is null, and a region that can't be read is one row."""

    def run(content: bytes) -> Iterator[dict]:
        try:
            chunks = anvil.read(bytes(content))
        except anvil.RegionError as e:
            yield {"error": str(e)}
            return
        for c in chunks:
            row = {"chunk_index": c.index, "compression": c.kind, "time": c.time}
            try:
                yield row | {"snbt": snbt.write(c.tree()), "error": None}
            except ValueError as e:
                yield row | {"error": str(e)}

    schema = "chunk_index int, compression int, time long, snbt string, error string"
    none = dict.fromkeys(x.split()[0] for x in schema.split(", "))
    return exploded(regions, lambda content: (none | x for x in run(content)), schema, "content", drop=["content"])


_TYPED = {
    "terrain": ("data_version int, x int, z int, y int, status string, last_update long, inhabited_time long, n_sections int, n_block_entities int", lambda t: {
        "data_version": _number(t, "DataVersion"), "x": _number(t, "xPos"), "z": _number(t, "zPos"), "y": _number(t, "yPos"), "status": t.get("Status"), "last_update": _number(t, "LastUpdate"),
        "inhabited_time": _number(t, "InhabitedTime"), "n_sections": len(t.get("sections", ())), "n_block_entities": len(t.get("block_entities", ()))}),
    "entities": ("data_version int, x int, z int, n_entities int, ids array<string>", lambda t: {
        "data_version": _number(t, "DataVersion"), **dict(zip(("x", "z"), getattr(t.get("Position"), "values", (None, None)), strict=False)), "n_entities": len(t.get("Entities", ())), "ids": [e.get("id") for e in t.get("Entities", ())]}),
    "poi": ("data_version int, n_sections int, n_records int", lambda t: {
        "data_version": _number(t, "DataVersion"), "n_sections": len(t.get("Sections", {})), "n_records": sum(len(s.get("Records", ())) for s in t.get("Sections", {}).values())}),
}


def _number(tree: dict, name: str):
    return getattr(tree.get(name), "value", None)


def typed_chunks(regions: DataFrame, kind: str) -> DataFrame:
    """Chunks of a kind (terrain, entities, poi) with the fields of their type; what can't be read is left out."""
    schema, fields = _TYPED[kind]

    def run(content: bytes) -> Iterator[dict]:
        for c in _chunks(content):
            try:
                yield {"chunk_index": c.index} | {f"chunk_{k}": v for k, v in fields(c.tree()).items()}
            except (ValueError, AttributeError, TypeError):
                continue

    named = ", ".join(f"chunk_{x.strip()}" for x in schema.split(", "))
    rows = regions.where(F.col("kind") == kind) if "kind" in regions.columns else regions
    return exploded(rows, run, f"chunk_index int, {named}", "content", drop=["content"])


def region_dump(regions: DataFrame) -> DataFrame:
    """(…, dump): all chunks of a region as readable SNBT; null for a region that can't be read."""

    def text(chunk: anvil.Chunk | None) -> str:
        if chunk is None:
            return "<empty_chunk>"
        try:
            return snbt.pretty(chunk.tree())
        except ValueError as e:
            return f"<unreadable: {e}>"

    def run(content: bytes) -> str | None:
        try:
            found = {c.index: c for c in anvil.read(bytes(content))}
        except anvil.RegionError:
            return None
        return "\n\n".join(f"Index {i}:\n{text(found.get(i))}" for i in range(anvil.CHUNKS))

    return regions.withColumn("dump", scalar(run, "string", "content")).drop("content")


def _modified(content: bytes, change: Callable[[anvil.Chunk], anvil.Chunk], now: int | None) -> bytes | None:
    """A region with its chunks changed; None if it can't be read. A chunk that can't be changed stays as it is."""
    out = []
    try:
        for c in anvil.read(bytes(content)):
            try:
                out.append(change(c))
            except ValueError:
                out.append(c)
        return anvil.write(out, now)
    except anvil.RegionError:
        return None


def _beside(files: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """Files with the items of each. Spark takes the bytes of made files for 100 a row, so without a word it would broadcast them; here the items are hashed and files stream past."""
    return files.join(items.hint("shuffle_hash"), [*keys])


def filled_regions(regions: DataFrame, replacements: DataFrame, now: int | None = None) -> DataFrame:
    """(path, content) of the regions that have replacements(path, ordinal, chunk_index, pointer, format, replacement).

    Chunks without any, and those that can't be decoded or take no such replacement, stay byte for byte, whatever
    their compression; a region that can't be read gives no row. Times are set to ``now`` if given.
    """
    items = F.sort_array(F.collect_list(F.struct("ordinal", "chunk_index", "pointer", "format", "replacement"))).alias("items")

    def run(content: bytes, rows) -> bytes | None:
        own: dict[int, list] = {}
        for r in rows:
            own.setdefault(int(r["chunk_index"]), []).append((r["pointer"], r["format"], r["replacement"]))

        def change(c: anvil.Chunk) -> anvil.Chunk:
            if c.index not in own:
                return c
            name, tree = c.named()
            return c.replaced(backfill.fill(tree, own[c.index], "nbt_obj"), name)

        return _modified(content, change, now)

    return _filled(_beside(regions.select("path", "content"), replacements.groupBy("path").agg(items), "path"), run, "content")


def _filled(joined: DataFrame, run: Callable, *columns: str) -> DataFrame:
    """The files with items, and what run gives for these columns and the items as their content; of a file where that is None no row."""

    def filled(*row) -> Iterator[dict]:
        if None not in row and (new := run(*row)) is not None:
            yield {"_new": new}

    return exploded(joined, filled, "_new binary", *columns, "items", drop=["content", "items"]).withColumnRenamed("_new", "content")


def _pairs(texts: DataFrame, mapping: DataFrame, *keys: str) -> DataFrame:
    """(keys, items): for each file its texts that have a target, with that; string literals by their content, too."""
    text = F.col("content")
    forms = F.array_compact(F.array(text, F.coalesce(double_unquoted(text), single_unquoted(text))))
    own = texts.where(text.isNotNull()).select(*keys, F.explode(forms).alias("source")).distinct()
    joined = own.hint("merge").join(mapping.where("target IS NOT NULL").select("source", "target"), "source")  # neither side is small for sure
    return joined.groupBy(*keys).agg(F.collect_list(F.struct("source", "target")).alias("items"))


def _rewritten_regions(regions: DataFrame, items: DataFrame, picker: Callable, patterns: Patterns | None, now: int | None) -> DataFrame:
    """(path, content) of regions with items(path, items); picker(items) gives for a chunk's index what picks its replacements, or None."""
    catalog = patterns or builtin()

    def run(content: bytes, rows) -> bytes | None:
        pick_of = picker(rows)

        def change(c: anvil.Chunk) -> anvil.Chunk:
            pick = pick_of(c.index)
            if pick is None:
                return c
            name, tree = c.named()
            new = backfill.replaced_tree(tree, extract.nbt_texts(tree, catalog), pick, "nbt_obj")
            return c if new is None else c.replaced(new, name)

        return _modified(content, change, now)

    return _filled(_beside(regions.select("path", "content"), items, "path"), run, "content")


def translated_regions(regions: DataFrame, texts: DataFrame, mapping: DataFrame, patterns: Patterns | None = None, now: int | None = None) -> DataFrame:
    """(path, content) of the regions with ``texts(path, content, ...)`` of them replaced by mapping(source, target).

    Plain texts, texts inside commands (only their spans change) and texts in nested structures. As with
    filled_regions, whatever isn't replaced stays byte for byte.
    """

    def picker(rows):
        pick = backfill.by_mapping({r["source"]: r["target"] for r in rows})
        return lambda index: pick

    return _rewritten_regions(regions, _pairs(texts, mapping, "path"), picker, patterns, now)


def replaced_regions(regions: DataFrame, replacements: DataFrame, patterns: Patterns | None = None, now: int | None = None) -> DataFrame:
    """(path, content) of the regions with replacements(path, chunk_index, ordinal, replacement): ordinals count a chunk's texts as region_texts does."""

    def picker(rows):
        own: dict[int, dict[int, str]] = {}
        for r in rows:
            own.setdefault(int(r["chunk_index"]), {})[int(r["ordinal"])] = r["replacement"]
        return lambda index: backfill.by_ordinal(own[index]) if index in own else None

    items = replacements.where("replacement IS NOT NULL").groupBy("path").agg(F.collect_list(F.struct("chunk_index", "ordinal", "replacement")).alias("items"))
    return _rewritten_regions(regions, items, picker, patterns, now)


def archive_entries(archives: DataFrame) -> DataFrame:
    """(source, path, content) of the files in archives(source, content), folders left out; none of what is no archive, or of an entry that can't be read."""

    def entries(content: bytes) -> Iterator[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        try:
                            yield {"inner": info.filename, "data": z.read(info)}
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error):
                            continue
        except zipfile.BadZipFile:
            return

    rows = exploded(archives, entries, "inner string, data binary", "content", drop=["content"])
    return rows.select("source", F.col("inner").alias("path"), F.col("data").alias("content"))


def pack_files(spark: SparkSession, root: str) -> DataFrame:
    """(source, path, content) of the files of all packs in ``datapacks``: folders, and archives ending in .zip.

    Only mcfunction, json and nbt files that aren't empty and have no __MACOSX in their path.
    """
    found = files(spark, root, below="datapacks")
    parts = F.split("path", "/")
    plain = found.where(F.size(parts) > 2).select(F.element_at(parts, 2).alias("source"), F.array_join(F.slice(parts, 3, 1000), "/").alias("path"), "content")

    archives = found.where((F.size(parts) == 2) & F.col("path").endswith(".zip")).select(F.element_at(parts, 2).alias("source"), "content")
    inside = archive_entries(archives)
    every = plain.unionByName(inside)
    kept = ~F.array_contains(F.split("path", "/"), "__MACOSX") & (F.octet_length("content") > 0)
    return every.where(kept & extension(F.col("path")).isin("mcfunction", "json", "nbt"))


def pack_texts(packs: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """One row per text of pack files; spans for functions, pointers for JSON and NBT, ``error`` where a file can't be read."""
    catalog = patterns or builtin()
    none = dict.fromkeys(("start", "end", "outer_pointer", "inner_pointer", "error"))

    def run(path: str, content: bytes) -> Iterator[dict]:
        try:
            if path.endswith(".mcfunction"):
                for i, s in enumerate(extract.command_texts(bytes(content).decode("utf-8"), catalog)):
                    yield none | {"ordinal": i, "start": s.start, "end": s.end - 1, "content_text": s.content, "syntax": s.syntax, "format": s.format}
                return
            found = extract.json_texts(bytes(content).decode("utf-8"), catalog) if path.endswith(".json") else extract.nbt_texts(nbt.read_gzip(bytes(content)), catalog)
            rows = _leaves(found)
        except ValueError as e:
            rows = _error(e)
        for r in rows:
            yield none | {"content_text" if k == "content" else k: v for k, v in r.items()}

    schema = SPANS.replace("content string", "content_text string") + ", outer_pointer string, inner_pointer string, error string"
    return exploded(packs, run, schema, "path", "content", drop=["content"]).withColumnRenamed("content_text", "content")


def filled_packs(packs: DataFrame, replacements: DataFrame) -> DataFrame:
    """(source, path, content) of the pack files that have replacements(source, path, ordinal, start, end, syntax, pointer, format, replacement).

    A file that can't be read, or whose spans overlap, gives no row.
    """
    items = F.sort_array(F.collect_list(F.struct("ordinal", "start", "end", "syntax", "pointer", "format", "replacement"))).alias("items")
    joined = _beside(packs, replacements.groupBy("source", "path").agg(items), "source", "path")

    def fill(path: str, raw: bytes, rows) -> bytes:
        if path.endswith(".mcfunction"):
            return backfill.spans_file(raw.decode("utf-8"), [(int(r["start"]), int(r["end"]) + 1, r["replacement"], r["syntax"]) for r in rows]).encode("utf-8")
        new = [(r["pointer"], r["format"], r["replacement"]) for r in rows]
        if path.endswith(".json"):
            return njson.write(backfill.fill(njson.parse(raw.decode("utf-8"), njson.FILE), new, "json_obj")).encode("utf-8")
        return nbt.write_gzip(backfill.fill(nbt.read_gzip(raw), new, "nbt_obj"))

    return _rewritten(joined, fill)


def _rewritten(joined: DataFrame, fill: Callable) -> DataFrame:
    def run(path: str, content: bytes, rows) -> bytes | None:
        try:
            return fill(path, bytes(content), rows)
        except ValueError:
            return None

    return _filled(joined.select("source", "path", "content", "items"), run, "path", "content")


def _rewritten_packs(packs: DataFrame, items: DataFrame, picker: Callable, patterns: Patterns | None) -> DataFrame:
    catalog = patterns or builtin()

    def fill(path: str, raw: bytes, rows) -> bytes | None:
        pick = picker(rows)
        if path.endswith(".mcfunction"):
            text = raw.decode("utf-8")
            new = backfill.replaced_commands(text, extract.command_texts(text, catalog), pick)
            return None if new is None else new.encode("utf-8")
        if path.endswith(".json"):
            text = raw.decode("utf-8")
            tree = backfill.replaced_tree(njson.parse(text, njson.FILE), extract.json_texts(text, catalog), pick, "json_obj")
            return None if tree is None else njson.write(tree).encode("utf-8")
        tree = nbt.read_gzip(raw)
        tree = backfill.replaced_tree(tree, extract.nbt_texts(tree, catalog), pick, "nbt_obj")
        return None if tree is None else nbt.write_gzip(tree)

    return _rewritten(_beside(packs, items, "source", "path"), fill)


def translated_packs(packs: DataFrame, texts: DataFrame, mapping: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """(source, path, content) of the pack files with ``texts(source, path, content, ...)`` of them replaced by mapping(source, target).

    Spans of functions; texts, commands and nested structures of JSON and NBT. A file in which nothing changes, or that can't be read, gives no row.
    """
    items = _pairs(texts.withColumnRenamed("source", "pack"), mapping, "pack", "path").withColumnRenamed("pack", "source")
    return _rewritten_packs(packs, items, lambda rows: backfill.by_mapping({r["source"]: r["target"] for r in rows}), patterns)


def replaced_packs(packs: DataFrame, replacements: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """(source, path, content) of the pack files with replacements(source, path, ordinal, replacement): ordinals count a file's texts as pack_texts does."""
    items = replacements.where("replacement IS NOT NULL").groupBy("source", "path").agg(F.collect_list(F.struct("ordinal", "replacement")).alias("items"))
    return _rewritten_packs(packs, items, lambda rows: backfill.by_ordinal({int(r["ordinal"]): r["replacement"] for r in rows}), patterns)


def filled_archives(archives: DataFrame, filled: DataFrame) -> DataFrame:
    """(source, content): archives(source, content) with the filled files in place; all other entries are copied, folders go."""
    items = F.collect_list(F.struct("path", F.col("content").alias("data"))).alias("items")
    joined = _beside(archives.select("source", "content"), filled.groupBy("source").agg(items), "source")

    def run(content: bytes, rows) -> bytes:
        new, out = {r["path"]: bytes(r["data"]) for r in rows}, io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in old.infolist():
                if not info.is_dir():
                    z.writestr(info, new.get(info.filename, old.read(info)), zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return _filled(joined, run, "content")


def write_files(rows: DataFrame, root: str) -> int:
    """Write (path, content) rows below a folder that all executors reach by Arrow's file systems; the number of files. Rewriting a file is safe to repeat."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                if posixpath.normpath(path) != path or path.startswith(("/", "../")) or path == "..":
                    raise ValueError(f"{path} leads out of the folder")
                _put(store, f"{base}/{path}", [bytes(content)])
            yield part[["path"]]

    return rows.select("path", "content").mapInPandas(run, "path string").count()
