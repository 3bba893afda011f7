"""A translation project: update, translate and build a world, as DataFrame steps over its tables."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import mapping as m
from glyphmill.operators import pool as p
from glyphmill.operators import translation as t
from glyphmill.operators.model import Model, Settings
from glyphmill.parse import rules
from glyphmill.plans.catalog import builtin
from glyphmill.plans.patterns import CommandPattern, Patterns, PointerPattern, RegexPattern, read_patterns
from glyphmill.sources import world

#: In a project's folder: texts to translate, results so far, terms.
TODO, DONE, TERMS = "todo", "done", "terms.json"


@dataclass
class Project:
    root: str
    patterns: Patterns = field(default_factory=builtin)
    book: rules.RuleBook = field(default_factory=rules.RuleBook)
    terms: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def read(path: str) -> Project:
        """From a TOML file with ``root``, ``terms``, ``rules`` (a rule book beside it) and ``patterns`` (files beside it, by kind); unknown names are ignored.

        Patterns of a project take the place of the builtin ones of their kind. Terms learnt by the terms step are added.
        """
        with open(path, "rb") as f:
            raw = tomllib.load(f)
        beside = Path(path).parent
        kinds = {"command": CommandPattern, "nbt": PointerPattern, "mcjson": PointerPattern, "data": PointerPattern, "regexes": RegexPattern}
        own = {k: read_patterns(str(beside / v), kinds[k]) for k, v in raw.get("patterns", {}).items() if k in kinds}
        patterns = builtin().with_custom("replace", **own) if own else builtin()
        book = rules.RuleBook.read((beside / raw["rules"]).read_text(encoding="utf-8")) if "rules" in raw else rules.RuleBook()
        learnt = beside / TERMS
        terms = json.loads(learnt.read_text(encoding="utf-8")) if learnt.exists() else {}
        return Project(raw["root"], patterns, book, terms | raw.get("terms", {}))

    def write(self, folder: str) -> None:
        """A new project's file; FileExistsError if there is one."""
        Path(folder).mkdir(parents=True, exist_ok=True)
        with open(Path(folder, "project.toml"), "x", encoding="utf-8") as f:
            f.write(f"root = {json.dumps(self.root)}\n\n[terms]\n" + "".join(f"{json.dumps(k)} = {json.dumps(v)}\n" for k, v in self.terms.items()))

    def _mapping(self, spark: SparkSession, folder: str) -> DataFrame:
        """(source, target) of what the folder has: translated texts, and those not to be translated with a null target."""
        schema = "format string, source string, target string, status string"
        if not world.exists(spark, f"{folder}/{DONE}"):
            return spark.createDataFrame([], "source string, target string")
        return t.exported(spark.read.schema(schema).parquet(f"{folder}/{DONE}")).groupBy("source").agg(F.max("target").alias("target"))

    def update(self, spark: SparkSession, folder: str) -> int:
        """Read the world anew and write the texts to translate; how many. Texts that rules translate or that are done are left out."""
        pool = self.missing(spark, self._mapping(spark, folder))
        ruled = t.by_rules(pool.select("text").distinct(), self.book).where("target IS NOT NULL").select(F.col("source").alias("text"))
        pool.join(ruled, "text", "left_anti").select("format", "text").write.mode("overwrite").parquet(f"{folder}/{TODO}")
        return spark.read.parquet(f"{folder}/{TODO}").count()

    def learn_terms(self, spark: SparkSession, folder: str, model: Model, settings: Settings) -> int:
        """Terms that the model names for the texts to translate, into the project's terms; how many there are. Terms belong to a project and are few."""
        found = t.terms_of(spark.read.parquet(f"{folder}/{TODO}").select("text").distinct(), model, self.terms, settings.budget, settings)
        self.terms = {r.term: r.meaning for r in found.collect()}
        Path(folder, TERMS).write_text(json.dumps(self.terms, ensure_ascii=False, indent=2), encoding="utf-8")
        return len(self.terms)

    def translate_missing(self, spark: SparkSession, folder: str, model: Model, settings: Settings) -> int:
        """Translate the texts to translate, chunk after chunk, into the folder; how many are done. What a failed run has done counts for the next."""
        self.terms = t.translate_to(spark.read.parquet(f"{folder}/{TODO}"), model, f"{folder}/{DONE}", settings)
        Path(folder, TERMS).write_text(json.dumps(self.terms, ensure_ascii=False, indent=2), encoding="utf-8")
        return self._mapping(spark, folder).count()

    def build_from(self, spark: SparkSession, folder: str, target: str) -> int:
        """As build, with the folder's translations."""
        return self.build(spark, self._mapping(spark, folder), target)

    def replaced(self, spark: SparkSession, replacements: DataFrame, kind: str, target: str) -> int:
        """A copy of the world with the rows of replacement groups of a kind (region or datapack) in it; the number of files rewritten."""
        rows = replacements.where("replacement IS NOT NULL")
        if kind == "datapack":
            return self.copied(spark, target, packs=world.replaced_packs(world.pack_files(spark, self.root), rows, self.patterns))
        regions = world.regions(spark, self.root)
        placed = rows.join(regions.select("path", "dimension", "kind", "x", "z"), ["dimension", "kind", "x", "z"])
        return self.copied(spark, target, regions=world.replaced_regions(regions, placed, self.patterns))

    def texts(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Texts of regions and of packs."""
        world.data_version(spark, self.root)
        return world.region_texts(world.regions(spark, self.root), self.patterns), world.pack_texts(world.pack_files(spark, self.root), self.patterns)

    def missing(self, spark: SparkSession, mapping: DataFrame) -> DataFrame:
        """(format, text) that the mapping doesn't have yet."""
        both = [x.where("error IS NULL").select("format", F.col("content").alias("text")) for x in self.texts(spark)]
        known = mapping.select("source").join(both[0].unionByName(both[1]).select("format", F.col("text").alias("source")).distinct(), "source")
        return p.to_translate(both[0].unionByName(both[1]), known)

    def translated(self, spark: SparkSession, mapping: DataFrame, model: Callable[[str], str]) -> DataFrame:
        """The mapping with what the model gives for missing texts."""
        return m.merged(mapping, t.exported(t.translate(self.missing(spark, mapping), model, self.terms)))

    def build(self, spark: SparkSession, mapping: DataFrame, target: str) -> int:
        """A copy of the world below ``target`` with all translations in; rules go before the mapping. The number of files rewritten."""
        region_texts, pack_texts = (x.where("error IS NULL") for x in self.texts(spark))
        pool = p.text_pool(region_texts).unionByName(p.text_pool(pack_texts)).distinct()
        full = m.merged(mapping, t.by_rules(pool, self.book).where("target IS NOT NULL"))
        regions = world.translated_regions(world.regions(spark, self.root), region_texts, full, self.patterns)
        return self.copied(spark, target, regions, world.translated_packs(world.pack_files(spark, self.root), pack_texts, full, self.patterns))

    def copied(self, spark: SparkSession, target: str, regions: DataFrame | None = None, packs: DataFrame | None = None) -> int:
        """A copy of the world with regions(path, content) and pack files(source, path, content) in place of its own; how many of them."""
        world.copy_folder(spark, self.root, target)
        n = 0 if regions is None else world.write_files(regions, target)
        if packs is None:
            return n
        packs = packs.persist()
        zipped = F.col("source").endswith(".zip")
        n += world.write_files(packs.where(~zipped).select(F.concat(F.lit("datapacks/"), "source", F.lit("/"), "path").alias("path"), "content"), target)
        archives = world.files(spark, self.root, "*.zip", "datapacks").where(F.col("path").rlike("^datapacks/[^/]*$")).select(F.substring_index("path", "/", -1).alias("source"), "content")
        n += world.write_files(world.filled_archives(archives, packs.where(zipped)).select(F.concat(F.lit("datapacks/"), "source").alias("path"), "content"), target)
        packs.unpersist()
        return n
