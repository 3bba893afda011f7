"""Command line: python -m glyphmill.cli COMMAND ... on a Spark session of the environment."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("glyphmill").getOrCreate()


def _patterns(args):
    from glyphmill.plans.catalog import builtin
    from glyphmill.plans.patterns import CommandPattern, PointerPattern, RegexPattern, read_patterns

    out = builtin()
    own = {}
    for name, kind in (("command", CommandPattern), ("nbt", PointerPattern), ("mcjson", PointerPattern), ("data", PointerPattern), ("regexes", RegexPattern)):
        if path := getattr(args, f"{name}_patterns", None):
            own[name] = read_patterns(path, kind)
    out = out.with_custom(args.pattern_mode, **own)
    off = {n: None for n in ("nbt", "mcjson", "data") if getattr(args, f"disable_{n}_filter", False)}
    return out.with_custom("replace", **off) if off else out


def _pattern_options(p: argparse.ArgumentParser) -> None:
    for name in ("command", "nbt", "mcjson", "data", "regexes"):
        p.add_argument(f"--{name}-patterns")
    for name in ("nbt", "mcjson", "data"):
        p.add_argument(f"--disable-{name}-filter", action="store_true")
    p.add_argument("--pattern-mode", choices=["append", "replace"], default="append")


def _model_options(p: argparse.ArgumentParser, required: bool = True) -> None:
    p.add_argument("--model", required=required, help="module:function that answers a message")
    p.add_argument("--budget", type=int, default=2048)
    p.add_argument("--retries", type=int, default=20)
    p.add_argument("--source", default="en_us")
    p.add_argument("--target", default="zh_cn")
    p.add_argument("--style", default="")
    p.add_argument("--about", default="")


def _settings(args, terms: dict[str, str]):
    from glyphmill.operators.model import Settings

    return Settings(args.model or "", source=args.source, target=args.target, style=args.style, about=args.about, budget=args.budget, retries=args.retries, terms=terms)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for what in ("region", "datapack"):
        x = sub.add_parser(f"{what}-extract", help=f"texts of a world's {what} files as JSON groups")
        x.add_argument("world")
        x.add_argument("output")
        _pattern_options(x)
    x = sub.add_parser("build", help="a copy of a world with the texts of a mapping (JSON object) in it")
    for name in ("world", "mapping", "output"):
        x.add_argument(name)
    x.add_argument("--rules")
    _pattern_options(x)
    x = sub.add_parser("pool", help="distinct texts of extraction groups")
    x.add_argument("groups")
    x.add_argument("output")
    x.add_argument("--kind", choices=["region", "datapack"], required=True)
    x.add_argument("--simply", action="store_true")
    for what in ("region", "datapack"):
        x = sub.add_parser(f"{what}-backfill", help=f"a copy of a world with the texts of {what} replacement groups in it")
        for name in ("world", "groups", "output"):
            x.add_argument(name)
        _pattern_options(x)
    x = sub.add_parser("unpool", help="replacement groups: extraction groups with the texts of a mapping (JSON object)")
    for name in ("groups", "mapping", "output"):
        x.add_argument(name)
    x.add_argument("--kind", choices=["region", "datapack"], required=True)
    x = sub.add_parser("replace-all", help="replacement groups with one text for all")
    for name in ("groups", "output"):
        x.add_argument(name)
    x.add_argument("--text", default='"TEXT"')
    x.add_argument("--kind", choices=["region", "datapack"], required=True)
    for what, about in (("translate", "a pool (JSON lines of text, format) through a model, chunk after chunk"), ("terms", "the terms that a model names for a pool")):
        x = sub.add_parser(what, help=about)
        for name in ("pool", "output"):
            x.add_argument(name)
        x.add_argument("--terms", help="a JSON object of terms")
        _model_options(x)
    x = sub.add_parser("languages", help="download a version's language files")
    x.add_argument("output")
    x.add_argument("names", nargs="*")
    x.add_argument("--version", default="latest")
    x = sub.add_parser("project", help="a translation project in a folder")
    x.add_argument("step", choices=["init", "update", "terms", "translate", "build"])
    x.add_argument("folder")
    x.add_argument("--world", help="for init")
    x.add_argument("--output", help="for build")
    _model_options(x, False)
    x = sub.add_parser("rules-translate", help="a pool (JSON array) through a rule book")
    for name in ("pool", "rules", "output"):
        x.add_argument(name)
    x = sub.add_parser("rules-template", help="a rule book to fill in, of a pool (JSON array)")
    for name in ("pool", "output"):
        x.add_argument(name)
    x = sub.add_parser("combine-languages", help="texts of one language file to those of another")
    for name in ("source", "target", "output"):
        x.add_argument(name)
    x = sub.add_parser("snbt", help="readable dumps of a world's regions")
    x.add_argument("world")
    x.add_argument("output")
    x = sub.add_parser("schema", help="JSON Schema of a pattern file")
    x.add_argument("what", choices=["command", "data_pointer", "command_regex"])
    x = sub.add_parser("test-pointer", help="which builtin catalogs a pointer matches")
    x.add_argument("pointer")
    x = sub.add_parser("test-command", help="the texts of a command line")
    x.add_argument("line")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    read = lambda path: json.loads(Path(path).read_text(encoding="utf-8"))
    if args.command in ("region-extract", "datapack-extract"):
        from glyphmill.operators import interchange
        from glyphmill.plans.project import Project

        kind = args.command.split("-")[0]
        texts = Project(args.world, _patterns(args)).texts(_spark())[kind == "datapack"]
        interchange.write_groups(interchange.to_groups(texts.where("error IS NULL"), kind), args.output)
    elif args.command == "build":
        from glyphmill.parse.rules import RuleBook
        from glyphmill.plans.project import Project

        book = RuleBook.read(Path(args.rules).read_text(encoding="utf-8")) if args.rules else RuleBook()
        spark = _spark()
        mapping = spark.createDataFrame(list(read(args.mapping).items()), "source string, target string")
        print(Project(args.world, _patterns(args), book).build(spark, mapping, args.output), "files rewritten")
    elif args.command == "pool":
        from glyphmill.operators import interchange, pool

        leaves = interchange.from_groups(interchange.read_groups(_spark(), args.groups, args.kind), args.kind)
        pool.text_pool(pool.simplified(leaves) if args.simply else leaves).write.mode("overwrite").json(args.output)
    elif args.command in ("region-backfill", "datapack-backfill"):
        from glyphmill.operators import interchange
        from glyphmill.plans.project import Project

        kind, spark = args.command.split("-")[0], _spark()
        rows = interchange.from_groups(interchange.read_groups(spark, args.groups, kind), kind)
        print(Project(args.world, _patterns(args)).replaced(spark, rows, kind, args.output), "files rewritten")
    elif args.command in ("unpool", "replace-all"):
        from glyphmill.operators import interchange

        spark = _spark()
        groups = interchange.read_groups(spark, args.groups, args.kind)
        if args.command == "unpool":
            mapping = spark.createDataFrame(list(read(args.mapping).items()), "source string, target string")
            interchange.write_groups(interchange.unpooled(groups, mapping, args.kind), args.output)
        else:
            interchange.write_groups(interchange.replaced_by(groups, args.text, args.kind), args.output)
    elif args.command in ("translate", "terms"):
        from glyphmill.operators import model, translation

        given = read(args.terms) if args.terms else {}
        pool, own = _spark().read.schema("format string, text string").json(args.pool).fillna("plain_str", ["format"]), _settings(args, given)
        if args.command == "terms":
            translation.terms_of(pool, model.named(args.model), given, args.budget, own).write.mode("overwrite").json(args.output)
        else:
            translation.translate_to(pool, model.named(args.model), args.output, own)
    elif args.command == "languages":
        from glyphmill.sources.languages import language_files

        Path(args.output).mkdir(parents=True, exist_ok=True)
        for name, texts in language_files(args.version, args.names or None):
            Path(args.output, f"{name}.json").write_text(json.dumps(texts, ensure_ascii=False), encoding="utf-8")
    elif args.command == "project":
        from glyphmill.operators import model
        from glyphmill.plans.project import Project

        if args.step == "init":
            Project(args.world).write(args.folder)
            return 0
        spark, own = _spark(), Project.read(str(Path(args.folder, "project.toml")))
        if args.step == "build":
            print(own.build_from(spark, args.folder, args.output), "files rewritten")
        elif args.step == "update":
            print(own.update(spark, args.folder), "texts to translate")
        else:
            step = own.learn_terms if args.step == "terms" else own.translate_missing
            print(step(spark, args.folder, model.named(args.model), _settings(args, own.terms)), "texts" if args.step == "translate" else "terms")
    elif args.command in ("rules-translate", "rules-template"):
        from glyphmill.operators.translation import by_rules
        from glyphmill.parse import rules

        texts = read(args.pool)
        if args.command == "rules-template":
            Path(args.output).write_text(rules.template(texts).write(), encoding="utf-8")
        else:
            book = rules.RuleBook.read(Path(args.rules).read_text(encoding="utf-8"))
            by_rules(_spark().createDataFrame([(t,) for t in texts], "text string"), book).write.mode("overwrite").option("ignoreNullFields", "false").json(args.output)
    elif args.command == "combine-languages":
        from glyphmill.operators.mapping import language_pairs

        spark = _spark()
        one, two = (spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(read(p).items())], "ord long, key string, value string") for p in (args.source, args.target))
        language_pairs(one, two).write.mode("overwrite").json(args.output)
    elif args.command == "snbt":
        from pyspark.sql import functions as F

        from glyphmill.sources import world

        dumps = world.region_dump(world.regions(_spark(), args.world))
        world.write_files(dumps.select(F.concat("path", F.lit(".txt")).alias("path"), F.encode("dump", "UTF-8").alias("content")), args.output)
    elif args.command == "schema":
        from glyphmill.plans.patterns import json_schema

        print(json_schema(args.what))
    elif args.command == "test-pointer":
        from glyphmill.plans import catalog
        from glyphmill.plans.patterns import first_match

        for name, patterns in (("nbt", catalog.NBT), ("mcjson", catalog.MCJSON), ("command data", catalog.DATA)):
            found = first_match(patterns, args.pointer)
            print(f"{name}: {found.to_json() if found else 'no match'}")
    else:
        from glyphmill.parse.extract import command_texts
        from glyphmill.plans.catalog import builtin

        for s in command_texts(args.line, builtin()):
            print(f"{s.start}..{s.end - 1} {s.format} {s.syntax or '-'} {s.content}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
