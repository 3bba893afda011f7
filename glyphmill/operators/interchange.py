"""Extraction groups as nested records, for JSON files that people and other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTRACTION = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("outer_pointer", T.StringType()),
        T.StructField("inner_pointer", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("syntax", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("replacement", T.StringType()),
    ]
)
REGION_GROUP = T.StructType([T.StructField("type", T.StringType()), T.StructField("dimension", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("x", T.IntegerType()), T.StructField("z", T.IntegerType()), T.StructField("extractions", T.ArrayType(EXTRACTION))])
PACK_GROUP = T.StructType([T.StructField("type", T.StringType()), T.StructField("source", T.StringType()), T.StructField("path", T.StringType()), T.StructField("extractions", T.ArrayType(EXTRACTION))])
_KEYS = {"region": ["dimension", "kind", "x", "z"], "datapack": ["source", "path"]}


def to_groups(leaves: DataFrame, kind: str) -> DataFrame:
    """One record per region or pack file, its extractions in order; a file's texts are few, so its list is bounded by the file."""
    names = [f.name for f in EXTRACTION.fields]
    one = F.struct(*((F.col(n) if n in leaves.columns else F.lit(None)).cast(EXTRACTION[n].dataType).alias(n) for n in names))
    first = F.struct(F.coalesce(one["chunk_index"], F.lit(0)).alias("c"), F.col("ordinal").alias("o"), one.alias("x"))
    grouped = leaves.groupBy(*_KEYS[kind]).agg(F.transform(F.sort_array(F.collect_list(first)), lambda s: s["x"]).alias("extractions"))
    return grouped.select(F.lit(kind).alias("type"), *_KEYS[kind], "extractions")


def from_groups(groups: DataFrame, kind: str) -> DataFrame:
    """The rows of such records again."""
    return groups.where(F.col("type") == kind).select(*_KEYS[kind], F.explode("extractions").alias("e")).select(*_KEYS[kind], "e.*")


def write_groups(groups: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_groups(spark, path: str, kind: str) -> DataFrame:
    """Unknown fields are ignored, comments allowed."""
    schema = REGION_GROUP if kind == "region" else PACK_GROUP
    return spark.read.schema(schema).option("allowComments", "true").json(path)


def parsed_groups(frame: DataFrame, text: str, kind: str) -> DataFrame:
    """Groups of a column of JSON texts (one group or an array of them) with comments and trailing commas; unknown fields are ignored.

    A text that doesn't parse gives no group.
    """
    from glyphmill.functions.udfs import scalar
    from glyphmill.parse import njson

    def plain(value: str) -> str | None:
        try:
            tree = njson.parse(value, njson.FILE)
        except njson.JsonError:
            return None
        return njson.write(tree if isinstance(tree, list) else [tree])

    schema = T.ArrayType(REGION_GROUP if kind == "region" else PACK_GROUP)
    return frame.select(F.explode(F.from_json(scalar(plain, "string", text), schema)).alias("g")).select("g.*")


def by_type(groups: DataFrame, *types: str) -> dict[str, DataFrame]:
    """The rows of each type."""
    return {t: groups.where(F.col("type") == t) for t in types}


def unpooled(groups: DataFrame, mapping: DataFrame, kind: str) -> DataFrame:
    """Replacement groups: the groups' texts that mapping(source, target) has a target for, with it."""
    from glyphmill.operators.mapping import lookup

    return to_groups(lookup(from_groups(groups, kind).drop("replacement"), mapping), kind)


def replaced_by(groups: DataFrame, text: str, kind: str) -> DataFrame:
    """Replacement groups with one text for all."""
    from glyphmill.operators.mapping import replace_all

    return to_groups(replace_all(from_groups(groups, kind), text), kind)
