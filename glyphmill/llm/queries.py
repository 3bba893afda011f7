"""The ``opN_<name>`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import mixing


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.tiff import media_digests, text_media

    return media_digests(text_media(_documents(spark, sf_dir)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.ngram_join import similar_groups

    return similar_groups(_documents(spark, sf_dir), n=4, p=85, q=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.toxicity import toxicity_scores

    return toxicity_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.substring_dedup import cut_repeats

    return cut_repeats(_documents(spark, sf_dir)).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.licenses import license_scan

    return license_scan(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.quality import quality_scores

    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.iblt import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.sentencepiece_tok import load_model, token_digests

    return token_digests(_documents(spark, sf_dir), load_model())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.secrets_scan import secret_spans

    return secret_spans(_documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.mixing import with_copies

    mixed = with_copies(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiff_media": op1_tiff_media,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_quality": op6_quality,
    "op7_iblt_fingerprints": op7_iblt_fingerprints,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secret_scan": op9_secret_scan,
    "op10_mix_sources": op10_mix_sources,
}

#: DuckDB SQL of those that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {"op10_mix_sources": mixing.ORACLE}
