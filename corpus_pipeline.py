"""Corpus pipeline: five stages over the documents, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and reread as
the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.mixing import mix_sources
from glyphmill.llm.ngram_join import similar_groups
from glyphmill.llm.secrets_scan import redact
from glyphmill.llm.sentencepiece_tok import encoded, load_model
from glyphmill.llm.shared import Workspace
from glyphmill.llm.toxicity import train, with_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below 0.5; it learns from the labels of the documents here.

    Null and empty texts are scored as empty ones; repeated rows and rows without a doc_id are scored each;
    all columns stay, whatever their names. An empty table, or one without labels, gives what it has.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return with_scores(rows, model).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id.

    Rows without a doc_id stay; of rows that share the smallest doc_id, all stay. Null and empty texts, and
    texts without words, are like no other and stay. All columns stay; an empty table gives an empty one.
    """
    groups = similar_groups(docs, n=5, p=4, q=5)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars is that of the new text.

    Null texts stay null. Rows stand alone, so repeated ones and those without a doc_id stay; all columns do.
    """
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null text has size 0, a null source is a source. Rows that share a doc_id, or have none, are drawn
    alike. All columns stay; an empty table gives an empty one.
    """
    return mix_sources(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether decoding the ids gives the text back.

    A row for every row, also repeated ones; a null text has no tokens and counts as ''. Other columns go.
    """
    done = encoded(docs, load_model(), keep=["doc_id", "source", "text"])
    return done.select("doc_id", "source", "n_tokens", "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: The stages that learn or draw can't be put in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a table in the shared folder between each two."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.save(docs, str(i))
    return docs
