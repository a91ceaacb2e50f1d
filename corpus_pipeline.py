"""A corpus pipeline: five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and hands what it reads back to the next stage.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwork.llm import bpe, decontaminate, quality, simhash, toxicity
from shelfwork.llm.common import small, stored, table, text_digest

#: SQL cannot state the classifiers and the tokens; the stages are tested against plain Python.
ORACLE_SQL = None


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them if there are no labels.

    Decided row by row on the whole text, long ones too: null and empty texts have
    the score of the bias alone, repeated rows share their fate, an empty table
    stays empty. Other columns pass through, whatever their names.
    """
    scored = quality.score(docs, quality.trained(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col("score") >= quality.ACCEPT).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not flag; all of them if there are no labels.

    Nulls, empty and very long texts, repeated rows, empty tables and other columns
    as in the stage before; a null or empty text is one empty window.
    """
    scored = toxicity.score(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col("score") < toxicity.ACCEPT).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that SimHash links at up to two bits of three-word shingles, the one with the smallest id.

    Groups are of rows: repeated rows and rows with null ids lose all but one too
    (a null id stays only if its group has no other). Null and empty texts are one
    group; long texts count whole; an empty table stays empty.
    """
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in passages of the benchmark.

    Decided by the text, whatever the ids: equal texts go together, null and empty
    ones stay, as all do if the benchmark is empty.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter(decontaminate.is_contaminated())
    gone = small(stored(found.select("digest").distinct(), "contaminated-texts"))
    return docs.join(gone, text_digest("text") == gone["digest"], "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document that is left, and the digests of what they decode to.

    A row each, in whole texts; null texts are empty and have no tokens.
    """
    return bpe.encode(docs, bpe.multilingual()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", drop_poor), ("toxicity", drop_toxic), ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated), ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
