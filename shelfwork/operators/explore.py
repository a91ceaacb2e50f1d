"""Exploratory reports on classes, gaps, lengths and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def class_shares(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Classes, average size, most and least common class (ties by name), ratio."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("classes"),
        F.avg("n").alias("average"),
        F.max(F.struct("n", label))[label].alias("most_common"),
        F.max("n").alias("most"),
        F.min(F.struct("n", label))[label].alias("least_common"),
        F.min("n").alias("least"),
        (F.max("n") / F.min("n")).alias("ratio"),
    )


def missing_by_class(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
    def missing(c):
        return F.avg(F.when(F.col(c).isNull(), 100.0).otherwise(0.0))

    return df.groupBy(label).agg(
        missing(first).alias("first_missing"), missing(second).alias("second_missing"), F.count("*").alias("n")
    )


def missing_overall(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: missing rows and share."""
    gaps = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = gaps.unpivot("rows", columns, "column", "missing")
    return long.select("column", "missing", (F.col("missing") * 100.0 / F.col("rows")).alias("percent"))


def average_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = []
    for c in columns:
        filled = F.coalesce(F.col(c), F.lit(""))
        aggs += [
            F.avg(T.char_count(c)).alias(f"{c}_chars"),
            F.avg(T.word_count_white(filled)).alias(f"{c}_words"),
        ]
    return df.agg(*aggs)


def top_with_others(df: DataFrame, label: str, n: int, others: str = "Others") -> DataFrame:
    """The n largest classes and one bucket for the rest."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.orderBy(F.desc("n"), label))  # one row per class
    named = counts.withColumn(label, F.when(rank <= n, F.col(label)).otherwise(F.lit(others)))
    grouped = named.groupBy(label).agg(F.sum("n").alias("n"))
    return grouped.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def repeated_rows(df: DataFrame, value: str) -> DataFrame:
    """Rows that repeat a value: count(*) minus distinct values."""
    digest = F.sha2(F.col(value).cast("string"), 256).alias("digest")
    counts = df.select(digest).groupBy("digest").agg(F.count("*").alias("n"))
    return counts.agg(F.sum(F.col("n") - 1).alias("repeated"))
