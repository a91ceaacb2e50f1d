"""Label codes, ids and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scale import join_dim


def label_map(df: DataFrame, label: str, order: str = "numeric") -> DataFrame:
    """Ids 0..K-1 for the codes, in numeric or in text order."""
    if order not in ("numeric", "text"):
        raise ValueError("order is 'numeric' or 'text'")
    codes = df.select(F.col(label).alias("code")).where(F.col(label).isNotNull()).distinct()
    by = F.col("code") if order == "numeric" else F.col("code").cast("string")
    return codes.select("code", (F.row_number().over(W.orderBy(by)) - 1).alias("label_id"))  # one row per class


def encode(df: DataFrame, label: str, mapping: DataFrame, out: str = "label_id", unseen: str = "unseen_label") -> DataFrame:
    """Add the id of the label and a flag for labels the mapping does not know."""
    dim = mapping.select(F.col("code").alias(label), F.col("label_id").alias(out))
    joined = join_dim(df, dim, [label], "left")
    return joined.withColumn(unseen, F.col(out).isNull())


def decode(df: DataFrame, label_id: str, mapping: DataFrame, out: str = "code") -> DataFrame:
    """Add the original code of an id."""
    dim = mapping.select(F.col("label_id").alias(label_id), F.col("code").alias(out))
    return join_dim(df, dim, [label_id], "left")


def between_orders(df: DataFrame, label: str) -> DataFrame:
    """Ids of the same code in numeric and in text order."""
    numeric = label_map(df, label, "numeric").withColumnRenamed("label_id", "numeric_id")
    text = label_map(df, label, "text").withColumnRenamed("label_id", "text_id")
    return numeric.join(text, "code")


def one_hot(label_id: str | Column, classes: int) -> Column:
    label_id = F.col(label_id) if isinstance(label_id, str) else label_id
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label_id).cast("int"))


def argmax(values: str | Column) -> Column:
    """0-based position of the first largest value."""
    values = F.col(values) if isinstance(values, str) else values
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
