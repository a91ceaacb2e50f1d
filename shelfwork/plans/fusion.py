"""The training table of a catalogue, from raw rows to label ids and model text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import balance as B
from ..operators import columns as C
from ..operators import labels as N


def training_table(
    rows: DataFrame,
    key: str,
    label: str,
    text: str,
    dedupe_after_clean: bool = False,
    across_splits: bool = False,
) -> DataFrame:
    """Nested stratified split, repeated texts out per split, model text, label ids.

    Repeats are removed before cleaning and per split; the two options remove
    them after cleaning and across splits instead.
    """
    parts = B.nested_split(rows, label, key)
    scope = () if across_splits else ("split",)
    cleaned = T.model_text(text)
    if dedupe_after_clean:
        kept = C.drop_repeats(parts.withColumn(text, cleaned), text, key, scope)
    else:
        kept = C.drop_repeats(parts, text, key, scope).withColumn(text, cleaned)
    return N.encode(kept, label, N.label_map(_train_labels(parts, key, label, text, scope, dedupe_after_clean), label))


def _train_labels(parts, key, label, text, scope, cleaned) -> DataFrame:
    """Labels of the train rows that survive; texts are shuffled as digests only."""
    value = T.model_text(text) if cleaned else F.col(text)
    narrow = parts.na.drop("any").where(F.col(text) != ";").select(
        "split", key, label, F.sha2(value, 256).alias(text)
    )
    return C.keep_first(narrow, text, key, scope).where("split = 'train'")


def save_splits(training: DataFrame, path: str) -> None:
    """One Parquet table, one folder per split."""
    training.write.mode("overwrite").partitionBy("split").parquet(path)


def load_splits(spark, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(df["split"] == split)
