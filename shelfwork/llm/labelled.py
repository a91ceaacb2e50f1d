"""Bounded samples of labelled documents, and logistic curves fitted to scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, hash_sample, in_text_batches, stored, text_digest

#: Labelled texts that a classifier is fitted on, at most.
SAMPLE_ROWS = 20_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, key: str = "doc_id", text: str = "text",
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(key, text, label) of at most ``rows`` different labelled texts, the same ones each time.

    Rows whose crc32 of the key modulo ``modulus`` is ``held_out`` are not looked
    at; nor are null keys, null labels, and keys or texts whose labels contradict
    each other. Copies count once, under their smallest key. Of the rest those with
    the lowest hashes of the text are taken, about SAMPLE_BYTES of them at most.
    """
    usable = F.col("key").isNotNull() & (bucket(F.col("key"), modulus) != held_out)
    known = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")).filter(usable & F.col("label").isNotNull())
        .groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    )
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(usable)
    ids = texts.select("key", text_digest("text").alias("digest"), F.octet_length("text").alias("size")).distinct()
    pool = (
        ids.join(known, "key").groupBy("digest")
        .agg(F.min("key").alias("key"), F.min("label").alias("label"), F.max("label").alias("most"), F.max("size").alias("size"))
        .filter("label = most").select("digest", "key", "label", "size")
    )
    # bounded, so that the join below may broadcast it
    taken = stored(hash_sample(stored(pool, "labelled"), "digest", rows, size="size"), "labelled-sample").drop("size")
    found = texts.join(F.broadcast(taken), "key").filter(text_digest("text") == F.col("digest"))
    return found.dropDuplicates(["digest"]).select("key", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (bias first) of a logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    held = np.full(len(w), ridge)
    held[0] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (p - y) + held * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def with_scores(docs: DataFrame, one, text: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with the double column ``score`` that ``one`` makes of texts."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    if text not in names:
        rows = docs.select(*[F.col(f"`{c}`") for c in names], text)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(one(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], scores], [*names, "score"])

    schema = rows.select(*[F.col(f"`{c}`") for c in names]).schema.add("score", "double")
    return in_text_batches(rows).mapInArrow(run, schema)
