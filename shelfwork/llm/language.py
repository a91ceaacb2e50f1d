"""Language by averaged hashed subword embeddings and a linear softmax, trained in numpy.

Subwords are the runs of two to four bytes of a lower-case word with its two
borders. A text is the average of its subwords' embeddings; a softmax over linear
scores gives the languages. Training is stochastic gradient descent, in shards.
As both layers are linear, a model becomes one table of a score for each subword
and language, and the shards' tables are averaged. A threshold on the probability,
set on documents kept from training, says which answers to reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, chunks, in_text_batches, lowered, mix, owners, powers, query, runs, stored, table, text_sample

MODULUS, HELD_OUT = 3, 1
BITS, SIZES, WIDTH = 16, (2, 3, 4), 16
SHARDS, EPOCHS, RATE = 4, 5, 0.5
#: Labelled rows for training, and the share of right answers that the threshold lets pass.
SAMPLE_ROWS, KEPT = 8_000, 0.99
UNKNOWN = "und"

_letter = np.zeros(256, bool)
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _letter[_a:_b] = True


def subwords(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each subword; a word's borders count as a byte."""
    starts, ends = runs(_letter[data], at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length + 1)))  # a zero byte stands before each word, and at the end
    line = np.zeros(first[-1] + 1, np.uint64)
    place = np.arange(length.sum()) + np.repeat(np.arange(1, len(starts) + 1), length)
    line[place] = lowered(data)[_letter[data]].astype(np.uint64)
    border = np.zeros(len(line), bool)
    border[first] = True
    of = np.repeat(owners(starts, at), length + 1)
    crossed = np.concatenate(([0], np.cumsum(border)))
    up, _ = powers(8)
    texts, found = [], []
    for size in SIZES:
        n = len(line) - size + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h += (line[i : i + n] + np.uint64(1)) * up[i + 1]
        # no border inside, at the two ends only
        whole = crossed[size - 1 : size - 1 + n] == crossed[1 : 1 + n]
        where = np.flatnonzero(whole)
        texts.append(of[np.minimum(where, len(of) - 1)])
        found.append((mix(h[where] + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(found)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    threshold: float = 0.0


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def descend(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Scores and bias after gradient descent over (buckets, shares, class)."""
    start = np.random.default_rng(1)  # the same start in all shards
    inner = start.uniform(-1, 1, (1 << bits, WIDTH)) / WIDTH
    outer, bias = start.uniform(-1, 1, (WIDTH, classes)) / WIDTH, np.zeros(classes)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for index, share, label in rows:
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ inner[index]
            g = softmax(hidden @ outer + bias)
            g[label] -= 1
            back = outer @ g
            outer -= rate * np.outer(hidden, g)
            bias -= rate * 0.1 * g
            inner[index] -= (rate * len(index) ** 0.5) * share[:, None] * back
    return inner @ outer, bias


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``rows`` different texts of ``docs`` outside the held-out rows; None without any.

    Copies in one language count once; of the rest those with the lowest hashes of
    text and language are taken. The driver gets SHARDS tables of 2**BITS scores a language.
    """
    known = docs.filter(bucket(F.col(key), MODULUS) != HELD_OUT)
    known = known.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # as many as there are languages
    if not languages:
        return None
    sample = text_sample(known, "text", rows, ("lang",)).withColumn("key", F.xxhash64("digest", "lang"))
    sample = sample.select("key", "text", "lang", F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(5 * SHARDS)).alias("part"))
    sample = stored(sample, "language-sample")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunks(batch.column(0)):
                of, index = subwords(data, at)
                cells, count = np.unique(of << BITS | index, return_counts=True)
                cuts = np.searchsorted(cells >> BITS, np.arange(j - i + 1))
                parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(cells[p] & ((1 << BITS) - 1)).astype(np.int32) for p in parts], pa.list_(pa.int32())),
                        pa.array([count[p].astype(np.float32) for p in parts], pa.list_(pa.float32())),
                        *[batch.column(c).slice(i, j - i) for c in (1, 2, 3)],
                    ],
                    ["index", "count", "lang", "order", "shard"],
                )

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [
            (index, count / count.sum(), languages.index(language))
            for index, count, language in zip(*[pdf.sort_values(["order", "lang"])[c] for c in ("index", "count", "lang")], strict=True)
            if len(index)
        ]
        scores, bias = descend(own, len(languages)) if own else (np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)))
        return pd.DataFrame({"scores": [scores.astype(np.float32).tobytes()], "bias": [bias.tolist()]})

    found = (
        in_text_batches(sample).filter(f"part < {4 * SHARDS}")
        .select("text", "lang", F.xxhash64(F.lit("order"), "key"), F.pmod("part", F.lit(SHARDS)))
        .mapInArrow(sparse, "index array<int>, count array<float>, lang string, order long, shard long")
        .groupBy("shard").applyInPandas(one_shard, "scores binary, bias array<double>").collect()
    )
    if not found:
        return Model(languages, np.zeros((1 << BITS, len(languages)), np.float32), np.zeros(len(languages)))
    scores = sum(np.frombuffer(r["scores"], np.float32) / len(found) for r in found).reshape(1 << BITS, -1)
    model = Model(languages, np.ascontiguousarray(scores), sum(np.array(r["bias"]) / len(found) for r in found))
    kept = predict(sample.filter(f"part >= {4 * SHARDS}"), model, "key", ["lang"]).filter("lang = lang_pred").select("score").collect()
    if kept:  # numbers of a bounded number of rows
        model.threshold = float(np.quantile([r["score"] for r in kept], 1 - KEPT))
    return model


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", also: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score, accepted (score not below the threshold).

    ``und`` with score 0 for null texts and texts without a Unicode letter, and for
    all without a model. Rows are scored one by one over the whole text; ties go to
    the first language in order; other columns are not looked at but those in ``also``.
    """
    also = also or []
    rows = docs.select(F.col(key).alias("key"), *also, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has"), F.col(text).alias("text"))
    if model is None:
        return rows.select(
            F.col("key").alias(key), *also, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")
        )
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.bias, model.threshold))
    names = ["key", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            out = np.zeros((len(batch), len(m.languages)))
            for i, j, data, at in chunks(batch.column(len(names) + 1)):
                of, index = subwords(data, at)
                n = np.maximum(np.bincount(of, minlength=j - i), 1)
                for c in range(len(m.languages)):
                    out[i:j, c] = np.bincount(of, m.scores[index, c], minlength=j - i) / n
            p = softmax(out + m.bias)
            has = batch.column(len(names)).to_numpy(zero_copy_only=False)
            best = p.argmax(axis=1)
            score = np.where(has, p[np.arange(len(p)), best], 0.0)
            names_of = [m.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(names_of, pa.string()), pa.array(score), pa.array(has & (score >= m.threshold))],
                [*names, "lang_pred", "score", "accepted"],
            )

    schema = rows.select(*names).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return in_text_batches(rows).mapInArrow(run, schema).withColumnRenamed("key", key)


@query("op10_language")
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each document, learnt from the documents that name theirs."""
    docs = table(spark, folder, "documents")
    out = predict(docs, train(docs))
    return out.withColumn("held_out", bucket(F.col("doc_id"), MODULUS) == HELD_OUT).select("doc_id", "held_out", "lang_pred", "score", "accepted")
