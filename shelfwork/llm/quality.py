"""Quality by logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Words and runs of marks are tokens. Each gives an n-gram of its letters, of itself
and its neighbour, and of the shapes (capitals, figures, marks, a repeat of the
word before, the same again one further) of one, two and three tokens. A text's
features are the counts of its hashed n-grams at length one; its score is the
sparse dot product with the weights through a sigmoid. Weights are trained in
shards and averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, chunks, in_text_batches, lowered, mix, owners, query, runs, span_hashes, stored, table
from .labelled import SAMPLE_ROWS, labelled_sample, sigmoid, with_scores

BITS, SHARDS, EPOCHS = 18, 4, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
MODULUS, HELD_OUT, ACCEPT = 4, 2, 0.7

_kind = np.full(256, 2, np.uint8)  # 0 blank, 1 word, 2 marks
_kind[[0x20, *range(0x09, 0x0E)]] = 0
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _kind[_a:_b] = 1


def features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (text, index, value) of the texts in ``data``; each text's values have length one."""
    kind = _kind[data]
    spans = [runs(kind == k, at) for k in (1, 2)]
    starts, ends = np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans])
    order = np.argsort(starts, kind="stable")
    starts, ends, word = starts[order], ends[order], (order < len(spans[0][0]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    own = owners(starts, at)
    hashes = span_hashes(lowered(data), starts, ends)
    capital, small_, figure = ((data >= a) & (data <= b) for a, b in ((65, 90), (97, 122), (48, 57)))

    def holds(what: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(what)))
        return total[ends] > total[starts]

    def beside(a: np.ndarray, step: int) -> np.ndarray:  # does the token ``step`` before equal this one?
        out = np.zeros(len(a), bool)
        out[step:] = (a[step:] == a[:-step]) & (own[step:] == own[:-step])
        return out

    size = np.minimum(np.log2(ends - starts + 1).astype(np.uint64), np.uint64(7))
    shape = word.astype(np.uint64)
    for x in (holds(capital), holds(small_), holds(figure), beside(hashes, 1), beside(hashes, 2)):
        shape = shape * np.uint64(2) + x
    shape = np.where(word, shape, shape ^ (hashes << np.uint64(8)))  # marks stand for themselves
    grams, of = [hashes, mix(shape + np.uint64(1)), mix(shape * np.uint64(8) + size + np.uint64(1 << 20))], [own] * 3
    for n, what in ((2, hashes), (2, shape), (3, shape)):
        if len(starts) >= n:
            x = what[: len(what) - n + 1]
            for i in range(1, n):
                x = mix(x * np.uint64(3) + what[i : len(what) - n + 1 + i] + np.uint64(n))
            whole = own[n - 1 :] == own[: len(own) - n + 1]
            grams.append(mix(x + np.uint64(1 + n))[whole])
            of.append(own[n - 1 :][whole])
    index = np.concatenate(grams) >> np.uint64(64 - bits)
    cells, count = np.unique((np.concatenate(of).astype(np.uint64) << np.uint64(bits)) | index, return_counts=True)
    row, index = (cells >> np.uint64(bits)).astype(np.int64), (cells & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = count.astype(float)
    return row, index, value / np.sqrt(np.bincount(row, value * value))[row]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates over (index, value, label); the last one is the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i):
        held = np.where(np.abs(z[i]) <= L1, 0, np.sign(z[i]) * L1 - z[i])
        return held / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(epochs):
        for index, value, label in rows:
            index, value = np.append(index, 1 << bits), np.append(value, 1.0)
            w = weights(index)
            g = (sigmoid(w @ value) - label) * value
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA * w
            n[index] += g * g
    return weights(slice(None))


def train(sample: DataFrame, bits: int = BITS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray | None:
    """Weights fitted to (key, text, label), averaged over shards; None without rows.

    What comes to the driver are ``shards`` arrays of 2**bits numbers.
    """

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunks(batch.column(1)):
                row, index, value = features(data, at, bits)
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i),
                        pa.array([index[p].astype(np.int32) for p in parts], pa.list_(pa.int32())),
                        pa.array([value[p].astype(np.float32) for p in parts], pa.list_(pa.float32())),
                    ],
                    ["key", "label", "index", "value"],
                )

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        rows = [(i, v.astype(float), y) for i, v, y in zip(pdf["index"], pdf["value"], pdf["label"], strict=True)]
        return pd.DataFrame({"weights": [ftrl(rows, bits, epochs).astype(np.float32).tobytes()], "rows": [len(rows)]})

    kind = sample.schema["key"].dataType.simpleString()
    rows = in_text_batches(sample.select("key", "text", "label")).mapInArrow(sparse, f"key {kind}, label double, index array<int>, value array<float>")
    rows = rows.withColumn("order", F.xxhash64("key")).drop("key").withColumn("shard", F.pmod("order", F.lit(shards)))
    found = rows.groupBy("shard").applyInPandas(one_shard, "weights binary, rows long").collect()
    if not found:
        return None
    total = sum(r["rows"] for r in found)
    return sum(np.frombuffer(r["weights"], np.float32) * np.float32(r["rows"] / total) for r in found)


def score(docs: DataFrame, weights: np.ndarray | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with a column ``score``: probability of label 1; 1.0 without weights.

    Null and empty texts score by the bias alone; rows are scored one by one, so
    repeated rows, ties and other columns don't matter (a column ``score`` of the
    input is replaced).
    """
    if weights is None:
        return docs.select(*(docs.columns if keep is None else keep)).withColumn("score", F.lit(1.0))
    bits, shared = int(np.log2(len(weights) - 1)), docs.sparkSession.sparkContext.broadcast(weights)

    def one(texts: pa.Array) -> np.ndarray:
        w, out = shared.value, np.zeros(len(texts))
        for i, j, data, at in chunks(texts):
            row, index, value = features(data, at, bits)
            out[i:j] = np.bincount(row, w[index] * value, minlength=j - i) + w[-1]
        return sigmoid(out)

    return with_scores(docs, one, text, keep)


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    return train(stored(labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, rows=rows), "quality-sample"))


@query("op4_quality")
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Probability that each document is of good quality."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = score(docs, trained(docs, table(spark, folder, "labels")), keep=["doc_id"])
    return out.select(
        "doc_id", (bucket(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )
