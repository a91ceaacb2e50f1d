"""Toxicity by compression distance.

Two zstandard dictionaries are trained: each holds the words frequent in all texts
and, after them, the words and beginnings of words that stand out in its class
against the other. They are counted by the different words that they follow, so that
copies of a text count once. Both have one length, so that what they share lies equally far. Text
is cut into small windows of whole words, each behind a line that both
dictionaries hold; what the ordinary dictionary needs beyond the toxic one, in
bytes, is a window's distance. A logistic curve over a text's distances is
calibrated on labelled documents that the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, in_text_batches, query, stored, table, utf8
from .decontaminate import word_array
from .labelled import SAMPLE_ROWS, labelled_sample, logistic, sigmoid, with_scores

MODULUS, HELD_OUT, ACCEPT = 5, 0, 0.5
#: Bytes in a window; frequent and outstanding words in a dictionary.
WINDOW, FREQUENT, OUTSTANDING = 40, 100, 4096
#: Longer words count by so many first letters too; this marks such a beginning.
START, ANY = 5, "*"
#: Starts each dictionary and each window, so that every window has a match; no word holds these bytes.
LINE, GAP = bytes(range(1, 32)), b"\x01"
#: What makes a word stand out: standard deviations above its share, and times its share in the other class.
DEVIATIONS, LIFT = 6.0, 4.0

_plain = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """Lower-case words joined by blanks, in windows of at most ``size`` bytes; one without words is empty."""
    line = b" ".join(text.translate(_plain).split())
    at = 0
    while True:
        end = at + size
        if end >= len(line):
            yield line[at:]
            return
        cut = line.rfind(b" ", at, end + 1)
        cut = end if cut <= at else cut
        yield line[at:cut]
        at = cut + (line[cut : cut + 1] == b" ")


class Distance:
    """Compressed lengths with either dictionary; matches have six bytes at least, so syllables don't count."""

    def __init__(self, model: Model):
        self.sides = [self._compressor(d) for d in (model.ordinary, model.toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            5, source_size=WINDOW + len(LINE), dict_size=len(content), write_content_size=0, write_dict_id=0,
            strategy=zstandard.STRATEGY_LAZY, min_match=6, search_log=4,
        )
        return zstandard.ZstdCompressor(dict_data=own, compression_params=settings)

    def features(self, text: bytes) -> tuple[float, ...]:
        """Mean and largest distance, logarithms of their sum and of the windows from 3 and 5, share from 4."""
        ordinary, toxic = (s.compress for s in self.sides)
        marked = [LINE + b" " + w + b" " for w in windows(text)]
        d = [len(ordinary(w)) - len(toxic(w)) for w in marked]
        n, total = len(d), sum(d)
        three, four, five = (sum(x >= k for x in d) for k in (3, 4, 5))
        return total / n, float(max(d)), float(np.log1p(max(total, 0))), float(np.log1p(three)), float(np.log1p(five)), four / n


def _features(texts: pa.Array, own: Distance) -> np.ndarray:
    data, at = utf8(texts)
    data = memoryview(data)
    return np.array([own.features(bytes(data[at[i] : at[i + 1]])) for i in range(len(texts))]).reshape(-1, 6)


def dictionaries(sample: DataFrame, frequent: int = FREQUENT, outstanding: int = OUTSTANDING) -> Model:
    """Both dictionaries from (text, label): words are counted in Spark, the chosen ones collected."""
    met = sample.select("label", F.concat(F.array(F.lit("")), word_array(F.col("text"))).alias("words"))
    after = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda v, w: F.struct(w.alias("word"), F.xxhash64(v).alias("before")))
    met = met.select("label", F.explode_outer(after).alias("at")).select("label", "at.word", "at.before")
    met = met.filter(F.col("word").isNotNull() & (F.octet_length("word") <= 64))
    start = F.when(F.length("word") > START, F.concat(F.substring("word", 1, START), F.lit(ANY)))
    met = met.select("label", "before", F.explode(F.array_compact(F.array("word", start))).alias("word")).distinct()
    counts = stored(met.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary")), "words-of-classes")
    n = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("toxic"), F.coalesce(F.sum("ordinary"), F.lit(0.0)).alias("ordinary")).first()
    chosen = []
    for own, other in (("ordinary", "toxic"), ("toxic", "ordinary")):
        both = n[own] + n[other] or 1.0
        share = (F.col(own) + F.col(other)) / both
        expected = share * n[own]
        spread = F.sqrt(expected * F.greatest(1 - share, F.lit(0.0)) * n[other] / both) + 0.5
        z = ((F.col(own) - expected) / spread).alias("z")
        lifted = F.col(own) * n[other] >= LIFT * F.col(other) * n[own]
        best = counts.filter(lifted).select("word", z).filter(F.col("z") > DEVIATIONS).orderBy(F.desc("z"), "word").limit(outstanding)
        chosen.append([r["word"] for r in reversed(best.collect())])  # the best come last, nearest to the text
    marked = {w for words in chosen for w in words}
    common = counts.filter(~F.col("word").endswith(ANY)).orderBy(F.desc(F.col("toxic") + F.col("ordinary")), "word").limit(frequent + len(marked)).select("word").collect()
    common = [r["word"] for r in common if r["word"] not in marked][:frequent]
    tails = [_entries(words) for words in chosen]
    size = max(map(len, tails))
    return Model(*[LINE + _entries(reversed(common)) + tail.rjust(size, b"\0") for tail in tails])


def _entries(words) -> bytes:
    return b"".join(GAP + b" " + (w.removesuffix(ANY) if w.endswith(ANY) else w + " ").encode() for w in words)


def train(sample: DataFrame) -> Model | None:
    """Dictionaries from three quarters of (key, text, label), the curve from the rest; None without rows of both labels."""
    part = F.pmod(F.xxhash64(F.lit("curve"), "key"), F.lit(4))
    sample = stored(sample.withColumn("part", part), "toxicity-sample")
    model = dictionaries(sample.filter("part > 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Distance(model)
        for batch in batches:
            x = _features(batch.column(0), own)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = in_text_batches(sample.filter("part = 0").select("text", "label")).mapInArrow(run, "x array<double>, y double").collect()
    y = np.array([r["y"] for r in rows])  # seven numbers for each of a bounded number of rows
    if len(set(y)) < 2:
        return None
    model.weights = logistic(np.array([r["x"] for r in rows]), y)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with a column ``score``: probability of label 1; 0.0 without a model.

    Null and empty texts are one empty window. Rows are scored one by one, over
    the whole text, so repeated rows, ties and other columns don't matter (a
    column ``score`` of the input is replaced).
    """
    if model is None:
        return docs.select(*(docs.columns if keep is None else keep)).withColumn("score", F.lit(0.0))

    def one(texts: pa.Array) -> np.ndarray:
        return sigmoid(model.weights[0] + _features(texts, Distance(model)) @ model.weights[1:])

    return with_scores(docs, one, text, keep)


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    return train(labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows=rows))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probability that each document is toxic."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = score(docs, trained(docs, table(spark, folder, "labels")), keep=["doc_id"])
    return out.select(
        "doc_id", (bucket(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )
