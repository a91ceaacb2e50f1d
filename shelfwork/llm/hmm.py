"""Scoring of texts by a hidden Markov language model.

Words are counted over all training texts; a text's base score is its smoothed
unigram probability. The model emits, from a few hidden states, the most frequent
words by themselves and all others as one rare symbol, which stands for a word by
its unigram share among the rare ones; so it is a distribution over the same
words as the unigrams. Baum-Welch runs over all training texts: each task adds up
the expected counts of its texts, Spark sums them. Texts are scored by the scaled
forward recursion. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_words, bucket, chunks, in_text_batches, lowered, owners, query, span_hashes, stored, table

MODULUS, HELD_OUT = 10, 0
#: Words whose counts every task holds; words with an emission of their own; hidden states; rounds of training.
NEAR, SYMBOLS, STATES, ROUNDS = 1 << 18, 1 << 14, 8, 4
#: Tokens of texts that are worked on side by side.
BATCH = 1 << 19
PSEUDO = 0.1
END = np.uint64(0x5851F42D4C957F2D)  # the hash that stands for a text's end


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of the texts, an end after each, and the texts' bounds among them."""
    starts, ends = blank_words(data, at)
    hashes = span_hashes(lowered(data), starts, ends)
    n = len(at) - 1
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owners(starts, at), minlength=n) + 1)))
    out = np.full(bounds[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = hashes
    return out, bounds


def counted(texts: DataFrame) -> DataFrame:
    """(hash, c) of all tokens of the column ``text``; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["hash", "c"])

        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                held.append(token_hashes(data, at)[0])
                size += len(held[-1])
                if size >= 4 * BATCH:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return in_text_batches(texts.select("text")).mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The most frequent words, sorted by hash, and what the corpus adds up to."""

    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    tokens: int
    distinct: int

    def log_share(self, c):
        return np.log10((c + PSEUDO) / (self.tokens + PSEUDO * (self.distinct + 1)))

    def symbol_shares(self, symbols: int) -> np.ndarray:
        """The unigram share of each symbol; the last one is that of all rare words."""
        c = np.zeros(symbols)
        own = self.ranks < symbols
        c[self.ranks[own]] = self.counts[own]
        share = np.where(c > 0, (c + PSEUDO) / (self.tokens + PSEUDO * (self.distinct + 1)), 0.0)
        return np.append(share, max(1 - share.sum(), PSEUDO / (self.tokens + PSEUDO * (self.distinct + 1))))


def near_words(counts: DataFrame, most: int = NEAR) -> Words:
    """The words of the highest counts, as many as are at most ``most`` without parting equal counts.

    The driver gets these words and, before, how many words have each count.
    """
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    steps = counts.groupBy("c").agg(F.count("*").alias("words")).toArrow().to_pandas().sort_values("c", ascending=False)
    fit = steps["c"][steps["words"].cumsum() <= most]
    top = counts.filter(F.col("c") >= int(fit.min())).toArrow() if len(fit) else pa.table({"hash": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    hashes, c = top["hash"].to_numpy().astype(np.int64), top["c"].to_numpy().astype(np.int64)
    by_hash = np.argsort(hashes)
    hashes, c = hashes[by_hash], c[by_hash]
    ranks = np.empty(len(c), np.int64)
    ranks[np.lexsort((hashes, -c))] = np.arange(len(c))
    return Words(hashes, c, ranks, int(total["n"]), int(total["v"]))


def sequences(rows: DataFrame, words: Words, symbols: int = SYMBOLS) -> DataFrame:
    """Each row of (row, key, held_out, text) as symbols, with what the near words add to its scores and the words left over."""
    shared = rows.sparkSession.sparkContext.broadcast((words.hashes, words.counts, words.ranks, words.tokens, words.distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words(*shared.value)
        share = w.log_share(w.counts)
        for batch in batches:
            for i, j, data, at in chunks(batch.column(3)):
                found, bounds = token_hashes(data, at)
                found = found.view(np.int64)
                place = np.minimum(np.searchsorted(w.hashes, found), max(len(w.hashes) - 1, 0))
                near = w.hashes[place] == found if len(w.hashes) else np.zeros(len(found), bool)
                rank = np.where(near, w.ranks[place] if len(w.ranks) else 0, symbols)
                own = np.where(near, share[place] if len(share) else 0.0, 0.0)
                total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  each text has an end at least
                symbol = np.minimum(rank, symbols).astype("<u2")
                text = np.repeat(np.arange(j - i), np.diff(bounds))
                far, far_n, cuts = [], [], [0]
                texts, hashes = text[~near], found[~near]
                order = np.lexsort((hashes, texts))
                texts, hashes = texts[order], hashes[order]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(texts) != 0) | (np.diff(hashes) != 0)))) if len(texts) else np.zeros(0, int)
                far, far_n = hashes[new], np.diff(np.append(new, len(texts)))
                cuts = np.searchsorted(texts[new], np.arange(j - i + 1))
                sliced = [batch.column(c).slice(i, j - i) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *sliced, pa.array(np.diff(bounds)), pa.array(total(near.astype(np.int64))), pa.array(total(own)),
                        pa.array(total(np.where(symbol < symbols, own, 0.0))), pa.array(total((symbol == symbols).astype(np.int64))),
                        pa.array([symbol[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        pa.array([far[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int64())),
                        pa.array([far_n[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int64())),
                    ],
                    NAMES,
                )

    kind = rows.schema["key"].dataType.simpleString()
    return in_text_batches(rows.select("row", "key", "held_out", "text")).mapInArrow(
        run,
        f"row long, key {kind}, held_out boolean, n_tokens long, near_known long, near_share double, symbol_share double, "
        "n_rare long, symbols binary, far array<long>, far_n array<long>",
    )


NAMES = ["row", "key", "held_out", "n_tokens", "near_known", "near_share", "symbol_share", "n_rare", "symbols", "far", "far_n"]


@dataclass
class Hmm:
    start: np.ndarray  # state
    move: np.ndarray  # state x state
    emit: np.ndarray  # symbol x state


def first_model(shares: np.ndarray, states: int = STATES) -> Hmm:
    """States that stay as they are mostly, with the unigram shares shaken a little."""
    emit = shares[:, None] * np.random.default_rng(7).uniform(0.5, 1.5, (len(shares), states))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


class Sorted:
    """Sequences side by side, the longest first: step t holds those of more than t symbols."""

    def __init__(self, parts: list[np.ndarray]):
        self.order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        lengths = np.array([len(parts[i]) for i in self.order])
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0])).tolist() if len(lengths) else []
        self.at = np.concatenate(([0], np.cumsum(self.active))).astype(np.int64)
        self.symbols = np.empty(self.at[-1], np.int64)
        for row, i in enumerate(self.order):
            self.symbols[self.at[: lengths[row]] + row] = parts[i]


def forward(own: Sorted, model: Hmm, keep: bool = False):
    """Natural logarithms of the sequences' likelihoods, in the order given; with the scaled states if ``keep``."""
    total, like = np.zeros(len(own.order)), model.emit[own.symbols]
    states, scales = (np.empty_like(like), np.empty(len(like))) if keep else (None, None)
    a = None
    for t, n in enumerate(own.active):
        x = own.at[t]
        a = (model.start if t == 0 else a[:n] @ model.move) * like[x : x + n]
        scale = a.sum(1)
        a /= scale[:, None]
        total[:n] += np.log(scale)
        if keep:
            states[x : x + n], scales[x : x + n] = a, scale
    out = np.empty_like(total)
    out[own.order] = total
    return out, like, states, scales


def expected(own: Sorted, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the logarithm of the likelihood."""
    logs, like, states, scales = forward(own, model, keep=True)
    moves, k = np.zeros_like(model.move), len(model.start)
    beta = np.ones((len(own.order), k))
    for t in range(len(own.active) - 1, 0, -1):
        n, x, y = own.active[t], own.at[t], own.at[t - 1]
        ahead = like[x : x + n] * beta[:n] / scales[x : x + n, None]
        moves += states[y : y + n].T @ ahead
        states[x : x + n] *= beta[:n]
        beta[:n] = ahead @ model.move.T
    states[: len(beta)] *= beta
    emits = np.stack([np.bincount(own.symbols, states[:, s], minlength=len(model.emit)) for s in range(k)], axis=1)
    return states[: len(beta)].sum(0), moves * model.move, emits, float(logs.sum())


def pooled(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[list[np.ndarray], list[tuple[pa.RecordBatch, int]]]]:
    """The symbols of rows, in lists of about ``most`` symbols, and the rows they are of."""
    held, rows, size = [], [], 0
    for batch in batches:
        for i, value in enumerate(batch.column(column)):
            held.append(np.frombuffer(value.as_buffer(), "<u2"))
            rows.append((batch, i))
            size += len(held[-1])
            if size >= most:
                yield held, rows
                held, rows, size = [], [], 0
    if held:
        yield held, rows


def baum_welch(texts: DataFrame, model: Hmm, rounds: int = ROUNDS) -> Hmm:
    """``model`` after so many rounds over all rows of ``symbols``.

    What a round brings to the driver are the model's own numbers, summed in Spark.
    """
    k, size = len(model.start), len(model.emit)
    columns = [f"s{i}" for i in range(k)]
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Hmm(*shared.value)
            sums = np.zeros((size + k + 1, k))
            for held, _ in pooled(batches, 0, 4 * BATCH):
                for part in alike(held):
                    start, moves, emits, _ = expected(Sorted([held[i] for i in part]), own)
                    sums[:size] += emits
                    sums[size : size + k] += moves
                    sums[-1] += start
            some = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(sums[some, s]) for s in range(k)]], ["id", *columns])

        found = texts.select("symbols").mapInArrow(run, "id long, " + ", ".join(f"{c} double" for c in columns))
        found = found.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]).toArrow().to_pandas()
        sums = np.zeros((size + k + 1, k))
        sums[found["id"].to_numpy()] = found[columns].to_numpy()
        prior = model.emit.mean(1, keepdims=True)  # keeps every symbol possible in every state
        emit, move, start = sums[:size] + k * prior, sums[size : size + k] + PSEUDO, sums[-1] + PSEUDO
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def likelihoods(rows: DataFrame, model: Hmm) -> DataFrame:
    """``rows`` without symbols, far and far_n, with ``log_likelihood`` (base ten) of their symbols."""
    names = [c for c in rows.columns if c not in ("symbols", "far", "far_n")]
    shared = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hmm(*shared.value)
        for held, at in pooled(batches, len(names), 4 * BATCH):
            logs = forward_in_batches(held, own) / np.log(10)
            arrays = [pa.array([b.column(c)[i].as_py() for b, i in at], at[0][0].schema.field(c).type) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(logs)], [*names, "log_likelihood"])

    return rows.select(*names, "symbols").mapInArrow(run, rows.select(*names).schema.add("log_likelihood", "double"))


def alike(held: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Numbers of texts of similar length, BATCH tokens of them or one text, so that few steps have few texts."""
    order = np.argsort([-len(h) for h in held], kind="stable")
    i = 0
    while i < len(order):
        size, j = 0, i
        while j < len(order) and (j == i or size + len(held[order[j]]) <= BATCH):
            size += len(held[order[j]])
            j += 1
        yield order[i:j]
        i = j


def forward_in_batches(held: list[np.ndarray], model: Hmm) -> np.ndarray:
    out = np.empty(len(held))
    for part in alike(held):
        out[part] = forward(Sorted([held[i] for i in part]), model)[0]
    return out


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = MODULUS, held_out: int = HELD_OUT,
    near: int = NEAR, symbols: int = SYMBOLS, states: int = STATES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are base-ten logarithms of probabilities. Null and empty texts have the
    end token only. Repeated rows are training texts of their own and each get a
    row; ties in frequency are broken by hash; without training rows all words are
    unknown. An empty table gives no rows. Other columns are not looked at.
    """
    if not 0 < symbols < 1 << 16 or symbols > near:
        raise ValueError("symbols fit in 16 bits and are among the near words")
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), (bucket(F.col(key), modulus) == held_out).alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    counts = stored(counted(rows.filter("not held_out")), "token-counts")
    words = near_words(counts, near)
    coded = stored(sequences(rows, words, symbols), "sequences")  # the row numbers hold from here on
    shares = words.symbol_shares(symbols)
    model = baum_welch(coded.filter("not held_out"), first_model(shares, states), rounds)

    each = F.lit(float(words.tokens + PSEUDO * (words.distinct + 1)))
    far = coded.select("row", F.explode(F.arrays_zip("far", "far_n")).alias("w")).select("row", F.col("w.far").alias("hash"), F.col("w.far_n").alias("n"))
    far = far.join(counts, "hash", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + PSEUDO) / each)).alias("far_share"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"),
    )
    out = likelihoods(coded, model).join(far, "row", "left")
    base = F.col("near_share") + F.coalesce("far_share", F.lit(0.0))
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("near_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("log_likelihood") + base - F.col("symbol_share") - F.col("n_rare") * float(np.log10(shares[-1]))).alias("score"),
    )


@query("op9_hmm")
def op9_hmm(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram and hidden Markov scores of each document."""
    return score(table(spark, folder, "documents"))
