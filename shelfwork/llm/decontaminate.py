"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``words`` consecutive words of a benchmark item; an item of fewer
words is one window. Of the hashes of all runs of k words, the smallest in each
window of words is kept, for items and for documents alike, so that equal
windows keep an equal fingerprint. Documents whose fingerprints meet those of
the benchmark are read again; the hits are extended to all windows around them,
which are compared as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, query, small, stored, table, text_digest

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = 13


def word_array(text):
    """Lower-case words (digits, a-z and all beyond ASCII); null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def gram(length: int) -> int:
    """Words in the hashed runs for windows of ``length`` words: about half of it."""
    return (length + 1) // 2


def rolled(df: DataFrame, column: str, have: int, width: int, join) -> DataFrame:
    """``column``, whose elements span ``have`` neighbours, joined until they span ``width``."""
    while have < width:
        step = min(have, width - have)
        n = F.greatest(F.size(column) - step, F.lit(0))
        df = df.withColumn(column, F.zip_with(F.slice(column, 1, n), F.slice(column, 1 + step, n), join))
        have += step
    return df


def gram_hashes(df: DataFrame, length: int, out: str) -> DataFrame:
    """Column ``out``: the hash of every run of gram(length) words of ``words``."""
    k = gram(length)
    if k == 1:
        return df.withColumn(out, F.transform("words", lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda v, w: F.xxhash64(v, w))
    return rolled(df.withColumn(out, pairs), out, 2, k, lambda v, w: F.xxhash64(v, w))


def winnowed(df: DataFrame, length: int, out: str) -> DataFrame:
    """Column ``out``: the distinct fingerprints of ``words`` for windows of ``length`` words.

    Unfold it with explode_outer: a filter inferred from explode would repeat
    the whole chain of expressions.
    """
    df = rolled(gram_hashes(df, length, out), out, 1, length - gram(length) + 1, lambda v, w: F.least(v, w))
    return df.withColumn(out, F.array_distinct(out))


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", words: int = WORDS,
) -> DataFrame:
    """One row per row of ``docs``: key, digest (md5 of the text), n_words, n_hit, item_ids (sorted as strings).

    Null and empty texts have no words and no hits; so have all texts if
    ``items`` is empty. Items without words count for nothing, null item ids
    are left out of item_ids (their windows still hit). Repeated rows of
    ``docs`` each get their row, whatever their keys: hits belong to a text, which
    is known by its md5.
    Other columns of either table are not looked at.
    """
    spark = docs.sparkSession
    benchmark = items.select(F.col(item).cast("string").alias("item"), word_array(F.col(item_text)).alias("words"))
    benchmark = benchmark.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(words)))
    lengths = sorted(r["length"] for r in benchmark.select("length").distinct().collect())  # at most ``words`` values
    windows = (
        benchmark.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
        .select("item", "length", F.slice("words", F.col("start"), F.col("length")).alias("words"))
        .groupBy("length", F.array_join("words", " ").alias("window"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashed = rows.select("key", text_digest("text").alias("digest"), word_array(F.col("text")).alias("words"))
    if not lengths:
        return hashed.select(
            F.col("key").alias(key), "digest", F.size("words").cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"),
        )
    windows = stored(windows, "benchmark-windows")
    prints = []
    for n in lengths:
        own = windows.filter(F.col("length") == n).select(F.split("window", " ").alias("words"))
        own = winnowed(own, n, "prints").select(F.explode_outer("prints").alias("print"))
        prints.append(own.select(F.lit(n).alias("length"), "print"))
    prints = small(stored(reduce(DataFrame.union, prints).distinct(), "benchmark-prints"))

    # The texts' fingerprints, made once, and which of them the benchmark has too.
    for n in lengths:
        hashed = winnowed(hashed, n, f"prints_{n}")
    hashed = stored(
        hashed.select("key", "digest", F.size("words").cast("long").alias("n_words"), *[f"prints_{n}" for n in lengths]),
        "document-prints",
    )
    met = [
        hashed.select("digest", F.lit(n).alias("length"), F.explode(f"prints_{n}").alias("print")).join(prints, ["length", "print"])
        for n in lengths
    ]
    hits = reduce(DataFrame.union, met).groupBy("digest").agg(F.collect_set(F.struct("length", "print")).alias("prints"))
    hits = small(stored(hits, "hits"))

    # Extend: every window around a hit, compared as text.
    found = (
        rows.withColumn("digest", text_digest("text")).join(hits, "digest")
        .dropDuplicates(["digest"])
        .select("digest", "prints", word_array(F.col("text")).alias("words"))
    )
    spans = []
    for n in lengths:
        found = gram_hashes(found, n, f"grams_{n}")
        own = F.transform(F.filter("prints", lambda p: p["length"] == n), lambda p: p["print"])
        found = found.withColumn(f"own_{n}", own)
        places = F.filter(
            F.transform(f"grams_{n}", lambda g, i: F.when(F.array_contains(F.col(f"own_{n}"), g), i)),
            lambda i: i.isNotNull(),
        )
        found = found.withColumn(f"at_{n}", places)
        starts = F.array_distinct(
            F.flatten(F.transform(f"at_{n}", lambda i: F.sequence(
                F.greatest(i - (n - gram(n)), F.lit(0)), F.greatest(F.least(i, F.size("words") - n), F.lit(0))
            )))
        )
        spans.append(F.transform(starts, lambda s: F.struct(F.lit(n).alias("length"), s.alias("start"))))
    found = found.select("digest", "words", F.explode(F.flatten(F.array(*spans))).alias("at"))
    found = found.select(
        "digest", "at.length", "at.start",
        F.array_join(F.slice("words", F.col("at.start") + 1, F.col("at.length")), " ").alias("window"),
    ).join(small(windows), ["length", "window"])
    found = found.groupBy("digest").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("length") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    found = small(stored(found, "contaminated"))
    return (
        hashed.select("key", "digest", "n_words")
        .join(found, "digest", "left")
        .select(
            F.col("key").alias(key), "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each document that lies in 13-word windows of the benchmark."""
    out = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
