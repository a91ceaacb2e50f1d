"""Over-long texts: statistics, redundant sentences, extractive summaries.

Sentences stay with their document: one hash partitioning by document key serves
every grouping and window below, because (document, sentence) and
(document, term) groups lie inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as T
from ..scale import by_key, small_text_batches
from .vocab import document_term_counts

# ------------------------------------------------------------------ statistics


def length_columns(df: DataFrame, text: str) -> DataFrame:
    return df.select(
        T.word_count(text).alias("word_count"), F.size(T.sentences(text)).alias("sentence_count")
    )


def text_stats(df: DataFrame, text: str) -> DataFrame:
    """Minimum, maximum, mean and population deviation of words and sentences."""
    counts = length_columns(df, text)
    aggs = []
    for c in ("word_count", "sentence_count"):
        aggs += [
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"),
        ]
    return counts.agg(*aggs)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum.

    Quartiles are exact. The values are counted before the percentile, so it
    works on distinct values with frequencies, not on rows.
    """
    counted = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    quartile = [F.percentile("v", q, F.col("n")).alias(a) for q, a in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    total = F.sum("n")
    mean = F.sum(F.col("v") * F.col("n")) / total
    squares = F.sum(F.col("v").cast("double") * F.col("v") * F.col("n"))
    return counted.agg(
        total.alias("count"),
        mean.alias("mean"),
        F.sqrt((squares - total * mean * mean) / (total - 1)).alias("std"),
        F.min("v").alias("min"),
        *quartile,
        F.max("v").alias("max"),
    )


def long_text_mask(df: DataFrame, text: str, threshold: int = 200, mask: str = "is_long") -> DataFrame:
    """True where a text has at least ``threshold`` words."""
    return df.withColumn(mask, T.word_count(text) >= threshold)


def length_limits(df: DataFrame, text: str, factor: float = 1.0, threshold: int = 200) -> DataFrame:
    """The computed limit mean + factor * deviation and the rows above each limit."""
    words = df.select(T.word_count(text).alias("n"))
    counts = words.groupBy("n").agg(F.count("*").alias("rows"))
    stats = words.agg((F.avg("n") + F.lit(factor) * F.stddev_pop("n")).alias("limit"))
    limit = stats.scalar()
    above = F.sum(F.when(F.col("n") > limit, F.col("rows")).otherwise(0))
    fixed_above = F.sum(F.when(F.col("n") >= threshold, F.col("rows")).otherwise(0))
    return counts.agg(
        F.max(limit).alias("computed_limit"),
        above.alias("rows_above_computed"),
        F.lit(threshold).alias("fixed_limit"),
        fixed_above.alias("rows_at_fixed"),
    )


def length_between(df: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """Rows whose text is neither too short nor too long."""
    return df.where(T.word_count_white(text).between(low, high))


# ------------------------------------------------------------------- sentences


def sentence_rows(df: DataFrame, key: str, text: str, lower: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sentence: key, position, sentence and the document's number of sentences."""
    found = df.select(key, *keep, T.sentences(text, lower).alias("_s"))
    # The outer form keeps Spark from deriving "has sentences" as a filter below
    # the shuffle, where it would split every text once more.
    rows = found.select(
        key, *keep, F.size("_s").alias("n_sents"), F.posexplode_outer("_s").alias("sent_ix", "sentence")
    )
    return rows.where("sentence is not null")


def _term_counts(sentences: DataFrame, key: str) -> DataFrame:
    terms = sentences.select(key, "n_sents", "sent_ix", F.explode(T.similarity_tokens("sentence")).alias("term"))
    return terms.groupBy(key, "n_sents", "sent_ix", "term").agg(F.count("*").alias("tf"))


def _raw_weights(sentences: DataFrame, key: str) -> DataFrame:
    counts = _term_counts(sentences, key)
    df_ = F.count("*").over(W.partitionBy(key, "term"))
    idf = F.log((F.lit(1.0) + F.col("n_sents")) / (F.lit(1.0) + F.col("df"))) + 1.0
    return counts.withColumn("df", df_).withColumn("raw", F.col("tf") * idf)


def sentence_tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """TF-IDF weights of the terms of every sentence, fitted per document, unit length."""
    sents = sentence_rows(by_key(df.select(key, text), key), key, text, lower=True)
    raw = _raw_weights(sents, key)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key, "sent_ix")))
    return raw.select(key, "sent_ix", "term", (F.col("raw") / norm).alias("weight"))


def sentence_vectors(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """The distinct sentence vectors of documents that are partitioned by key.

    ``members`` are the sentences with the same words (in any order), ``first``
    the earliest of them. ``terms`` run from rare to frequent; ``lead`` are the
    terms up to the point where the squared weight still to come falls below
    threshold².
    """
    sents = sentence_rows(docs, key, text, lower=True)
    words = F.array_join(F.sort_array(T.similarity_tokens("sentence")), " ")
    same = sents.select(key, "n_sents", "sent_ix", words.alias("words")).where("words <> ''")
    same = same.groupBy(key, "n_sents", "words").agg(F.sort_array(F.collect_list("sent_ix")).alias("members"))
    same = same.withColumn("first", F.get("members", F.lit(0)))
    terms = same.select(key, "n_sents", "first", "members", F.explode(F.split("words", " ")).alias("term"))
    counts = terms.groupBy(key, "n_sents", "first", "members", "term").agg(F.count("*").alias("tf"))
    in_document = F.sum(F.size("members")).over(W.partitionBy(key, "term"))
    idf = F.log((F.lit(1.0) + F.col("n_sents")) / (F.lit(1.0) + F.col("df"))) + 1.0
    raw = counts.withColumn("df", in_document).withColumn("raw", F.col("tf") * idf)
    in_sentence = W.partitionBy(key, "first")
    frequent_first = in_sentence.orderBy(F.desc("df"), F.desc("term"))
    square = F.col("raw") * F.col("raw")
    weights = (
        raw.withColumn("to_come", F.sum(square).over(frequent_first.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("total", F.max("to_come").over(in_sentence))
        .withColumn("w", F.col("raw") / F.sqrt("total"))
        .withColumn("leads", F.col("to_come") / F.col("total") >= threshold * threshold - 1e-9)
    )
    entry = F.struct("df", "term", "w", "leads")
    vectors = weights.groupBy(key, "first", "members").agg(F.sort_array(F.collect_list(entry)).alias("v"))
    return vectors.select(
        key,
        "first",
        "members",
        F.col("v.term").alias("terms"),
        F.col("v.w").alias("ws"),
        F.filter("v", lambda e: e["leads"])["term"].alias("lead"),
    )


def similar_sentences(
    df: DataFrame, key: str, text: str, threshold: float = 0.8, partitioned: bool = False
) -> DataFrame:
    """Sentence vectors of a document that occur more than once or resemble an earlier vector.

    ``first`` is the first sentence with the vector, ``members`` all sentences
    with it, ``earlier`` the array ``(first, n)`` of vectors that occurred before
    and have a cosine above the threshold.

    Terms are ordered from rare to frequent. Two unit vectors with a dot product
    of at least t share a term while the weight behind that term still reaches t
    (otherwise the dot product is at most the length of the rest, below t). Only
    vectors that share such a leading term are compared, so frequent words bring
    nothing together, and copies of a sentence count as one vector.
    """
    docs = df.select(key, text)
    vectors = sentence_vectors(docs if partitioned else by_key(docs, key), key, text, threshold)
    entry = F.struct("first", "members", "terms", "ws", F.size("lead").alias("leads"))
    # A document's vectors meet in its row, as its text does; nothing is copied for a pair.
    whole = vectors.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("v"))
    whole = whole.withColumn("near", _near_earlier("v.terms", "v.ws", "v.leads", threshold))

    def with_earlier(e, i):
        ones = F.transform(F.get("near", i), lambda k: F.struct(
            F.get("v", k)["first"].alias("first"), F.size(F.get("v", k)["members"]).alias("n")
        ))
        return F.struct(e["first"].alias("first"), e["members"].alias("members"), ones.alias("earlier"))

    found = F.filter(F.transform("v", with_earlier), lambda e: (F.size(e["earlier"]) > 0) | (F.size(e["members"]) > 1))
    return whole.select(key, F.explode_outer(found).alias("e")).where("e is not null").select(key, "e.first", "e.members", "e.earlier")


def _near_earlier(terms: str, weights: str, leads: str, threshold: float):
    """For each vector of a document the places of the earlier vectors with a cosine above the threshold."""
    small_text_batches()

    @F.pandas_udf("array<array<int>>")
    def run(all_terms: pd.Series, all_weights: pd.Series, all_leads: pd.Series) -> pd.Series:
        return pd.Series([near_earlier(t, w, n, threshold) for t, w, n in zip(all_terms, all_weights, all_leads, strict=True)])

    return run(terms, weights, leads)


def near_earlier(terms, weights, leads, threshold: float) -> list[list[int]]:
    """Unit vectors as lists of terms (rare ones first, of which so many lead) and weights."""
    if not len(terms):
        return []
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    _, ids = np.unique(np.concatenate([np.asarray(t, dtype=object) for t in terms]).astype(str), return_inverse=True)
    values = np.concatenate([np.asarray(w, dtype=float) for w in weights])
    one = np.zeros(ids.max() + 1)
    holders: dict[int, list[int]] = {}
    out = []
    for i in range(len(terms)):
        own = ids[bounds[i] : bounds[i + 1]]
        lead = own[: int(leads[i])].tolist()
        met = [holders[t] for t in lead if t in holders]
        found: list[int] = []
        if met:
            others = np.unique(np.concatenate(met))
            sizes = bounds[others + 1] - bounds[others]
            at = np.concatenate(([0], np.cumsum(sizes)))
            flat = np.arange(at[-1]) + np.repeat(bounds[others] - at[:-1], sizes)
            one[own] = values[bounds[i] : bounds[i + 1]]
            cosine = np.add.reduceat(one[ids[flat]] * values[flat], at[:-1])
            one[own] = 0
            found = others[np.round(cosine, 9) > threshold].tolist()
        out.append(found)
        for t in lead:
            holders.setdefault(t, []).append(i)
    return out


def redundancy_report(found: DataFrame, key: str) -> DataFrame:
    """Per document the number of similar sentence pairs, counted without listing them."""
    n = F.size("members").cast("long")
    among_copies = (n * (n - 1) / 2).cast("long")
    with_earlier = F.aggregate("earlier", F.lit(0).cast("long"), lambda t, e: t + n * e["n"])
    counted = found.groupBy(key).agg(F.sum(among_copies + with_earlier).alias("similar_pairs"))
    return counted.where("similar_pairs > 0")


def redundant_sentences(
    df: DataFrame, key: str, text: str, threshold: float = 0.8, partitioned: bool = False
) -> DataFrame:
    """Per document an array ``(sent_ix, similar_to)`` of its redundant sentences.

    A sentence is redundant when it is similar to any earlier one, also when that
    earlier sentence is redundant itself.
    """
    found = similar_sentences(df, key, text, threshold, partitioned)
    by = F.array_min(F.transform("earlier", lambda e: e["first"]))
    marks = F.transform(
        "members",
        lambda m: F.struct(m.alias("sent_ix"), F.least(by, F.when(m > F.col("first"), F.col("first"))).alias("similar_to")),
    )
    dropped = F.filter(marks, lambda m: m["similar_to"].isNotNull())
    per_document = found.groupBy(key).agg(F.flatten(F.collect_list(dropped)).alias("redundant"))
    return per_document.where(F.size("redundant") > 0)


def redundant_sentence_rows(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """The report of removed sentences: position, the earlier sentence it repeats, its text."""
    docs = by_key(df.select(key, text), key)
    found = docs.join(redundant_sentences(docs, key, text, threshold, partitioned=True), key)
    rows = found.select(key, T.sentences(text, lower=True).alias("_s"), F.explode("redundant").alias("r"))
    return rows.select(key, "r.sent_ix", "r.similar_to", F.get("_s", F.col("r.sent_ix")).alias("sentence"))


def dedupe_sentences(
    df: DataFrame, key: str, text: str, threshold: float = 0.8, partitioned: bool = False
) -> DataFrame:
    """Texts without their redundant sentences, lower case, joined by spaces.

    The documents meet their short list of redundant positions under the
    partitioning they already have.
    """
    docs = df.select(key, text) if partitioned else by_key(df.select(key, text), key)
    redundant = redundant_sentences(docs, key, text, threshold, partitioned=True)
    gone = F.coalesce(F.col("redundant.sent_ix"), F.array().cast("array<int>"))
    kept = F.filter(T.sentences(text, lower=True), lambda s, i: ~F.array_contains(gone, i))
    return docs.join(redundant, key, "left").select(key, F.array_join(kept, " ").alias(text))


# --------------------------------------------------------------------- summary


def document_terms(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = fixed.STOP_WORDS) -> DataFrame:
    """Count of every term of a document, without stop words and punctuation."""
    return document_term_counts(df, key, text, T.word_tokens).where(_significant(stop_words))


def _significant(stop_words: Sequence[str]):
    in_punctuation = F.contains(F.lit(fixed.PUNCTUATION), F.col("term"))
    return ~F.col("term").isin(list(stop_words)) & ~in_punctuation


def sentence_scores(sents: DataFrame, key: str, stop_words: Sequence[str] = fixed.STOP_WORDS) -> DataFrame:
    """Score of every sentence: the sum of the document counts of its terms, 0 without a counted term.

    ``sents`` are sentence rows of documents partitioned by key.
    """
    terms = sents.select(key, "sent_ix", F.explode_outer(T.word_tokens("sentence")).alias("term"))
    counts = terms.groupBy(key, "sent_ix", "term").agg(F.count("*").alias("n"))
    in_document = F.sum("n").over(W.partitionBy(key, "term"))
    counted = F.coalesce(_significant(stop_words), F.lit(False))
    points = F.when(counted, F.col("n") * F.col("all")).otherwise(0)
    return counts.withColumn("all", in_document).groupBy(key, "sent_ix").agg(F.sum(points).alias("score"))


def summarize(
    df: DataFrame,
    key: str,
    text: str,
    best: int = 3,
    stop_words: Sequence[str] = fixed.STOP_WORDS,
    order: str = "score",
    redundant: DataFrame | None = None,
    partitioned: bool = False,
) -> DataFrame:
    """The best sentences of a document, in score order or in document order.

    Ties go to the earlier sentence. With ``redundant`` (see
    ``redundant_sentences``) the summary is that of the lower-case text without
    those sentences. Only positions are ranked; the sentences are then picked
    from the text under the partitioning it has.
    """
    docs = df.select(key, text) if partitioned else by_key(df.select(key, text), key)
    lower = redundant is not None
    if lower:
        gone = redundant.select(key, F.col("redundant.sent_ix").alias("gone"))
        sents = sentence_rows(docs.join(gone, key, "left"), key, text, lower, keep=["gone"])
        removed = F.coalesce("gone", F.array().cast("array<int>"))
        places = F.sequence(F.lit(0), F.col("n_sents") - 1)
        first_left = F.array_min(F.filter(places, lambda i: ~F.array_contains(removed, i)))
        # marks without words at the very start of a text belong to no sentence
        no_start = F.when(F.col("sentence").rlike("^[.!?]"), F.col("sent_ix") == first_left).otherwise(F.lit(False))
        sents = sents.where(~F.array_contains(removed, F.col("sent_ix")) & ~no_start)
    else:
        sents = sentence_rows(docs, key, text)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "sent_ix")))
    top = sentence_scores(sents, key, stop_words).groupBy(key).agg(F.slice(ranked, 1, best)["sent_ix"].alias("top"))
    chosen = F.sort_array("top") if order == "document" else F.col("top")
    picked = F.array_join(F.transform(chosen, lambda i: F.get(F.col("_s"), i)), " ")
    return (
        docs.join(top, key, "left")
        .withColumn("_s", T.sentences(text, lower))
        .select(key, F.coalesce(picked, F.lit("")).alias(text))
    )


# ------------------------------------------------------------------- transform


def transform_long_texts(
    df: DataFrame,
    key: str,
    text: str,
    threshold: int = 200,
    similarity: float = 0.8,
    best: int = 3,
) -> DataFrame:
    """Long texts lose redundant sentences and become summaries; others pass through.

    Short texts never enter the costly branch and are not shuffled. The other
    columns of long rows join their summary by key.
    """
    words = T.word_count(text)
    is_long = words >= threshold
    short = df.where(~F.coalesce(is_long, F.lit(False)))
    long_ = df.where(is_long)
    docs = by_key(long_.select(key, text), key)
    redundant = redundant_sentences(docs, key, text, similarity, partitioned=True)
    summaries = summarize(docs, key, text, best, redundant=redundant, partitioned=True)
    rest = long_.drop(text).join(summaries, key, "left").withColumn(text, F.coalesce(text, F.lit("")))
    return short.unionByName(rest.select(*df.columns))


def transform_stats(before: DataFrame, after: DataFrame, text: str) -> DataFrame:
    """Text statistics of both phases, one row each."""
    return (
        text_stats(before, text).withColumn("phase", F.lit("before"))
        .unionByName(text_stats(after, text).withColumn("phase", F.lit("after")))
    )


def transform_report(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """Texts that changed, before and after."""
    new = after.select(key, F.col(text).alias("after"))
    old = before.select(key, F.col(text).alias("before"))
    return old.join(new, key).where(~F.col("before").eqNullSafe(F.col("after")))
