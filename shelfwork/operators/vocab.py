"""Vocabulary, sequences, n-grams, spelling, language and feature counts.

A vocabulary is capped by its number of ids, so it is the one table here whose
size is known: it is broadcast. Term counts are summed on the map side, which
takes the weight out of frequent words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..scale import bounded, by_key, join_dim, kept, small_text_batches

OOV = "<OOV>"
OOV_ID = 1
MAX_BROADCAST_TERMS = 200_000


def term_counts(df: DataFrame, text: str, by: Sequence[str] = (), tokens=T.vocabulary_tokens) -> DataFrame:
    terms = df.select(*by, F.explode(tokens(text)).alias("term"))
    return terms.groupBy(*by, "term").agg(F.count("*").alias("n"))


def row_terms(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, n): the terms of each row, counted where the row is.

    The row's tokens are sorted, and the places where a run of equal ones ends
    give the counts: a task holds one row's tokens at a time and nothing is shuffled.
    """
    ordered = df.select(key, F.sort_array(tokens).alias("_t"))
    end = lambda t, i: F.when(~t.eqNullSafe(F.get("_t", i + 1)), F.struct(t.alias("term"), (i + 1).alias("upto")))
    ends = ordered.select(key, F.filter(F.transform("_t", end), lambda e: e.isNotNull()).alias("_e"))
    before = lambda i: F.coalesce(F.get("_e", i - 1)["upto"], F.lit(0))
    run = lambda e, i: F.struct(e["term"].alias("term"), (e["upto"] - before(i)).cast("long").alias("n"))
    return ends.select(key, F.explode(F.transform("_e", run)).alias("e")).select(key, "e.term", "e.n")


#: Characters of text whose terms one task sums, when several rows have one key.
SUMMED_CHARS = 16_000_000


def document_term_counts(df: DataFrame, key: str, text: str, tokens=T.vocabulary_tokens) -> DataFrame:
    """(key, term, n): the terms of each text. Only rows that share their key, null too, meet in a grouping."""
    of = df.groupBy(F.col(key).alias("_of")).agg(F.count("*").alias("_n")).where("_n > 1").select("_of")
    repeated = bounded(of)
    if repeated is None:
        return _summed_terms(df, key, text, tokens)
    same = df[key].eqNullSafe(repeated["_of"])
    alone = row_terms(df.join(F.broadcast(repeated), same, "left_anti"), key, tokens(text))
    if repeated.isEmpty():
        return alone
    return alone.unionByName(_summed_terms(df.join(F.broadcast(repeated), same, "left_semi"), key, text, tokens))


def _summed_terms(df: DataFrame, key: str, text: str, tokens) -> DataFrame:
    """Terms counted in their rows and summed by key, in as many tasks as the texts' size calls for."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    rows = row_terms(df, key, tokens(text)).repartition(max(least, -(-chars // SUMMED_CHARS)), key, "term")
    return rows.groupBy(key, "term").agg(F.sum("n").alias("n"))


def corrected_words(df: DataFrame, before: str, after: str) -> DataFrame:
    """(old, new, n): words that a correction changed, word by word, and how often; texts keep their blanks."""
    pair = F.arrays_zip(F.split(before, " ").alias("old"), F.split(after, " ").alias("new"))
    pairs = df.select(F.explode(pair).alias("p")).select("p.old", "p.new")
    return pairs.where("old <> new").groupBy("old", "new").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, text: str, num_words: int = 60_000) -> DataFrame:
    """Ids below ``num_words``: 1 is for unknown words, the rest by falling count, ties by word."""
    kept = term_counts(df, text).orderBy(F.desc("n"), "term").limit(max(num_words - 2, 0))
    rank = F.row_number().over(W.orderBy(F.desc("n"), "term"))  # at most num_words rows
    return kept.select("term", "n", (rank + OOV_ID).alias("term_id"))


def _dim(df: DataFrame, vocab: DataFrame, on: str, num_words: int) -> DataFrame:
    if num_words <= MAX_BROADCAST_TERMS:
        return df.join(F.broadcast(vocab), on, "left")
    return df.join(vocab, on, "left")


def encode_sequences(
    df: DataFrame, key: str, text: str, vocab: DataFrame, length: int = 200, num_words: int = 60_000
) -> DataFrame:
    """Word ids cut and padded with 0 at the end to a fixed length, and the mask of real words.

    Only the first ``length`` words can appear in the result, so only they are
    looked up.
    """
    words = F.slice(T.vocabulary_tokens(text), 1, length)
    rows = by_key(df.select(key, text), key).select(key, F.posexplode_outer(words).alias("pos", "term"))
    ids = _dim(rows, vocab.select("term", "term_id"), "term", num_words)
    found = F.when(F.col("term").isNotNull(), F.struct("pos", F.coalesce("term_id", F.lit(OOV_ID)).alias("id")))
    grouped = ids.groupBy(key).agg(F.sort_array(F.collect_list(found))["id"].alias("_ids"))
    used = F.size("_ids")
    pad = F.array_repeat(F.lit(0), F.lit(length) - used)
    mask = F.concat(F.array_repeat(F.lit(1), used), pad)
    return grouped.select(key, F.concat("_ids", pad).alias("ids"), mask.alias("mask"))


def decode_sequences(df: DataFrame, key: str, ids: str, vocab: DataFrame, num_words: int = 60_000) -> DataFrame:
    """Words of the ids, padding skipped, unknown words as ``<OOV>``."""
    rows = df.select(key, F.posexplode_outer(ids).alias("pos", "term_id"))
    words = _dim(rows, vocab.select("term", "term_id"), "term_id", num_words)
    word = F.when(F.col("term_id") == OOV_ID, F.lit(OOV)).otherwise(F.col("term"))
    used = F.when(F.col("term_id") > 0, F.struct("pos", word.alias("w")))
    ordered = F.sort_array(F.collect_list(used))["w"]
    return words.groupBy(key).agg(F.array_join(ordered, " ").alias("text"))


def corpus_tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """Count times ln((N + 1) / (df + 1)) of every word, one row per text and word."""
    docs = by_key(df.select(key, text), key)
    counts = document_term_counts(docs, key, text)
    kept = counts.groupBy("term").agg(F.count("*").alias("df"))
    texts = df.agg(F.count("*").alias("texts"))
    weighed = counts.join(kept, "term")
    idf = F.log((texts.scalar() + F.lit(1.0)) / (F.col("df") + F.lit(1.0)))
    return weighed.select(key, "term", (F.col("n") * idf).alias("weight"))


def char_ngram_counts(df: DataFrame, text: str, sizes: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """Counts of all character n-grams."""
    grams = F.flatten(F.array(*[T.char_ngrams(text, n) for n in sizes]))
    return df.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def word_ngram_counts(df: DataFrame, text: str, n: int = 2) -> DataFrame:
    tokens = df.select(T.vocabulary_tokens(text).alias("tokens"))
    grams = tokens.select(F.explode(T.word_ngrams("tokens", n)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, label: str, text: str, k: int = 20, tokens=T.vocabulary_tokens) -> DataFrame:
    """The k most frequent words (or sentences) per class."""
    counts = term_counts(df, text, [label], tokens)
    rank = F.row_number().over(W.partitionBy(label).orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


# ------------------------------------------------------------------ glued words


#: Most frequent terms that every task holds; bits of a Bloom filter at most, and for each of its entries.
KNOWN, BITS, BITS_EACH = 100_000, 1 << 26, 16
#: Ends of tokens in a range that is walked through at once, about; ends sampled for each bound of a range.
RANGE_ENDS, SAMPLED_ENDS = 200_000, 20
#: Ends that are passed on together.
ENDS_AT_ONCE = 20_000
BITMAP = 1 << 15  # bits in a row of Spark's bitmap functions
_LOW = 0xFFFFFFFF
#: Words that a task remembers the filter's answers for.
REMEMBERED = 500_000


def bloom(df: DataFrame, column: str, entries: int) -> np.ndarray:
    """A Bloom filter of a column's values, as bits: made in Spark from partial bitmaps, BITS in size at most.

    Its size goes with ``entries``, rounded up to a power of two; beyond BITS it only lets more through.
    """
    size = max(BITMAP, min(BITS, 1 << max(BITS_EACH * entries - 1, 1).bit_length()))
    h = F.xxhash64(column)
    low, high = h.bitwiseAND(_LOW), F.shiftrightunsigned(h, 32)
    places = F.explode(F.array(*[(low + i * high) % size for i in range(4)]))
    rows = df.select(places.alias("place")).groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket"))
    bits = np.zeros(size >> 3, np.uint8)
    for r in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits")).collect():
        start = (r["bucket"] - 1) * (BITMAP >> 3)
        bits[start : start + (BITMAP >> 3)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def may_hold(bits: np.ndarray | bytes, value: str) -> bool:
    """Whether the filter may hold the value; never false for one that it holds."""
    h = xxhash.xxh64_intdigest(value.encode(), 42)  # as Spark's xxhash64
    low, high, mask = h & _LOW, h >> 32, 8 * len(bits) - 1
    for i in range(4):
        place = (low + i * high) & mask
        if not bits[place >> 3] >> (place & 7) & 1:
            return False
    return True


def most_frequent(counts: DataFrame, terms: int) -> tuple[pa.Table, int]:
    """The terms (term, n) that occur ``cut`` times or more, and ``cut``: as many as fit in ``terms``.

    Terms that occur equally often are taken or left together, so that the driver
    gets the numbers of terms for each count and then the taken terms, and no task ranks its own.
    """
    cut, taken = None, 0
    sizes = counts.groupBy("n").agg(F.count("*").alias("terms")).orderBy(F.desc("n")).limit(max(terms, 1)).collect()
    for r in sizes:  # different counts are few: their sum is the number of words
        taken += r["terms"]
        if taken > terms:
            break
        cut = r["n"]
    if cut is None:
        cut = sizes[0]["n"] + 1 if sizes else 1
    return counts.where(F.col("n") >= cut).select("term", F.col("n").cast("long").alias("n")).toArrow(), cut


def _bounds(tokens: DataFrame, head: int) -> list[str]:
    """Beginnings of ends of tokens that cut all of them into ranges of about RANGE_ENDS; a frequent one comes several times."""
    n, letters = tokens.agg(F.count("*"), F.sum(F.length("token"))).first()
    ranges = -(-(letters or 0) // RANGE_ENDS)
    if ranges < 2:
        return []
    wanted = max(100, SAMPLED_ENDS * ranges * n // letters)
    hashed = F.pmod(F.xxhash64(F.lit("range"), F.col("token")), F.lit(1 << 31))
    drawn = tokens.where(hashed <= int((1 << 31) * min(1.0, 2 * wanted / n))).orderBy(hashed).limit(wanted)
    some = [r[0] for r in drawn.select(F.substring("token", 1, 1000)).collect()]
    ends = sorted(t[i : i + head] for t in some for i in range(len(t)))
    return [ends[len(ends) * k // ranges] for k in range(1, ranges)] if ends else []


def ranges_of_term(term: str, bounds: list[str]) -> list[int]:
    """The ranges with texts that begin with the term: its own one, and those whose first text does."""
    at = bisect_left(bounds, term)
    found = [] if at < len(bounds) and bounds[at] == term else [at]
    while at < len(bounds) and bounds[at].startswith(term):
        at += 1
        found.append(at)
    return found


def range_of_end(text: str, number: int, bounds: list[str]) -> int:
    """The range of a text; one that is several bounds is dealt over their ranges by its number."""
    at = bisect_right(bounds, text)
    if at > 1 and bounds[at - 2] == text:
        at -= number % (at - bisect_left(bounds, text))
    return at


def _met(tokens: DataFrame, terms: DataFrame, head: int) -> DataFrame:
    """(id, start, size, n, tail) of the terms met in the tokens (id, token), but for what is in ``tail``, the letters of a term after the first ``head``.

    The ends of all tokens and the terms are dealt out by ranges of their first
    letters and sorted. The terms that a text begins with are then the last ones before it that begin with
    one another, so a task goes through its rows once and holds no more than these.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(_bounds(tokens, head))
    columns, kinds = ["range", "text", "start", "n", "tail"], "range int, text string, start int, n long, tail string"

    def dealt(rows: list[tuple]) -> pa.RecordBatch:
        ranges, texts, starts, ns, tails = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ns, pa.int64()), pa.array(tails, pa.string())], columns)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            rows = []
            for term, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = term[:head]
                rows += [(at, text, -len(term), n, term[head:] or None) for at in ranges_of_term(text, bounds)]
            if rows:
                yield dealt(rows)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            rows = []
            for number, token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start in range(len(token)):
                    text = token[start : start + head]
                    rows.append((range_of_end(text, number, bounds), text, start, number, None))
                    if len(rows) >= ENDS_AT_ONCE:
                        yield dealt(rows)
                        rows = []
            if rows:
                yield dealt(rows)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, above = None, []  # the terms that the last text begins with: text, size, n, tail
        for batch in batches:
            found = []
            for at, text, start, n, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    now, above = at, []
                while above and not text.startswith(above[-1][0]):
                    above.pop()
                if start < 0:
                    above.append((text, -start, n, tail))
                else:
                    found += [(n, start, *term[1:]) for term in above]
            if found:
                ids, starts, sizes, ns, tails = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ns, pa.int64()), pa.array(tails, pa.string())], ["id", "start", "size", "n", "tail"])

    rows = terms.select("term", "n").mapInArrow(begun, kinds).unionByName(tokens.select("id", "token").mapInArrow(ends, kinds))
    ordered = rows.repartition("range").sortWithinPartitions("range", "text", "start")  # terms have starts below 0
    return ordered.mapInArrow(walked, "id long, start int, size int, n long, tail string")


def word_splits(tokens: DataFrame, counts: DataFrame, head: int = 24, known_terms: int = KNOWN) -> DataFrame:
    """(token, split) of the distinct tokens that fall into several likely words.

    ``counts`` (term, n) may be of any size. Tasks hold the most frequent terms,
    ``known_terms`` at most; all others meet the tokens by sorting, and only what is met comes back to a token.
    Terms longer than ``head`` letters meet by their first ones and are then compared
    whole. A token is split into the pieces of the highest joint probability;
    unknown pieces of n letters count as 10 / (total * 10 ** n).
    """
    counts = kept(counts.where(F.length("term") > 0).select("term", F.col("n").cast("long").alias("n")), "terms")
    size, total = counts.agg(F.count("*"), F.sum("n")).first()
    top, cut = most_frequent(counts, known_terms)
    distinct = tokens.select("token").where(F.length("token") > 0).distinct()
    shared = tokens.sparkSession.sparkContext.broadcast(top)
    if size > len(top):
        rows = kept(distinct.withColumn("id", F.monotonically_increasing_id()), "tokens")
        met = _met(rows, counts.where(F.col("n") < cut), head).groupBy("id").agg(F.collect_list(F.struct("start", "size", "n", "tail")).alias("met"))
        rows = rows.join(met, "id", "left").select("token", "met")
    else:
        rows = distinct.withColumn("met", F.lit(None).cast("array<struct<start:int,size:int,n:bigint,tail:string>>"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = list(zip(*(c.to_pylist() for c in shared.value.columns), strict=True))
        short = {t: n for t, n in terms if len(t) <= head}
        long: dict[str, list] = {}
        for t, n in terms:
            if len(t) > head:
                long.setdefault(t[:head], []).append((t, n))
        for batch in batches:
            whole, parts = [], []
            for token, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = [m for m in met or () if m["tail"] is None or token.startswith(m["tail"], m["start"] + head)]
                for start in range(len(token)):
                    for end in range(start + 1, min(start + head, len(token)) + 1):
                        n = short.get(token[start:end])
                        if n is not None:
                            pieces.append({"start": start, "size": end - start, "n": n})
                    for t, n in long.get(token[start : start + head], ()):
                        if token.startswith(t, start):
                            pieces.append({"start": start, "size": len(t), "n": n})
                found = best_split(token, pieces, total)
                if found != token:
                    whole.append(token)
                    parts.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.string()), pa.array(parts, pa.string())], ["token", "split"])

    return rows.mapInArrow(split, "token string, split string")


def best_split(token: str, known, total: float) -> str:
    """The pieces of the token with the highest joint probability; of equals the longest last piece."""
    total = float(total or 1)
    unknown, ending = log10(10.0 / total), {}
    for k in known:
        ending.setdefault(k["start"] + k["size"], []).append((k["start"], log10(k["n"] / total)))
    best, free = [(0.0, 0)], (0.0, 0)  # free: where an unknown piece starts best, as each of its letters costs one
    for end in range(1, len(token) + 1):
        options = [(best[start][0] + score, -start) for start, score in ending.get(end, ())]
        score, start = max([(free[0] + unknown - end, free[1]), *options])
        best.append((score, -start))
        free = max(free, (score + end, -end))
    pieces, end = [], len(token)
    while end > 0:
        pieces.append(token[best[end][1] : end])
        end = best[end][1]
    return " ".join(reversed(pieces))


def split_glued_words(df: DataFrame, key: str, text: str, counts: DataFrame, head: int = 24, known_terms: int = KNOWN) -> DataFrame:
    """``text`` with its glued words split, words of letters in lower case, white space as one blank.

    Every distinct word is split once. Texts are read as they are, word by word in Python (whose
    white space and letters are those of all scripts), and not taken apart: a
    filter of the words that fall apart tells which of a text's words
    are worth asking for, and only these, once for each key, travel.
    """
    small_text_batches(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = set().union(*(t.split() for t in batch.column(0).to_pylist() if t is not None))
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w.lower() for w in words if w.isalpha()}), pa.string())], ["token"])

    splits = kept(word_splits(df.select(text).mapInArrow(own_words, "token string"), counts, head, known_terms), "splits")
    shared = df.sparkSession.sparkContext.broadcast(bloom(splits, "token", splits.count()).tobytes())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, {}
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            at, found = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for token in {w.lower() for w in set((value or "").split()) if w.isalpha()}:
                    if token not in seen:
                        seen[token] = may_hold(bits, token)
                    if seen[token]:
                        at.append(row)
                        found.append(token)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["_key", "token"])

    hits = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(asked, f"_key {kind}, token string").distinct()
    maps = join_dim(hits, splits, ["token"], "inner", spread_on=["_key"]).groupBy("_key").agg(
        F.collect_list(F.struct("token", "split")).alias("_splits")
    )
    joined = df.join(maps, df[key].eqNullSafe(maps["_key"]), "left")

    @F.pandas_udf("string")
    def spelt(texts: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for value, known in zip(texts, pairs, strict=True):
            table = {p["token"]: p["split"] for p in known} if known is not None else {}
            words = [] if value is None else [w.lower() if w.isalpha() else w for w in value.split()]
            out.append(None if value is None else " ".join([table.get(w, w) for w in words] if table else words))
        return pd.Series(out, dtype=object)

    return joined.withColumn(text, spelt(text, "_splits")).select(*df.columns)


# ---------------------------------------------------------------------- spelling


def _variants(term: str):
    """A word and all words one letter shorter."""
    word = F.col(term)
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )
    return F.array_distinct(F.concat(F.array(word), cut))


def spelling_fixes(
    df: DataFrame, text: str, rare: int = 1, frequent: int = 20, min_length: int = 4
) -> DataFrame:
    """Rare words with a frequent word one edit away; the most frequent one wins, ties by word.

    Two words are at most one edit apart only if they share a variant with one
    letter less (or are one themselves). Joining on variants finds all pairs
    without comparing every rare word to every frequent one.
    """
    counts = term_counts(df, text).where(F.length("term") >= min_length)
    # a rare word of a length that no frequent word is near has no partner and makes no variants
    near_length = F.explode(F.sequence(F.length("term") - 1, F.length("term") + 1)).alias("size")
    lengths = counts.where(F.col("n") >= frequent).select(near_length).distinct()
    rare_words = counts.where(F.col("n") <= rare).withColumn("size", F.length("term")).join(lengths, "size", "left_semi")
    odd = rare_words.select("term", F.explode(_variants("term")).alias("v"))
    known = counts.where(F.col("n") >= frequent).select(
        F.col("term").alias("fix"), F.col("n").alias("fix_n"), F.explode(_variants("term")).alias("v")
    )
    near = odd.join(known, "v").where(F.levenshtein("term", "fix") <= 1)
    first = near.groupBy("term").agg(F.min(F.struct((-F.col("fix_n")).alias("m"), F.col("fix"))).alias("f"))
    return first.select("term", F.col("f.fix").alias("fix"), (-F.col("f.m")).alias("fix_n"))


# ---------------------------------------------------------------------- language


GRAM = 3
_LETTER = 21  # bits of a code point


def _gram_codes(text: str) -> np.ndarray:
    """A number for each run of GRAM characters."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = max(len(letters) - GRAM + 1, 0)
    codes = np.zeros(n, np.int64)
    for i in range(GRAM):
        codes = codes << _LETTER | letters[i : i + n]
    return codes


def _gram_of(code: int) -> str:
    return "".join(chr(code >> _LETTER * i & (1 << _LETTER) - 1) for i in reversed(range(GRAM)))


#: Letters whose trigrams are counted at once; trigrams of all languages that a task holds, about, before it passes their counts on.
LETTERS, HELD_GRAMS = 1 << 20, 1 << 20


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of several (codes, counts) and their counts in all."""
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, at, np.concatenate([m for _, m in parts]))
    return codes, n


def language_profiles(df: DataFrame, language: str, text: str, size: int = 300) -> DataFrame:
    """The most frequent trigrams per language with their share in parts per million.

    Texts are read once: trigrams are counted where they are read, a bounded number of
    letters at a time, and what is summed is one row for each trigram of a language
    and task, or more if a task meets too many to hold.
    """
    small_text_batches(df.sparkSession)
    rows = df.select(F.col(language).alias("language"), F.lower(F.col(text)).alias("text")).where("text IS NOT NULL")
    kind = rows.schema["language"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[object, list[np.ndarray]] = {}
        letters, names = 0, None

        def count() -> int:
            for name, codes in waiting.items():
                held[name] = [_summed([*held.get(name, []), np.unique(np.concatenate(codes), return_counts=True)])]
            waiting.clear()
            return sum(len(parts[0][0]) for parts in held.values())

        def passed_on() -> Iterator[pa.RecordBatch]:
            for name, [(found, n)] in held.items():
                grams = pa.array([_gram_of(c) for c in found.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), names), grams, pa.array(n)], ["language", "gram", "n"])
            held.clear()

        for batch in batches:
            names = batch.column(0).type
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                codes = _gram_codes(value.as_py())
                if not len(codes):
                    continue
                waiting.setdefault(name.as_py(), []).append(codes)
                letters += len(codes)
                if letters >= LETTERS:
                    letters = 0
                    if count() >= HELD_GRAMS:
                        yield from passed_on()
        count()
        yield from passed_on()

    counts = rows.mapInArrow(counted, f"language {kind}, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    whole = W.partitionBy("language")
    counts = counts.withColumn("_total", F.sum("n").over(whole))
    rank = F.row_number().over(whole.orderBy(F.desc("n"), "gram"))
    share = F.floor(F.col("n") * 1_000_000 / F.col("_total")).cast("bigint")
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= size).select(F.col("language").alias(language), "gram", share.alias("share"))


def detect_language(df: DataFrame, key: str, text: str, profiles: DataFrame, language: str) -> DataFrame:
    """The language whose profile weighs a text's trigrams highest, ties by name; null without a known trigram.

    Profiles are a fixed number of rows for each language, so every task holds them;
    texts are scored where they are, one row each, without a shuffle.
    """
    small_text_batches(df.sparkSession)
    known = profiles.dropna().orderBy(language, "gram").collect()
    names = sorted({r[language] for r in known})
    codes = np.array(sorted({int(_gram_codes(r["gram"])[0]) for r in known}), np.int64)
    shares = np.zeros((len(codes) + 1, max(len(names), 1)), np.int64)
    for r in known:
        shares[np.searchsorted(codes, _gram_codes(r["gram"])[0]), names.index(r[language])] = r["share"]
    shared = df.sparkSession.sparkContext.broadcast((names, codes, shares))
    rows = df.select(key, F.lower(F.col(text)).alias("_text"))
    kind, named = rows.schema[key].dataType.simpleString(), profiles.schema[language].dataType
    kinds = to_arrow_type(named)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grams, weights = shared.value
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                found = _gram_codes(value or "")
                at = np.searchsorted(grams, found)
                at = at[at < len(grams)] if not len(grams) else at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == found)]
                total = weights[at].sum(axis=0)
                out.append(own[int(total.argmax())] if len(at) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kinds)], [key, "detected"])

    return rows.mapInArrow(scored, f"`{key}` {kind}, detected {named.simpleString()}")
