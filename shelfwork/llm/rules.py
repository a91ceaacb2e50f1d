"""Quality rules with thresholds that follow the data, in DataFrame operations only.

Four numbers of each document (length of words, symbols, repeated lines and
repeated passages) are set against the documents of its language and source. A
sketch of a number is a count for each bucket of values; buckets grow with the
value and hold it to within one part in 128. Sketches merge by adding counts: those of
a source into the language's, those into the whole corpus's. Their quartiles give
the fences beyond which a document is dropped; fences are joined to documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import query, salted_join, small, stored, table
from .decontaminate import rolled

BLANKS = " \t\n\x0b\x0c\r"
SEPARATORS, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Words in the windows that count as repeated passages.
WINDOW = 8
#: The fixed rules: fewer words, or a larger share of words (in percent) in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = "#*$%&|<>"
#: Thousandths: what is measured, of what, the smallest spread between quartiles, whether small values fail too.
RULES = {
    "word_length": ("word_chars", "n_words", 100, True),
    "symbols": ("n_symbols", "n_words", 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 100, False),
    "repeated": ("n_repeat_words", "n_words", 50, False),
}
#: Spreads beyond the quartiles that are still kept; documents that a sketch needs to speak for its own.
FENCE, ENOUGH = 5, 200
#: Leading bits of a value that tell its bucket.
BITS = 8


def _pairs(column: str, join) -> Column:
    """``join`` of each element and the next."""
    n = F.greatest(F.size(column) - 1, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, 2, n), join)


def measures(docs: DataFrame, also: dict[str, Column], text: str = "text", window: int = WINDOW) -> DataFrame:
    """``also``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of each row.

    Windows are known by a 64-bit hash. They are sorted by it beside their places,
    so that equal ones are neighbours, whatever the length of the text.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("windows are made by doubling")
    of = F.col("_text")
    lines = F.filter(F.split(of, "\n"), lambda line: line.rlike(WORD))
    df = docs.select(*[c.alias(name) for name, c in also.items()], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.select(
        *also, F.length(F.translate(of, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(of) - F.length(F.translate(of, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), F.array_remove(F.split(of, SEPARATORS), "").alias("_words"),
    )
    df = df.withColumn("_hashes", _pairs("_words", lambda v, w: F.xxhash64(v, w)))
    df = rolled(df, "_hashes", 2, window, lambda v, w: F.xxhash64(v, w))
    df = df.withColumn("_sorted", F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twins = _pairs("_sorted", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_places", F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins)))))
    covered = F.aggregate(_pairs("_places", lambda a, b: F.least(b - a, F.lit(window))), F.lit(0), lambda total, n: total + n)
    return df.select(
        *also, F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_places") > 0, covered + window).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _thousandths(rule: str) -> Column:
    of, by, *_ = RULES[rule]
    return F.expr(f"1000 * {of} div nullif({by}, 0)")


def bucket_of(value: Column) -> Column:
    """The bucket of a whole number that is not negative: itself below 2**BITS, then 2**(BITS - 1) buckets for each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return shift.cast("long") * (1 << BITS - 1) + F.call_function("shiftright", value, shift)


def least_of(bucket: Column) -> Column:
    """The smallest value of a bucket."""
    half = 1 << BITS - 1
    shift = F.greatest(F.floor(bucket / half).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", bucket - shift.cast("long") * half, shift)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, rule, bucket, n): a sketch for each group and rule, of its documents that have a word."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket_of(_thousandths(r)).alias("bucket")) for r in RULES]))
    rows = measured.filter("n_words > 0").select(*keys, values.alias("v"))
    return rows.groupBy(*keys, "v.rule", "v.bucket").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of fewer keys, as the sums of those of more."""
    return parts.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(parts: DataFrame, keys: list[str], fence: int = FENCE) -> DataFrame:
    """(*keys, rule, documents, low, high) of sketches: ``fence`` spreads below and above the quartiles."""
    group = W.partitionBy(*keys, "rule")  # at most as many rows as there are buckets
    upto, total = F.sum("n").over(group.orderBy("bucket")), F.sum("n").over(group)
    counted = parts.withColumn("upto", upto).withColumn("documents", total)

    def quartile(percent: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("documents"), F.col("bucket")))

    out = counted.groupBy(*keys, "rule").agg(F.first("documents").alias("documents"), quartile(25).alias("q1"), quartile(75).alias("q3"))
    q1, q3 = least_of(F.col("q1")), least_of(F.col("q3") + 1) - 1
    floor = reduce(lambda rest, r: F.when(F.col("rule") == r, F.lit(RULES[r][2])).otherwise(rest), RULES, F.lit(0))
    two_sided = F.col("rule").isin([r for r in RULES if RULES[r][3]])
    spread = F.greatest(q3 - q1, floor)
    return out.select(
        *keys, "rule", "documents", F.when(two_sided, q1 - fence * spread).otherwise(-1).cast("long").alias("low"), (q3 + fence * spread).cast("long").alias("high")
    )


def limits(parts: DataFrame, keys: list[str], enough: int = ENOUGH) -> DataFrame:
    """(*keys, low_*, high_* of each rule): fences of a group's own sketch, or of the first of its wider ones with ``enough`` documents.

    Wider sketches are merged from all groups that share one key less, down to the whole corpus.
    """
    found = fences(parts, keys)
    for size in range(len(keys) - 1, -1, -1):
        parts = stored(merged(parts, keys[:size]), "sketches")
        wide = fences(parts, keys[:size]).select(*keys[:size], "rule", *[F.col(c).alias(f"wide_{c}") for c in ("documents", "low", "high")])
        own = F.col("documents") >= enough
        found = found.join(small(stored(wide, "fences")), [*keys[:size], "rule"]).select(
            *keys, "rule", *[F.when(own, F.col(c)).otherwise(F.col(f"wide_{c}")).alias(c) for c in ("documents", "low", "high")]
        )
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{c}_{r}") for r in RULES for c in ("low", "high")]
    )


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source"), enough: int = ENOUGH) -> DataFrame:
    """One row per row of ``docs``: key, the five counts, base_failed and kept.

    Null and empty texts have no words and fail the fixed rules. Null languages and
    sources are groups of their own. Groups of fewer than ``enough`` documents, new
    sources above all, are judged by their language, small languages by the whole
    corpus. Repeated rows count each time and are judged alike; an empty table has no rows;
    a value on a fence is kept. Other columns are not looked at.
    """
    keys = [f"_group{i}" for i in range(len(groups))]
    also = {"_key": F.col(key)} | {k: F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")) for k, g in zip(keys, groups, strict=True)}
    measured = stored(measures(docs, also, text), "measures")
    parts = stored(sketches(measured, keys), "sketches")
    out = salted_join(measured, stored(limits(parts, keys, enough), "limits"), keys, F.struct("_key", "n_words", "word_chars"))
    inside = [F.coalesce(_thousandths(r).between(F.col(f"low_{r}"), F.col(f"high_{r}")), F.lit(True)) for r in RULES]
    return out.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & reduce(lambda a, b: a & b, inside)).alias("kept"),
    )


def _sql() -> str:
    """The query in DuckDB's SQL."""
    half = 1 << BITS - 1
    values = ", ".join(f"('{r}', 1000 * {of} // nullif({by}, 0), {floor}, {str(two).lower()})" for r, (of, by, floor, two) in RULES.items())
    low = f"case when {{0}} < {2 * half} then {{0}} else ({{0}} - ({{0}} // {half} - 1) * {half}) << ({{0}} // {half} - 1) end"
    levels = []
    for name, keys in (("own", "lang, source"), ("by_lang", "lang, null"), ("whole", "null, null")):
        levels.append(f"""{name} as (select l, s, rule, documents, case when two then q1 - {FENCE} * spread else -1 end as low, q3 + {FENCE} * spread as high from (
            select l, s, rule, documents, two, q1, q3, greatest(q3 - q1, floor) as spread from (
            select l, s, rule, any_value(documents) as documents, any_value(floor) as floor, any_value(two) as two,
                {low.format(f"min(b) filter (100 * upto >= 25 * documents)")} as q1, {low.format(f"(min(b) filter (100 * upto >= 75 * documents) + 1)")} - 1 as q3 from (
            select *, sum(n) over (partition by l, s, rule order by b) as upto, sum(n) over (partition by l, s, rule) as documents from (
            select {keys.split(', ')[0]} as l, {keys.split(', ')[1]} as s, rule, floor, two, b, count(*) as n from valued group by all)) group by l, s, rule)))""")
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
windows as (select rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as s from (select rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
twins as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as c from windows) where c > 1),
repeated as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + {WINDOW})) as p from twins) group by rid),
m as (select w.rid, doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from w left join repeated using (rid)),
valued as (select m.*, rule, v, floor, two, case when length(bin(v)) > {BITS} then (length(bin(v)) - {BITS}) * {half} + (v >> (length(bin(v)) - {BITS})) else v end as b
    from m, lateral (values {values}) x(rule, v, floor, two) where n_words > 0),
{', '.join(levels)},
checked as (select v.rid, bool_and(coalesce(v.v between case when o.documents >= {ENOUGH} then o.low when g.documents >= {ENOUGH} then g.low else h.low end
        and case when o.documents >= {ENOUGH} then o.high when g.documents >= {ENOUGH} then g.high else h.high end, true)) as inside
    from valued v join own o on o.l is not distinct from v.lang and o.s is not distinct from v.source and o.rule = v.rule
    join by_lang g on g.l is not distinct from v.lang and g.rule = v.rule join whole h on h.rule = v.rule group by v.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed, not failed and coalesce(inside, true) as kept
from (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as failed from m) left join checked using (rid)
"""


@query("op12_rules", _sql())
def op12_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed and adaptive quality rules over all documents."""
    return judged(table(spark, folder, "documents"))
