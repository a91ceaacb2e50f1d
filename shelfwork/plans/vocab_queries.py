"""Registered queries: vocabulary, sequences, language, enrichment."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import task_text
from ..functions import text as T
from ..operators import enrich as L
from ..operators import vocab as V
from ..scale import kept, spread
from ..session import shared_folder
from .registry import query, table
from .text_queries import SENTS, sql_text


def docs(spark, folder, *columns):
    return spread(table(spark, folder, "documents").select("doc_id", "text", *columns), "doc_id")


SEPARATORS = "'" + fixed.WORD_SEPARATORS.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'"
TOKENS = f"list_filter(string_split(translate(lower(text), {SEPARATORS}, '{' ' * len(fixed.WORD_SEPARATORS)}'), ' '), lambda w: w <> '')"

def sql_vocab(num_words: int) -> str:
    return f"""
    tokens AS (SELECT doc_id, lang, {TOKENS} AS ts FROM documents),
    vocab AS (
      SELECT term, n, (row_number() OVER (ORDER BY n DESC, term) + 1)::INT AS term_id
      FROM (SELECT term, count(*) AS n FROM (SELECT unnest(ts) AS term FROM tokens) GROUP BY term)
      QUALIFY row_number() OVER (ORDER BY n DESC, term) <= {num_words} - 2
    )"""



@query("vocabulary", f"WITH {sql_vocab(60000)} SELECT term, n, term_id FROM vocab")
def vocabulary(spark, folder):
    return V.vocabulary(docs(spark, folder), "text")


SEQUENCES = f"""
    {sql_vocab(60000)},
    pos AS (SELECT doc_id, unnest(ts[1:200]) AS term, unnest(range(1, 1 + len(ts[1:200]))) AS p FROM tokens),
    seq AS (
      SELECT doc_id, string_agg(coalesce(term_id, 1)::VARCHAR, ',' ORDER BY p) AS ids,
        string_agg(CASE WHEN term_id IS NULL THEN '<OOV>' ELSE term END, ' ' ORDER BY p) AS words, count(*) AS used
      FROM pos LEFT JOIN vocab USING (term) GROUP BY doc_id
    )"""


@query(
    "encode_sequences",
    f"""
    WITH {SEQUENCES} SELECT t.doc_id, coalesce(ids, '') || CASE WHEN coalesce(used, 0) = 0 THEN repeat(',0', 199) ELSE repeat(',0', (200 - used)::INT) END AS ids,
      coalesce(used, 0)::INT AS used FROM tokens t LEFT JOIN seq USING (doc_id)
    """,
)
def encode_sequences(spark, folder):
    rows = docs(spark, folder)
    out = V.encode_sequences(rows, "doc_id", "text", V.vocabulary(rows, "text"), 200)
    used = F.aggregate("mask", F.lit(0), lambda t, m: t + m)
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), used.alias("used"))


@query("decode_sequences", f"WITH {SEQUENCES} SELECT t.doc_id, coalesce(words, '') AS text FROM tokens t LEFT JOIN seq USING (doc_id)")
def decode_sequences(spark, folder):
    rows = docs(spark, folder)
    vocab = V.vocabulary(rows, "text")
    ids = V.encode_sequences(rows, "doc_id", "text", vocab, 200)
    return V.decode_sequences(ids, "doc_id", "ids", vocab)


@query(
    "corpus_tfidf",
    f"""
    WITH c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL),
    k AS (SELECT term, count(*) AS df FROM c GROUP BY term)
    SELECT doc_id, term, round(n * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)), 6) AS weight FROM c JOIN k USING (term)
    """,
)
def corpus_tfidf(spark, folder):
    out = V.corpus_tfidf(table(spark, folder, "documents"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "char_ngrams",
    """
    WITH g AS (
      SELECT unnest([substr(title, i, k) FOR i IN range(1, length(title) - k + 2)]) AS gram
      FROM (SELECT p_name AS title, unnest([2, 3, 4, 5]) AS k FROM part) WHERE length(title) >= k)
    SELECT gram, count(*) AS n FROM g GROUP BY gram
    """,
)
def char_ngrams(spark, folder):
    return V.char_ngram_counts(table(spark, folder, "part").select("p_name"), "p_name")


@query(
    "word_ngrams",
    f"""
    WITH t AS (SELECT {TOKENS} AS ts FROM documents),
    g AS (SELECT unnest([ts[i] || ' ' || ts[i + 1] FOR i IN range(1, len(ts))]) AS gram FROM t WHERE len(ts) >= 2)
    SELECT gram, count(*) AS n FROM g GROUP BY gram
    """,
)
def word_ngrams(spark, folder):
    return V.word_ngram_counts(docs(spark, folder), "text", 2)


@query(
    "top_terms_by_class",
    f"""
    SELECT lang, term, n, rank FROM (
      SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term)::INT AS rank
      FROM (SELECT lang, unnest({TOKENS}) AS term FROM documents) GROUP BY lang, term)
    WHERE rank <= 20
    """,
)
def top_terms_by_class(spark, folder):
    return V.top_terms(docs(spark, folder, "lang"), "lang", "text", 20)


@query(
    "top_sentences_by_class",
    f"""
    SELECT lang, term, n, rank FROM (
      SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term)::INT AS rank
      FROM (SELECT lang, unnest({SENTS % 'text'}) AS term FROM documents) GROUP BY lang, term)
    WHERE rank <= 5
    """,
)
def top_sentences_by_class(spark, folder):
    return V.top_terms(docs(spark, folder, "lang"), "lang", "text", 5, T.sentences)


# DuckDB compares bytes; one byte per letter makes its distance count letters.
LETTERS = "àáâäçèéêëìíîïñòóôöùúûüßœæ"
ONE_BYTE = "translate(%s, '" + LETTERS + "', " + " || ".join(f"chr({i + 1})" for i in range(len(LETTERS))) + ")"


@query(
    "spelling_fix",
    f"""
    WITH c AS (SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS}) AS term FROM documents) WHERE length(term) >= 4 GROUP BY term),
    odd AS (SELECT term FROM c WHERE n <= 1), known AS (SELECT term AS fix, n AS fix_n FROM c WHERE n >= 20)
    SELECT term, fix, fix_n FROM odd JOIN known ON length(fix) BETWEEN length(term) - 1 AND length(term) + 1 AND levenshtein({ONE_BYTE % 'term'}, {ONE_BYTE % 'fix'}) <= 1
    QUALIFY row_number() OVER (PARTITION BY term ORDER BY fix_n DESC, fix) = 1
    """,
)
def spelling_fix(spark, folder):
    return V.spelling_fixes(docs(spark, folder), "text")


PROFILES = """
    grams AS (
      SELECT doc_id, lang, unnest([substr(t, i, 3) FOR i IN range(1, length(t) - 1)]) AS gram
      FROM (SELECT doc_id, lang, lower(text) AS t FROM documents) WHERE length(t) >= 3
    ),
    counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL),
    profiles AS (
      SELECT lang, gram, floor(n * 1000000 / sum(n) OVER (PARTITION BY lang))::BIGINT AS share FROM counts
      QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 300
    )"""


@query("language_profiles", f"WITH {PROFILES} SELECT lang, gram, share FROM profiles")
def language_profiles(spark, folder):
    return V.language_profiles(docs(spark, folder, "lang"), "lang", "text")


@query(
    "language_id",
    f"""
    WITH {PROFILES},
    s AS (SELECT g.doc_id, p.lang, sum(p.share) AS score FROM grams g JOIN profiles p ON p.gram = g.gram GROUP BY ALL),
    b AS (SELECT doc_id, lang AS detected FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
    SELECT d.doc_id, b.detected FROM documents d LEFT JOIN b USING (doc_id)
    """,
)
def language_id(spark, folder):
    rows = docs(spark, folder, "lang")
    return V.detect_language(rows, "doc_id", "text", V.language_profiles(rows, "lang", "text"), "lang")


def unigrams(rows):
    """Counts of all words made of letters, for splitting glued ones."""
    return V.term_counts(rows, "text").where(F.col("term").rlike("^\\p{L}+$"))


@query("split_glued_words")
def split_glued_words(spark, folder):
    rows = docs(spark, folder)
    return V.split_glued_words(rows, "doc_id", "text", unigrams(rows))


# The best split of every name with its blanks taken out, letter by letter: the state holds the
# best score and the start of the last piece for each end, and where an unknown piece starts best.
SPLITS = """
    WITH RECURSIVE terms AS (SELECT unnest(string_split(lower(p_name), ' ')) AS term FROM part),
    c AS (SELECT term, count(*) AS n FROM terms WHERE regexp_full_match(term, '[a-z]+') GROUP BY 1),
    total AS (SELECT sum(n)::DOUBLE AS t FROM c),
    tokens AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS token FROM part),
    places AS (SELECT token, unnest(range(0, length(token))) AS s FROM tokens),
    known AS (
      SELECT token, s + length(term) AS e, list({'x': log10(n / t), 's': s}) AS k
      FROM places JOIN c ON substr(token, s + 1, length(term)) = term, total GROUP BY 1, 2),
    dp AS (
      SELECT token, 0 AS e, [0.0::DOUBLE] AS best, [0] AS starts, {'x': 0.0::DOUBLE, 's': 0} AS free FROM tokens
      UNION ALL
      SELECT token, e, list_append(best, top.x), list_append(starts, -top.s),
        list_sort([free, {'x': top.x + e, 's': -e}], 'DESC')[1] FROM (
        SELECT dp.token, dp.e + 1 AS e, best, starts, free,
          list_sort(list_concat([{'x': free.x + log10(10.0::DOUBLE / t) - (dp.e + 1), 's': free.s}],
            list_transform(coalesce(k, []), lambda o: {'x': best[o.s + 1] + o.x, 's': (-o.s)::INT})), 'DESC')[1] AS top
        FROM dp CROSS JOIN total LEFT JOIN known ON known.token = dp.token AND known.e = dp.e + 1 WHERE dp.e < length(dp.token))),
    back AS (
      SELECT token, starts, length(token) AS e, '' AS split FROM dp WHERE e = length(token)
      UNION ALL
      SELECT token, starts, starts[e + 1], substr(token, starts[e + 1] + 1, e - starts[e + 1]) || CASE WHEN split = '' THEN '' ELSE ' ' || split END FROM back WHERE e > 0)
    """


@query(
    "split_glued_names",
    SPLITS + """
    SELECT p_partkey, split AS name FROM part JOIN back ON token = regexp_replace(lower(p_name), '[^a-z]', '', 'g') WHERE e = 0
    """,
)
def split_glued_names(spark, folder):
    """Names with their blanks taken out, split again."""
    part = table(spark, folder, "part")
    counts = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).where(F.col("term").rlike("^[a-z]+$")).groupBy("term").agg(F.count("*").alias("n"))
    glued = part.select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z]", "").alias("name"))
    return V.split_glued_words(glued, "p_partkey", "name", counts, known_terms=20)  # the others go through the filter and the join


@query("baseline_text_chain")
def baseline_text_chain(spark, folder):
    rows = docs(spark, folder)
    words = kept(rows.select("doc_id", task_text.baseline_words(F.lower("text")).alias("text")), "words")  # read three times
    split = V.split_glued_words(words, "doc_id", "text", unigrams(rows))
    return split.select("doc_id", task_text.baseline_end("text").alias("text"))


def sql_chunk(pos: str, rows: str, k: str) -> str:
    return f"""(CASE WHEN {pos} < ({rows} % {k}) * ({rows} // {k} + 1) THEN {pos} // ({rows} // {k} + 1)
      ELSE {rows} % {k} + ({pos} - ({rows} % {k}) * ({rows} // {k} + 1)) // greatest({rows} // {k}, 1) END)::BIGINT"""


BATCHED = f"""
    placed AS (
      SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS rows,
        len(list_filter(regexp_split_to_array(text, '{fixed.WHITE}+'), lambda w: w <> '')) AS words FROM documents
    ),
    chunked AS (
      SELECT doc_id, text, {sql_chunk('pos', 'rows', 'greatest(1, rows // 250)')} AS chunk,
        CASE WHEN words < 200 THEN 'short' WHEN words < 500 THEN 'medium' WHEN words < 2000 THEN 'long' ELSE 'very_long' END AS length_class,
        CASE WHEN words < 200 THEN 5 WHEN words < 500 THEN 3 WHEN words < 2000 THEN 2 ELSE 1 END AS size
      FROM placed
    ),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY chunk, length_class ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY chunk, length_class) AS n FROM chunked
    ),
    batched AS (
      SELECT doc_id, text, chunk, length_class, {sql_chunk('p', 'n', 'ceil(n::DOUBLE / size)::BIGINT')} AS batch FROM ranked
    )"""


@query("chunk_ids", f"WITH {BATCHED} SELECT doc_id, chunk FROM chunked")
def chunk_ids(spark, folder):
    return L.with_chunks(table(spark, folder, "documents").select("doc_id"), "doc_id")


@query("fixed_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch FROM documents")
def fixed_batches(spark, folder):
    return L.fixed_batches(table(spark, folder, "documents").select("doc_id"), "doc_id", 10)


@query("fixed_batches_by_name", "SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1) // 10 AS batch FROM customer")
def fixed_batches_by_name(spark, folder):
    return L.fixed_batches(table(spark, folder, "customer").select("c_name"), "c_name", 10)


def batched(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return L.with_batches(L.with_chunks(rows, "doc_id"), "doc_id", "text")


@query(
    "length_batches",
    f"WITH {BATCHED} SELECT doc_id, chunk, length_class, batch, row_number() OVER (PARTITION BY chunk, length_class, batch ORDER BY doc_id)::INT AS number FROM batched",
)
def length_batches(spark, folder):
    return batched(spark, folder).drop("text")


@query(
    "batch_prompts",
    f"""
    WITH {BATCHED}, numbered AS (
      SELECT *, row_number() OVER (PARTITION BY chunk, length_class, batch ORDER BY doc_id) AS number FROM batched)
    SELECT chunk, length_class, batch, count(*)::INT AS rows, string_agg(number || '. ' || text, chr(59) || chr(10) ORDER BY number) AS prompt
    FROM numbered GROUP BY ALL
    """,
)
def batch_prompts(spark, folder):
    return L.batch_prompts(batched(spark, folder), "text")


@query(
    "parse_replies",
    f"""
    WITH {BATCHED} SELECT doc_id, row_number() OVER (PARTITION BY chunk, length_class, batch ORDER BY doc_id)::INT AS number, md5(text) AS reply FROM batched
    """,
)
def parse_replies(spark, folder):
    # A reply lists the digest of every text of a batch, one numbered line each.
    rows = batched(spark, folder)
    group = ["chunk", "length_class", "batch"]
    pairs = F.collect_list(F.struct("number", F.md5("text").alias("line")))
    lines = F.transform(F.sort_array(pairs), lambda p: F.concat(p["number"].cast("string"), F.lit(". "), p["line"]))
    replies = rows.groupBy(*group).agg(F.array_join(lines, "\n").alias("reply"), F.collect_list(F.struct("number", "doc_id")).alias("rows"))
    parsed = replies.select(T.parse_numbered("reply").alias("m"), F.explode("rows").alias("r"))
    return parsed.select("r.doc_id", "r.number", T.strip(F.get(F.map_values(F.map_filter("m", lambda k, v: k == F.col("r.number").cast("string"))), F.lit(0))).alias("reply"))


def digest(texts):
    """A stand-in for a model: the digest of every text, none for texts that end in a comma."""
    return [None if t.endswith(",") else hashlib.md5(t.encode()).hexdigest() for t in texts]


@query(
    "enrich_batches",
    f"""
    WITH {BATCHED}, whole AS (SELECT *, bool_or(ends_with(text, ',')) OVER (PARTITION BY chunk, length_class, batch) AS gaps FROM batched)
    SELECT doc_id, CASE WHEN ends_with(text, ',') THEN NULL ELSE md5(text) END AS reply,
      CASE WHEN ends_with(text, ',') THEN 'missing' ELSE 'ok' END AS status, CASE WHEN gaps THEN 3 ELSE 1 END AS calls
    FROM whole
    """,
)
def enrich_batches(spark, folder):
    return L.enrich_batches(batched(spark, folder), "doc_id", "text", digest).drop("error")


def strict_digest(texts):
    if any("@" in t for t in texts):
        raise ValueError("address in text")
    return digest(texts)


@query(
    "enrich_rows",
    """
    SELECT doc_id, CASE WHEN contains(text, '@') THEN text WHEN ends_with(text, ',') THEN NULL ELSE md5(text) END AS reply,
      CASE WHEN contains(text, '@') THEN 'error' WHEN ends_with(text, ',') THEN 'missing' ELSE 'ok' END AS status,
      CASE WHEN contains(text, '@') THEN 'ValueError: address in text' END AS error
    FROM documents
    """,
)
def enrich_rows(spark, folder):
    return L.enrich_rows(docs(spark, folder), "doc_id", "text", strict_digest).drop("calls")


@query(
    "quarantine",
    "SELECT doc_id, CASE WHEN contains(text, '@') THEN 'error' ELSE 'missing' END AS status FROM documents WHERE contains(text, '@') OR ends_with(text, ',')",
)
def quarantine(spark, folder):
    return L.quarantine(L.enrich_rows(docs(spark, folder), "doc_id", "text", strict_digest), "doc_id").select("doc_id", "status")


def reversed_digest(texts):
    return [hashlib.md5(t[::-1].encode()).hexdigest() for t in texts]


@query(
    "compare_models",
    "SELECT doc_id, CASE WHEN ends_with(text, ',') THEN NULL ELSE md5(text) END AS text_model_a, md5(reverse(text)) AS text_model_b FROM documents",
)
def compare_models(spark, folder):
    calls = {"model:a": digest, "model.b": reversed_digest}
    long = L.compare_models(table(spark, folder, "documents"), "doc_id", "text", calls)
    return L.side_by_side(long, "doc_id", "text", list(calls))


@query(
    "enrich_resume",
    "SELECT doc_id, CASE WHEN ends_with(text, ',') THEN NULL ELSE md5(text) END AS reply, CASE WHEN ends_with(text, ',') THEN 'missing' ELSE 'ok' END AS status FROM documents",
)
def enrich_resume(spark, folder):
    # A first run sees one language only; the second continues with the rest.
    rows = table(spark, folder, "documents").select("doc_id", "lang", "text")
    store = shared_folder(spark, "replies")
    L.enrich_resumable(rows.where("lang = 'en'"), "doc_id", "text", digest, store)
    return L.enrich_resumable(rows, "doc_id", "text", digest, store).select("doc_id", "reply", "status")
