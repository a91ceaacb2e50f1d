"""Registered queries: assembling, cleaning and measuring texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import task_text
from ..functions import text as T
from ..operators import columns as C
from ..operators import outliers as O
from ..operators import vocab as V
from ..scale import spread
from .registry import query, table

# ------------------------------------------------------------ joins, assembling


@query(
    "catalog_join",
    """
    SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def catalog_join(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return C.with_labels(docs, table(spark, folder, "labels"), "doc_id", "left")


@query(
    "catalog_join_both",
    """
    SELECT d.doc_id, d.lang, l.quality, l.toxic
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def catalog_join_both(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return C.with_labels(docs, table(spark, folder, "labels"), "doc_id", "inner")


@query(
    "rows_at_keys",
    """
    SELECT doc_id, lang, n_chars FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    """,
)
def rows_at_keys(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return C.rows_at(docs, table(spark, folder, "labels").where("quality = 1"), "doc_id")


TURN_PAIRS = """
    SELECT t.conv_id, t.turn, t.text AS title, d.text AS description
    FROM conversations t LEFT JOIN conversations d
      ON d.conv_id = t.conv_id AND d.turn = t.turn + 1
"""


def turn_pairs(spark, folder):
    """Consecutive turns play title and description; the last turn has none."""
    turns = table(spark, folder, "conversations")
    titles = turns.select("conv_id", "turn", F.col("text").alias("title"))
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("description"))
    return titles.join(nexts, ["conv_id", "turn"], "left")


@query(
    "merge_title_description",
    f"""
    SELECT conv_id, turn,
      CASE WHEN coalesce(description, ' ') = title THEN title
           ELSE title || '; ' || coalesce(description, ' ') END AS text
    FROM ({TURN_PAIRS})
    """,
)
def merge_title_description(spark, folder):
    pairs = turn_pairs(spark, folder)
    return pairs.select("conv_id", "turn", T.merge_title_description("title", "description").alias("text"))


@query(
    "merge_title_description_blank",
    """
    SELECT p_partkey, CASE WHEN p_type = p_name THEN ' ' ELSE p_name || ' : ' || p_type END AS text
    FROM part
    """,
)
def merge_title_description_blank(spark, folder):
    merged = T.merge_title_description("p_name", "p_type", sep=" : ", null_as="", on_equal="blank")
    return table(spark, folder, "part").select("p_partkey", merged.alias("text"))


@query(
    "merge_nonempty_parts",
    f"""
    SELECT conv_id, turn,
      trim(concat_ws('. ', nullif(title, ''), nullif(description, '')), '. ') AS text
    FROM ({TURN_PAIRS})
    """,
)
def merge_nonempty_parts(spark, folder):
    return turn_pairs(spark, folder).select("conv_id", "turn", T.merge_parts("title", "description").alias("text"))


@query(
    "build_paths",
    """
    WITH n AS (SELECT *, 'image_' || p_size || '_product_' || p_partkey || '.jpg' AS image_name FROM part)
    SELECT p_partkey, image_name,
      'raw/' || image_name AS image_path,
      'out/' || p_type || '/' || image_name AS image_path_preprocessed,
      'grey/' || p_type || '/' || image_name AS image_path_greyscale
    FROM n
    """,
)
def build_paths(spark, folder):
    part = table(spark, folder, "part")
    roots = {"raw": "raw/", "preprocessed": "out/", "grey": "grey/"}
    return C.with_paths(part, roots, "p_size", "p_partkey", "p_type").select(
        "p_partkey", "image_name", "image_path", "image_path_preprocessed", "image_path_greyscale"
    )


@query(
    "image_candidates",
    """
    WITH listing AS (
      SELECT 'image_' || p_size || '_product_' || p_partkey || '.jpg' AS file FROM part WHERE p_type = 'SMALL'
      UNION SELECT p_size || '.jpg' FROM part WHERE p_brand = 'Brand#2'
      UNION SELECT 'image_' || p_size || '.jpg' FROM part WHERE p_brand = 'Brand#3'
    ), tried AS (
      SELECT p_partkey, 0 AS r, 'image_' || p_size || '_product_' || p_partkey || '.jpg' AS file FROM part
      UNION ALL SELECT p_partkey, 1, p_size || '.jpg' FROM part
      UNION ALL SELECT p_partkey, 2, 'image_' || p_size || '.jpg' FROM part
    ), best AS (
      SELECT p_partkey, arg_min(file, r) AS file FROM tried JOIN listing USING (file) GROUP BY p_partkey
    )
    SELECT p.p_partkey, b.file FROM part p LEFT JOIN best b USING (p_partkey)
    """,
)
def image_candidates(spark, folder):
    part = table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    listing = (
        part.where("p_type = 'SMALL'").select(T.image_name("p_size", "p_partkey").alias("file"))
        .union(part.where("p_brand = 'Brand#2'").select(F.concat(size, F.lit(".jpg"))))
        .union(part.where("p_brand = 'Brand#3'").select(F.concat(F.lit("image_"), size, F.lit(".jpg"))))
    )
    rows = part.select("p_partkey", T.image_candidates("p_size", "p_partkey").alias("names"))
    return C.first_existing(rows, "p_partkey", "names", listing, "file")


@query(
    "file_path_lookup",
    """
    SELECT p.p_partkey, l.path
    FROM part p LEFT JOIN (
      SELECT p_name AS file, max('tree/' || p_type || '/' || p_name) AS path FROM part WHERE p_size > 25 GROUP BY p_name
    ) l ON l.file = p.p_name
    """,
)
def file_path_lookup(spark, folder):
    part = table(spark, folder, "part")
    path = F.concat(F.lit("tree/"), "p_type", F.lit("/"), "p_name")
    listing = part.where("p_size > 25").groupBy(F.col("p_name")).agg(F.max(path).alias("path"))
    return part.select("p_partkey", "p_name").join(listing, "p_name", "left").select("p_partkey", "path")


@query(
    "sanitize_category",
    """
    SELECT p_partkey, regexp_replace(coalesce(p_brand, 'unknown'), '[^0-9A-Za-z_\\-]', '_', 'g') AS folder,
      replace('./data/' || p_type, './data/', '../data/') AS moved
    FROM part
    """,
)
def sanitize_category(spark, folder):
    moved = T.move_prefix(F.concat(F.lit("./data/"), "p_type"), "./data/", "../data/")
    return table(spark, folder, "part").select("p_partkey", T.folder_name("p_brand").alias("folder"), moved.alias("moved"))


@query(
    "text_preview",
    """
    SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview,
      coalesce(nullif(text, ''), 'Empty') = text AS not_empty
    FROM documents
    """,
)
def text_preview(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.preview("text", 500).alias("preview"), (T.fill_empty("text") == F.col("text")).alias("not_empty"))


@query("lookup_substring", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'red w') ORDER BY p_partkey LIMIT 1")
def lookup_substring(spark, folder):
    return C.find_text(table(spark, folder, "part").select("p_partkey", "p_name", "p_type"), "p_name", "red w", "p_partkey")


# -------------------------------------------------------------------- cleaning

W = fixed.WHITE
# A no-break space, as French text has it, where the tables have a blank.
NO_BREAK = [("e ", "e\u00a0"), (" th", "\u00a0th")]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_replace(expr: str, pairs) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {sql_text(old)}, {sql_text(new)})"
    return expr


def sql_regex(expr: str, pattern: str, new: str) -> str:
    return f"regexp_replace({expr}, {sql_text(pattern)}, {sql_text(new)}, 'g')"


def sql_strip(expr: str) -> str:
    return sql_regex(expr, f"^{W}+|{W}+$", "")


def sql_clean(expr: str) -> str:
    expr = sql_replace(f"coalesce({expr}, '')", fixed.MOJIBAKE)
    for pattern, new in (
        (fixed.TAGS, ""), (fixed.WEB_WORDS, ""), (fixed.EMAILS, ""),
        (fixed.ENTITIES, " "), (fixed.OUTSIDE_CHARSET, " "), (fixed.SPACES, " "),
    ):
        expr = sql_regex(expr, pattern, new)
    return f"trim({expr})"


def sql_model_text(expr: str) -> str:
    expr = f"strip_accents({sql_strip(f'lower({expr})')})"
    expr = sql_regex(expr, fixed.SPACED_MARKS, " \\1 ")
    expr = sql_regex(expr, fixed.QUOTES_AND_SPACES, " ")
    return sql_regex(expr, fixed.OUTSIDE_MODEL_TEXT, " ")


@query("clean_text_chain", f"SELECT page_id, {sql_clean('html')} AS text FROM pages")
def clean_text_chain(spark, folder):
    return spread(table(spark, folder, "pages").select("page_id", "html")).select(
        "page_id", T.clean_text("html").alias("text")
    )


@query("clean_documents", f"SELECT doc_id, {sql_clean(sql_replace('text', NO_BREAK))} AS text FROM documents")
def clean_documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", T.clean_text(T.replace_all("text", NO_BREAK)).alias("text")
    )


# Latin-1 text read as mis-decoded: the two-byte form of é, è, à and of a quote.
BROKEN = [("é", "Ã©"), ("è", "Ã¨"), ("ê", "Ãª"), ("'", "â€™")]


@query("fix_mojibake_table", f"SELECT doc_id, {sql_replace(sql_replace('text', BROKEN), fixed.MOJIBAKE)} AS text FROM documents")
def fix_mojibake_table(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.fix_mojibake(T.replace_all("text", BROKEN)).alias("text"))


MISREAD = [(c, c.encode("utf-8").decode("latin-1")) for c in "àáâäçèéêëìíîïñòóôöùúûüßÀÁÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ¿¡«»"]


@query("fix_encoding", "SELECT doc_id, 'łę ' || text AS text FROM documents")
def fix_encoding(spark, folder):
    # Broken on purpose, repaired, and expected to equal the stored text.
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    broken = T.replace_all("text", MISREAD)
    return docs.select("doc_id", F.concat(F.lit("Å‚Ä™ "), broken).alias("text")).select("doc_id", task_text.fix_encoding("text").alias("text"))


@query("html_to_text")
def html_to_text(spark, folder):
    pages = spread(table(spark, folder, "pages").select("page_id", "html"))
    return pages.select("page_id", task_text.html_to_text("html").alias("text"))


@query("model_text", f"SELECT doc_id, {sql_model_text(sql_replace('text', NO_BREAK))} AS text FROM documents")
def model_text(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.model_text(T.replace_all("text", NO_BREAK)).alias("text"))


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_accents(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.strip_accents("text").alias("text"))


@query(
    "strip_urls_emails",
    "SELECT page_id, "
    + sql_regex(sql_regex("html", fixed.EMAILS, ""), fixed.WEB_ADDRESSES, "")
    + " AS text, "
    + sql_regex("url", fixed.WEB_ADDRESSES, "")
    + " AS url_rest FROM pages",
)
def strip_urls_emails(spark, folder):
    pages = spread(table(spark, folder, "pages"))
    return pages.select(
        "page_id",
        T.remove_web_addresses(T.remove_emails("html")).alias("text"),
        T.remove_web_addresses("url").alias("url_rest"),
    )


@query(
    "split_letters_digits",
    "SELECT page_id, "
    + sql_regex(sql_regex("html", "([A-Za-z])([0-9])", "\\1 \\2"), "([0-9])([A-Za-z])", "\\1 \\2")
    + " AS text FROM pages",
)
def split_letters_digits(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", T.split_letters_digits("html").alias("text"))


@query(
    "strip_punctuation",
    f"SELECT page_id, translate({sql_replace('html', [(p, '') for p in fixed.POSSESSIVES])}, {sql_text(fixed.PUNCTUATION)}, '') AS text FROM pages",
)
def strip_punctuation(spark, folder):
    return spread(table(spark, folder, "pages")).select(
        "page_id", T.remove_punctuation(T.remove_possessives("html")).alias("text")
    )


@query(
    "collapse_spaces",
    "SELECT page_id, trim(" + sql_regex("replace(html, '<', '   ')", " +", " ") + ") AS text FROM pages",
)
def collapse_spaces(spark, folder):
    spaced = F.replace(F.col("html"), F.lit("<"), F.lit("   "))
    return spread(table(spark, folder, "pages")).select("page_id", F.trim(T.collapse_spaces(spaced)).alias("text"))


# Contractions put into every sentence, straight and curly ones, and some that begin alike.
SHORT = " can't've, y’all'd’ve I’d've shouldn’t."


def sql_map(table: dict[str, str]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in table.items()) + "}"


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(
    "contraction_expand",
    f"""
    WITH t AS (SELECT doc_id, replace(text, '.', {sql_text(SHORT)}) AS t FROM documents),
    p AS (SELECT doc_id, regexp_split_to_array(t, {sql_text(T.contraction_pattern())}) AS parts, regexp_extract_all(t, {sql_text(T.contraction_pattern())}) AS found FROM t)
    SELECT doc_id, array_to_string(list_transform(list_zip(parts, list_transform(found, lambda m: {sql_map(T.contraction_table())}[m])), lambda z: z[1] || coalesce(z[2], '')), '') AS text FROM p
    """,
)
def contraction_expand(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit(SHORT)).alias("text")))
    return docs.select("doc_id", T.expand_contractions("text").alias("text"))


@query(
    "clean_reply",
    """
    SELECT doc_id, coalesce(nullif("""
    + sql_strip(
        sql_regex(
            f"regexp_replace({sql_strip(chr(39) + 'English: ' + chr(39) + ' || text')}, '(?i)^(Translation:|English:|Here is the translation:)\\s*', '')",
            "\\s+", " ",
        )
    )
    + """, ''), text) AS text FROM documents
    """,
)
def clean_reply(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    reply = F.concat(F.lit("English: "), "text")
    return docs.select("doc_id", T.clean_reply(reply, "text").alias("text"))


@query(
    "corrected_words",
    """
    WITH w AS (
      SELECT unnest(string_split(text, ' ')) AS old, unnest(string_split(strip_accents(text), ' ')) AS new FROM documents
    )
    SELECT old, new, count(*) AS n FROM w WHERE old <> new GROUP BY old, new
    """,
)
def corrected_words(spark, folder):
    docs = spread(table(spark, folder, "documents").select("text"))
    return V.corrected_words(docs.select("text", T.strip_accents("text").alias("plain")), "text", "plain")


@query(
    "repaired_words",
    f"""
    WITH w AS (SELECT unnest(string_split({sql_replace('text', MISREAD)}, ' ')) AS old, unnest(string_split(text, ' ')) AS new FROM documents)
    SELECT old, new, count(*) AS n FROM w WHERE old <> new GROUP BY old, new
    """,
)
def repaired_words(spark, folder):
    """The map of words that the repair of broken encodings corrects."""
    docs = spread(table(spark, folder, "documents").select("text"))
    broken = docs.select(T.replace_all("text", MISREAD).alias("broken"))
    return V.corrected_words(broken.select("broken", task_text.fix_encoding("broken").alias("mended")), "broken", "mended")


# ------------------------------------------------------------------- measuring

LONG = 200
WORDS = "len(string_split(text, ' '))"
SENTS = f"list_filter(list_transform(regexp_extract_all(%s, '[^.!?]+[.!?]*'), lambda s: {sql_strip('s')}), lambda s: s <> '')"


@query(
    "text_word_stats",
    f"""
    WITH c AS (SELECT {WORDS} AS w, len({SENTS % 'text'}) AS s FROM documents)
    SELECT min(w)::INT AS word_count_min, max(w)::INT AS word_count_max,
      round(avg(w), 6) AS word_count_mean, round(stddev_pop(w), 6) AS word_count_std,
      min(s)::INT AS sentence_count_min, max(s)::INT AS sentence_count_max,
      round(avg(s), 6) AS sentence_count_mean, round(stddev_pop(s), 6) AS sentence_count_std
    FROM c
    """,
)
def text_word_stats(spark, folder):
    stats = O.text_stats(spread(table(spark, folder, "documents").select("text")), "text")
    return stats.select(*[F.round(c, 6).alias(c) if c.endswith(("mean", "std")) else c for c in stats.columns])


@query(
    "text_describe",
    f"""
    WITH c AS (SELECT {WORDS} AS w FROM documents)
    SELECT count(w) AS count, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std, min(w)::INT AS min,
      quantile_cont(w, 0.25)::DOUBLE AS q25, quantile_cont(w, 0.5)::DOUBLE AS q50,
      quantile_cont(w, 0.75)::DOUBLE AS q75, max(w)::INT AS max
    FROM c
    """,
)
def text_describe(spark, folder):
    docs = spread(table(spark, folder, "documents").select("text"))
    out = O.describe(docs.select(T.word_count("text").alias("words")), "words")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "text_outlier_mask",
    f"SELECT doc_id, {WORDS} >= {LONG} AS is_long, len(list_filter(regexp_split_to_array(text, '{W}+'), lambda w: w <> ''))::INT AS words, length(coalesce(text, ''))::INT AS chars FROM documents",
)
def text_outlier_mask(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return O.long_text_mask(docs, "text", LONG).select(
        "doc_id", "is_long", T.word_count_white("text").alias("words"), T.char_count("text").alias("chars")
    )


@query(
    "text_outlier_limit",
    f"""
    WITH c AS (SELECT {WORDS} AS n FROM documents), l AS (SELECT avg(n) + 1.0 * stddev_pop(n) AS x FROM c)
    SELECT round(max(x), 6) AS computed_limit, count(*) FILTER (n > x) AS rows_above_computed,
      {LONG} AS fixed_limit, count(*) FILTER (n >= {LONG}) AS rows_at_fixed
    FROM c, l
    """,
)
def text_outlier_limit(spark, folder):
    docs = spread(table(spark, folder, "documents").select("text"))
    return O.length_limits(docs, "text", 1.0, LONG).withColumn("computed_limit", F.round("computed_limit", 6))


@query(
    "length_bounds",
    f"SELECT doc_id, n_chars FROM documents WHERE len(list_filter(regexp_split_to_array(text, '{W}+'), lambda w: w <> '')) BETWEEN 20 AND 500",
)
def length_bounds(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "n_chars"))
    return O.length_between(docs, "text", 20, 500).select("doc_id", "n_chars")


SENT_ROWS = f"""
    SELECT doc_id, n_sents, unnest(range(0, n_sents))::INT AS sent_ix, unnest(ss) AS sentence
    FROM (SELECT doc_id, ss, len(ss)::INT AS n_sents FROM (SELECT doc_id, {SENTS} AS ss FROM %s))
"""


@query("sentence_split", SENT_ROWS % ("text", "documents"))
def sentence_split(spark, folder):
    return O.sentence_rows(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def sql_weights(source: str) -> str:
    return f"""
    sents AS ({SENT_ROWS % ("lower(text)", source)}),
    tf AS (
      SELECT doc_id, n_sents, sent_ix, term, count(*) AS tf
      FROM (SELECT doc_id, n_sents, sent_ix, unnest(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM sents)
      GROUP BY ALL
    ),
    raw AS (
      SELECT *, tf * (ln((1.0 + n_sents) / (1.0 + count(*) OVER (PARTITION BY doc_id, term))) + 1.0) AS raw FROM tf
    ),
    weights AS (
      SELECT doc_id, sent_ix, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id, sent_ix)) AS weight FROM raw
    )"""


def sql_similar(source: str) -> str:
    return (
        sql_weights(source)
        + """,
    alike AS (
      SELECT a.doc_id, a.sent_ix AS i, b.sent_ix AS j
      FROM weights a JOIN weights b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent_ix < b.sent_ix
      GROUP BY ALL HAVING round(sum(a.weight * b.weight), 9) > 0.8
    ),
    dropped AS (SELECT doc_id, j AS sent_ix, min(i) AS similar_to FROM alike GROUP BY ALL)"""
    )


def sql_deduped(source: str) -> str:
    return (
        sql_similar(source)
        + """,
    deduped AS (
      SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_ix) AS text
      FROM sents ANTI JOIN dropped USING (doc_id, sent_ix) GROUP BY doc_id
    )"""
    )


def sql_summary(source: str) -> str:
    stop = ", ".join(sql_text(w) for w in fixed.STOP_WORDS)
    return f"""
    s2 AS ({SENT_ROWS % ("text", source)}),
    tk AS (
      SELECT doc_id, sent_ix, term FROM (
        SELECT doc_id, sent_ix, unnest(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM s2)
      WHERE term NOT IN ({stop}) AND NOT contains({sql_text(fixed.PUNCTUATION)}, term)
    ),
    fr AS (SELECT doc_id, term, count(*) AS n FROM tk GROUP BY ALL),
    sc AS (
      SELECT s2.doc_id, s2.sent_ix, any_value(s2.sentence) AS sentence, coalesce(sum(fr.n), 0)::BIGINT AS score
      FROM s2 LEFT JOIN tk USING (doc_id, sent_ix) LEFT JOIN fr ON fr.doc_id = tk.doc_id AND fr.term = tk.term
      GROUP BY s2.doc_id, s2.sent_ix
    ),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_ix) AS r FROM sc),
    summary AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY r) AS text FROM rk WHERE r <= 3 GROUP BY doc_id)"""


@query("sentence_tfidf", f"WITH {sql_weights('documents')} SELECT doc_id, sent_ix, term, round(weight, 6) AS weight FROM weights")
def sentence_tfidf(spark, folder):
    out = O.sentence_tfidf(table(spark, folder, "documents"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "redundant_sentences",
    f"WITH {sql_similar('documents')} SELECT doc_id, sent_ix, similar_to, sentence FROM sents JOIN dropped USING (doc_id, sent_ix)",
)
def redundant_sentences(spark, folder):
    return O.redundant_sentence_rows(table(spark, folder, "documents"), "doc_id", "text")


@query(
    "redundancy_report",
    f"WITH {sql_similar('documents')} SELECT doc_id, count(*) AS similar_pairs FROM alike GROUP BY doc_id",
)
def redundancy_report(spark, folder):
    return O.redundancy_report(O.similar_sentences(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


@query("dedupe_sentences_text", f"WITH {sql_deduped('documents')} SELECT doc_id, coalesce(deduped.text, '') AS text FROM documents LEFT JOIN deduped USING (doc_id)")
def dedupe_sentences_text(spark, folder):
    return O.dedupe_sentences(table(spark, folder, "documents"), "doc_id", "text")


@query("document_terms", f"WITH {sql_summary('documents')} SELECT doc_id, term, n FROM fr")
def document_terms(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return O.document_terms(docs, "doc_id", "text")


@query("summary_top3", f"WITH {sql_summary('documents')} SELECT doc_id, coalesce(summary.text, '') AS text FROM documents LEFT JOIN summary USING (doc_id)")
def summary_top3(spark, folder):
    return O.summarize(table(spark, folder, "documents"), "doc_id", "text")


def sql_transform(source: str) -> str:
    return f"""
    long_docs AS (SELECT * FROM {source} WHERE {WORDS} >= {LONG}),
    {sql_deduped('long_docs')},
    {sql_summary('deduped')},
    transformed AS (
      SELECT d.doc_id, d.lang, CASE WHEN {WORDS.replace('text', 'd.text')} >= {LONG} THEN coalesce(s.text, '') ELSE d.text END AS text
      FROM {source} d LEFT JOIN summary s USING (doc_id)
    )"""


SQL_TRANSFORM = sql_transform("documents")


@query("outlier_transform", f"WITH {SQL_TRANSFORM} SELECT doc_id, lang, text FROM transformed")
def outlier_transform(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return O.transform_long_texts(docs, "doc_id", "text", LONG)


def _phase(source: str, name: str) -> str:
    return f"""
    SELECT '{name}' AS phase, min(w)::INT AS word_count_min, max(w)::INT AS word_count_max,
      round(avg(w), 6) AS word_count_mean, round(stddev_pop(w), 6) AS word_count_std,
      min(s)::INT AS sentence_count_min, max(s)::INT AS sentence_count_max,
      round(avg(s), 6) AS sentence_count_mean, round(stddev_pop(s), 6) AS sentence_count_std
    FROM (SELECT {WORDS} AS w, len({SENTS % 'text'}) AS s FROM {source})"""


@query(
    "outlier_transform_report",
    f"WITH {SQL_TRANSFORM} SELECT doc_id, d.text AS before, t.text AS after FROM documents d JOIN transformed t USING (doc_id) WHERE d.text <> t.text",
)
def outlier_transform_report(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return O.transform_report(docs, O.transform_long_texts(docs, "doc_id", "text", LONG), "doc_id", "text")


@query(
    "outlier_transform_stats",
    f"WITH {SQL_TRANSFORM} {_phase('documents', 'before')} UNION ALL {_phase('transformed', 'after')}",
)
def outlier_transform_stats(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stats = O.transform_stats(spread(docs), O.transform_long_texts(docs, "doc_id", "text", LONG), "text")
    return stats.select(*[F.round(c, 6).alias(c) if c.endswith(("mean", "std")) else c for c in stats.columns])


# ---------------------------------------------------------------- repeated texts


@query(
    "dedupe_keep_first",
    """
    SELECT doc_id, lang, source, n_chars, text FROM documents
    WHERE text <> ';' QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
    """,
)
def dedupe_keep_first(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    return C.drop_repeats(docs, "text", "doc_id").select("doc_id", "lang", "source", "n_chars", "text")


@query(
    "duplicate_text_groups",
    "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_key FROM documents GROUP BY text HAVING count(*) > 1",
)
def duplicate_text_groups(spark, folder):
    return C.repeated_texts(table(spark, folder, "documents").select("doc_id", "text"), "text", "doc_id")


@query(
    "write_back",
    "SELECT d.doc_id, d.lang, coalesce(b.text, d.text) AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id",
)
def write_back(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    changes = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return C.write_back(docs, changes, "doc_id", "text")


# ------------------------------------------------------------ the whole preparation

SQL_PREPARED = f"""
    merged AS (
      SELECT conv_id * 100000 + turn AS doc_id, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS lang,
        CASE WHEN coalesce(description, ' ') = title THEN title ELSE title || '; ' || coalesce(description, ' ') END AS text
      FROM ({TURN_PAIRS})
    ),
    cleaned AS (SELECT doc_id, lang, {sql_clean('text')} AS text FROM merged),
    {sql_transform('cleaned')}"""


@query(
    "prepare_catalogue",
    f"""
    WITH {SQL_PREPARED}
    SELECT doc_id, lang, text FROM transformed
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id)
      <= (SELECT min(n) FROM (SELECT count(*) AS n FROM transformed GROUP BY lang))
    """,
)
def prepare_catalogue(spark, folder):
    from .catalogue import Settings, prepare

    pairs = turn_pairs(spark, folder).select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"),
        F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("lang"),
        "title", "description",
    )
    settings = Settings(cleaning=(T.clean_text,), balance="undersample")
    return prepare(pairs, "doc_id", "lang", "title", "description", settings).select("doc_id", "lang", "text")


def digests(texts):
    """A stand-in for a user's function."""
    import hashlib

    return [hashlib.md5(t.encode()).hexdigest() for t in texts]


@query("prepare_catalogue_enriched", f"WITH {SQL_PREPARED} SELECT doc_id, lang, md5(text) AS reply FROM transformed")
def prepare_catalogue_enriched(spark, folder):
    from ..session import shared_folder
    from .catalogue import Settings, prepare

    pairs = turn_pairs(spark, folder).select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"),
        F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("lang"),
        "title", "description",
    )
    settings = Settings(cleaning=(T.clean_text,), enrichment=digests, store=shared_folder(spark, "enriched"))
    out = prepare(pairs, "doc_id", "lang", "title", "description", settings)
    return out.select("doc_id", "lang", F.col("text_model").alias("reply"))
