"""Registered queries: splits, balance, sampling, labels, exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import columns as C
from ..operators import evaluate as E
from ..operators import explore as X
from ..operators import labels as N
from ..functions import fixed_values as fixed
from ..functions import text as T
from ..scale import spread
from .registry import query, table
from .text_queries import TURN_PAIRS, sql_model_text, turn_pairs


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")


def draw(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key})"


def sql_want(source: str, label: str, share: str) -> str:
    return f"""
      SELECT {label}, base + (CASE WHEN row_number() OVER (ORDER BY rest DESC, {label}) <= take - sum(base) OVER () THEN 1 ELSE 0 END) AS want
      FROM (SELECT {label}, take, (n::HUGEINT * take // total) AS base, (n::HUGEINT * take % total) AS rest
        FROM (SELECT {label}, n, total, ceil(total * {share}::DECIMAL(10,6))::BIGINT AS take
          FROM (SELECT {label}, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM {source} GROUP BY {label})))"""


def sql_split(source: str, label: str, share: str, seed: int, names=("train", "test")) -> str:
    return f"""
      SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.{label} ORDER BY {draw('s.doc_id', seed)}, s.doc_id) <= w.want
        THEN '{names[1]}' ELSE '{names[0]}' END AS split
      FROM {source} s JOIN ({sql_want(source, label, share)}) w ON w.{label} = s.{label}"""


@query("stratified_split", f"SELECT doc_id, lang, split FROM ({sql_split('documents', 'lang', '0.2', 42)})")
def stratified_split(spark, folder):
    return B.stratified_split(docs(spark, folder), "lang", "doc_id").select("doc_id", "lang", "split")


SQL_NESTED = f"""
    first_split AS ({sql_split('documents', 'lang', '0.2', 42)}),
    train AS (SELECT * EXCLUDE (split) FROM first_split WHERE split = 'train'),
    second_split AS ({sql_split('train', 'lang', '0.2', 43, ('train', 'val'))}),
    nested AS (SELECT * FROM second_split UNION ALL BY NAME SELECT * FROM first_split WHERE split = 'test')"""


@query("nested_split", f"WITH {SQL_NESTED} SELECT doc_id, lang, split FROM nested")
def nested_split(spark, folder):
    return B.nested_split(docs(spark, folder), "lang", "doc_id").select("doc_id", "lang", "split")


@query(
    "random_split",
    f"""
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {draw('doc_id')}, doc_id) <= ceil((SELECT count(*) FROM documents) * 0.2::DECIMAL(10,6))
      THEN 'test' ELSE 'train' END AS split FROM documents
    """,
)
def random_split(spark, folder):
    return B.random_split(docs(spark, folder).select("doc_id"), "doc_id")


@query(
    "undersample",
    f"""
    SELECT doc_id, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {draw('doc_id')}, doc_id)
      <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
    """,
)
def undersample(spark, folder):
    return B.undersample(docs(spark, folder).select("doc_id", "lang"), "lang", "doc_id")


@query(
    "oversample",
    f"""
    WITH r AS (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {draw('doc_id')}, doc_id) - 1 AS r,
        count(*) OVER (PARTITION BY lang) AS n FROM documents
    ), m AS (SELECT max(n) AS top FROM r)
    SELECT doc_id, lang, unnest(range(0, 1 + (top - n) // n + CASE WHEN r < (top - n) % n THEN 1 ELSE 0 END)) AS copy
    FROM r, m
    """,
)
def oversample(spark, folder):
    return B.oversample(docs(spark, folder).select("doc_id", "lang"), "lang", "doc_id")


@query("balance_none", "SELECT doc_id, lang FROM documents")
def balance_none(spark, folder):
    return B.balance(docs(spark, folder).select("doc_id", "lang"), "none", "lang", "doc_id")


@query(
    "cap_class",
    f"""
    SELECT doc_id, lang FROM documents
    QUALIFY lang <> 'en' OR row_number() OVER (PARTITION BY lang ORDER BY {draw('doc_id')}, doc_id) <= 200
    """,
)
def cap_class(spark, folder):
    return B.cap_classes(docs(spark, folder).select("doc_id", "lang"), "lang", "doc_id", {"en": 200})


@query(
    "samples_per_class",
    f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {draw('doc_id', 7)}, doc_id) <= 20",
)
def samples_per_class(spark, folder):
    return B.samples_per_class(docs(spark, folder).select("doc_id", "source"), "source", "doc_id", 20, seed=7)


@query("random_rows", f"SELECT doc_id, lang FROM documents ORDER BY {draw('doc_id')}, doc_id LIMIT 50")
def random_rows(spark, folder):
    return B.random_rows(docs(spark, folder).select("doc_id", "lang"), "doc_id", 50)


@query(
    "random_per_class",
    f"""
    SELECT doc_id, source FROM documents
    WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY {draw('source')}, source LIMIT 10)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY {draw('doc_id')}, doc_id) <= 1
    """,
)
def random_per_class(spark, folder):
    return B.random_per_class(docs(spark, folder).select("doc_id", "source"), "source", "doc_id", 10)


@query(
    "drop_low_quality",
    f"""
    SELECT doc_id, lang, n_chars FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars, {draw('doc_id')}, doc_id)
      > floor(count(*) OVER (PARTITION BY lang) * 0.408::DECIMAL(10,6))
    """,
)
def drop_low_quality(spark, folder):
    return B.drop_lowest(docs(spark, folder).select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars")


COUNTS = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"


def weights(spark, folder, **options):
    out = B.class_weights(B.class_counts(docs(spark, folder), "lang"), "lang", **options)
    return out.withColumn("weight", F.round("weight", 9))


@query("class_weights_balanced", f"SELECT lang, n, round(sum(n) OVER () / (count(*) OVER () * n::DOUBLE), 9) AS weight FROM ({COUNTS})")
def class_weights_balanced(spark, folder):
    return weights(spark, folder)


@query(
    "class_weights_smoothed",
    f"SELECT lang, n, round(0.5 * (sum(n) OVER () / (count(*) OVER () * n::DOUBLE)) + 0.5, 9) AS weight FROM ({COUNTS})",
)
def class_weights_smoothed(spark, folder):
    return weights(spark, folder, smoothing=0.5)


@query(
    "class_weights_effective",
    f"""
    WITH w AS (SELECT lang, n, (1.0 - 0.999::DOUBLE) / (1.0 - pow(0.999::DOUBLE, n)) AS w FROM ({COUNTS}))
    SELECT lang, n, round(w / sum(w) OVER () * count(*) OVER (), 9) AS weight FROM w
    """,
)
def class_weights_effective(spark, folder):
    return weights(spark, folder, method="effective")


@query("class_weights_sqrt", f"SELECT lang, n, round(0.7::DOUBLE * (1.0 / sqrt(n)) + 0.3::DOUBLE, 9) AS weight FROM ({COUNTS})")
def class_weights_sqrt(spark, folder):
    return weights(spark, folder, method="sqrt", smoothing=0.3)


@query(
    "weight_range",
    f"""
    WITH w AS (SELECT 0.7::DOUBLE * (1.0 / sqrt(n)) + 0.3::DOUBLE AS w FROM ({COUNTS}))
    SELECT round(min(w), 9) AS smallest, round(max(w), 9) AS largest, round(max(w) / min(w), 6) AS ratio FROM w
    """,
)
def weight_range(spark, folder):
    counts = B.class_counts(docs(spark, folder), "lang")
    out = B.weight_range(B.class_weights(counts, "lang", "sqrt", smoothing=0.3))
    return out.select(*[F.round(c, 6 if c == "ratio" else 9).alias(c) for c in out.columns])


@query(
    "rows_with_class_weight",
    f"""
    SELECT d.doc_id, d.lang, w.weight FROM documents d JOIN (
      SELECT lang, round(sum(n) OVER () / (count(*) OVER () * n::DOUBLE), 9) AS weight FROM ({COUNTS})) w USING (lang)
    """,
)
def rows_with_class_weight(spark, folder):
    from ..scale import join_dim

    rows = docs(spark, folder).select("doc_id", "lang")
    return join_dim(rows, weights(spark, folder).select("lang", "weight"), ["lang"], "inner", spread_on=["doc_id"])


@query(
    "weighted_resample",
    f"""
    WITH c AS (SELECT lang, n, 0.7::DOUBLE * (1.0 / sqrt(n)) + 0.3::DOUBLE AS w FROM ({COUNTS})),
    l AS (
      SELECT lang, n, w / sum(n * w) OVER () AS step,
        coalesce(sum(n * w) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(n * w) OVER (), 0.0) AS lo,
        CASE WHEN lang = max(lang) OVER () THEN 1.0 ELSE sum(n * w) OVER (ORDER BY lang) / sum(n * w) OVER () END AS hi,
        (sum(n) OVER ())::BIGINT AS rows
      FROM c
    ), r AS (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {draw('doc_id')}, doc_id) - 1 AS r FROM documents
    ), m AS (
      SELECT doc_id, lang,
        (floor((CASE WHEN r + 1 = n THEN hi ELSE lo + step * (r + 1) END) * rows + 0.5::DOUBLE)
         - floor((CASE WHEN r = n THEN hi ELSE lo + step * r END) * rows + 0.5::DOUBLE))::BIGINT AS k
      FROM r JOIN l USING (lang)
    )
    SELECT doc_id, lang, unnest(range(0, k)) AS copy FROM m WHERE k > 0
    """,
)
def weighted_resample(spark, folder):
    rows = docs(spark, folder).select("doc_id", "lang")
    w = B.class_weights(B.class_counts(rows, "lang"), "lang", "sqrt", smoothing=0.3)
    return B.weighted_resample(rows, "lang", "doc_id", w)


@query(
    "smote_vectors",
    f"""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS top FROM e GROUP BY label),
    r AS (
      SELECT vec_id, e.label, v, n, top, row_number() OVER (PARTITION BY e.label ORDER BY {draw('vec_id')}, vec_id) - 1 AS r
      FROM e JOIN c USING (label)
    ),
    drawn AS (
      SELECT vec_id, label, v, unnest(range(1, 1 + (top - n) // n + CASE WHEN r < (top - n) % n THEN 1 ELSE 0 END)) AS copy FROM r
    ),
    gaps AS (
      SELECT a.vec_id, b.vec_id AS other, row_number() OVER (
        PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k
      FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n < a.top
    ),
    near AS (SELECT vec_id, list(other ORDER BY k) AS others FROM gaps WHERE k <= 3 GROUP BY vec_id),
    chosen AS (
      SELECT d.vec_id, d.label, d.v, d.copy,
        others[1 + ('0x' || substr(md5('42|pick|' || d.vec_id || '|' || d.copy), 1, 8))::BIGINT % len(others)] AS neighbour,
        ('0x' || substr(md5('42|share|' || d.vec_id || '|' || d.copy), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM drawn d LEFT JOIN near USING (vec_id)
    ),
    made AS (
      SELECT c.vec_id, c.label, c.copy, c.neighbour, c.v AS a, o.v AS b, u
      FROM chosen c LEFT JOIN e o ON o.vec_id = c.neighbour
    )
    SELECT vec_id, label, 0::BIGINT AS copy, NULL::BIGINT AS neighbour, round(v[1], 6) AS first_value, round(list_sum(v), 6) AS total FROM e
    UNION ALL
    SELECT vec_id, label, copy, neighbour, round(a[1] + u * (b[1] - a[1]), 6),
      round(list_sum(a) + u * (list_sum(b) - list_sum(a)), 6) FROM made
    """,
)
def smote_vectors(spark, folder):
    out = B.smote(table(spark, folder, "embeddings"), "label", "vec_id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x)
    return out.select(
        "vec_id", "label", "copy", "neighbour",
        F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"), F.round(total, 6).alias("total"),
    )


# ----------------------------------------------------------------------- labels


@query(
    "label_encode_numeric",
    "SELECT vec_id, label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS label_id, false AS unseen_label FROM embeddings",
)
def label_encode_numeric(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    return N.encode(rows, "label", N.label_map(rows, "label"))


@query(
    "label_encode_text",
    "SELECT p_partkey, p_size, (dense_rank() OVER (ORDER BY p_size::VARCHAR) - 1)::INT AS label_id, false AS unseen_label FROM part",
)
def label_encode_text(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_size")
    return N.encode(rows, "p_size", N.label_map(rows, "p_size", "text"))


@query(
    "label_encode_unseen",
    """
    WITH m AS (SELECT p_size AS code, (row_number() OVER (ORDER BY p_size) - 1)::INT AS label_id FROM (SELECT DISTINCT p_size FROM part WHERE p_brand = 'Brand#2'))
    SELECT p_partkey, p_size, label_id, label_id IS NULL AS unseen_label FROM part LEFT JOIN m ON code = p_size
    """,
)
def label_encode_unseen(spark, folder):
    # Fitted on one brand, applied to all of it: some codes are unseen.
    part = table(spark, folder, "part")
    mapping = N.label_map(part.where("p_brand = 'Brand#2'"), "p_size")
    return N.encode(part.select("p_partkey", "p_size"), "p_size", mapping)


@query(
    "label_decode",
    "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_size) - 1)::INT AS label_id, p_size AS code FROM part",
)
def label_decode(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_size")
    mapping = N.label_map(rows, "p_size")
    encoded = N.encode(rows, "p_size", mapping).select("p_partkey", "label_id")
    return N.decode(encoded, "label_id", mapping)


@query(
    "label_encoding_map",
    """
    SELECT code, (row_number() OVER (ORDER BY code) - 1)::INT AS numeric_id, (row_number() OVER (ORDER BY code::VARCHAR) - 1)::INT AS text_id
    FROM (SELECT DISTINCT p_size AS code FROM part)
    """,
)
def label_encoding_map(spark, folder):
    return N.between_orders(table(spark, folder, "part"), "p_size")


@query(
    "one_hot",
    "SELECT vec_id, array_to_string([CASE WHEN i = label THEN 1 ELSE 0 END FOR i IN range(0, 10)], ',') AS hot, label AS back FROM embeddings",
)
def one_hot(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", N.one_hot("label", 10).alias("h"))
    return rows.select("vec_id", F.array_join(F.col("h").cast("array<string>"), ",").alias("hot"), N.argmax("h").alias("back"))


# ------------------------------------------------------------------ exploration


@query("class_counts", f"SELECT lang, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 9) AS percent FROM ({COUNTS})")
def class_counts(spark, folder):
    return X.class_shares(docs(spark, folder), "lang").withColumn("percent", F.round("percent", 9))


@query(
    "class_imbalance",
    f"""
    SELECT count(*) AS classes, round(avg(n), 6) AS average, max({{'n': n, 'c': lang}}).c AS most_common, max(n) AS most,
      min({{'n': n, 'c': lang}}).c AS least_common, min(n) AS least, round(max(n)::DOUBLE / min(n), 9) AS ratio
    FROM ({COUNTS})
    """,
)
def class_imbalance(spark, folder):
    out = X.imbalance(docs(spark, folder), "lang")
    return out.withColumns({"average": F.round("average", 6), "ratio": F.round("ratio", 9)})


def labelled(spark, folder):
    rows = docs(spark, folder).select("doc_id", "lang")
    return C.with_labels(rows, table(spark, folder, "labels"), "doc_id")


LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(
    "missing_by_class",
    f"""
    SELECT lang, round(avg(CASE WHEN quality IS NULL THEN 100.0::DOUBLE ELSE 0 END), 9) AS first_missing,
      round(avg(CASE WHEN toxic IS NULL THEN 100.0::DOUBLE ELSE 0 END), 9) AS second_missing, count(*) AS n
    FROM {LABELLED} GROUP BY lang
    """,
)
def missing_by_class(spark, folder):
    out = X.missing_by_class(labelled(spark, folder), "lang", "quality", "toxic")
    return out.withColumns({c: F.round(c, 9) for c in ("first_missing", "second_missing")})


@query(
    "classes_missing_most",
    f"""
    SELECT lang, round(avg(CASE WHEN quality IS NULL THEN 100.0::DOUBLE ELSE 0 END), 9) AS first_missing
    FROM {LABELLED} GROUP BY lang HAVING avg(CASE WHEN quality IS NULL THEN 100.0 ELSE 0 END) > 50
    """,
)
def classes_missing_most(spark, folder):
    out = X.missing_by_class(labelled(spark, folder), "lang", "quality", "toxic").where("first_missing > 50")
    return out.select("lang", F.round("first_missing", 9).alias("first_missing"))


@query(
    "missing_overall",
    f"""
    SELECT 'quality' AS column, count(*) FILTER (quality IS NULL) AS missing, round(count(*) FILTER (quality IS NULL) * 100.0::DOUBLE / count(*), 9) AS percent FROM {LABELLED}
    UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), round(count(*) FILTER (toxic IS NULL) * 100.0::DOUBLE / count(*), 9) FROM {LABELLED}
    """,
)
def missing_overall(spark, folder):
    return X.missing_overall(labelled(spark, folder), ["quality", "toxic"]).withColumn("percent", F.round("percent", 9))


def sql_white_words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '{fixed.WHITE}+'), lambda w: w <> ''))"


@query(
    "average_lengths",
    f"""
    SELECT round(avg(length(coalesce(title, ''))), 6) AS title_chars, round(avg({sql_white_words('title')}), 6) AS title_words,
      round(avg(length(coalesce(description, ''))), 6) AS description_chars, round(avg({sql_white_words('description')}), 6) AS description_words
    FROM ({TURN_PAIRS})
    """,
)
def average_lengths(spark, folder):
    out = X.average_lengths(turn_pairs(spark, folder), ["title", "description"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "language_top_n_others",
    """
    WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY source),
    g AS (SELECT CASE WHEN r <= 7 THEN source ELSE 'Others' END AS source, sum(n)::BIGINT AS n FROM c GROUP BY 1)
    SELECT source, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 9) AS percent FROM g
    """,
)
def language_top_n_others(spark, folder):
    return X.top_with_others(docs(spark, folder), "source", 7).withColumn("percent", F.round("percent", 9))


@query("distinct_counts", "SELECT count(DISTINCT lang) AS lang, count(DISTINCT source) AS source FROM documents")
def distinct_counts(spark, folder):
    return X.distinct_counts(docs(spark, folder), ["lang", "source"])


@query("repeated_rows", "SELECT count(*) - count(DISTINCT text) AS repeated FROM documents")
def repeated_rows(spark, folder):
    return X.repeated_rows(table(spark, folder, "documents").select("text"), "text")


@query("head_rows", "SELECT doc_id, lang, split FROM (" + sql_split("documents", "lang", "0.2", 42) + ") QUALIFY row_number() OVER (PARTITION BY split ORDER BY doc_id) <= 100")
def head_rows(spark, folder):
    split = B.stratified_split(docs(spark, folder), "lang", "doc_id").select("doc_id", "lang", "split")
    return E.head_rows(split, "split", "doc_id", 100)


@query("label_filter", "SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def label_filter(spark, folder):
    return docs(spark, folder).where(F.col("lang") == "fr").select("doc_id", "source")


# ----------------------------------------------------------------- training table


@query(
    "training_table",
    f"""
    WITH {SQL_NESTED},
    kept AS (
      SELECT n.doc_id, n.lang, n.split, n.text FROM nested n WHERE n.text <> ';'
      QUALIFY row_number() OVER (PARTITION BY n.split, n.text ORDER BY n.doc_id) = 1
    ),
    m AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS label_id FROM (SELECT DISTINCT lang FROM kept WHERE split = 'train'))
    SELECT k.doc_id, k.split, {sql_model_text('k.text')} AS text, m.label_id, m.label_id IS NULL AS unseen_label
    FROM kept k LEFT JOIN m USING (lang)
    """,
)
def training_table(spark, folder):
    from .fusion import training_table as build

    rows = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return build(rows, "doc_id", "lang", "text").select("doc_id", "split", "text", "label_id", "unseen_label")
