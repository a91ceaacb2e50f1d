"""Registered queries: near-duplicates, features, classifiers, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import features as P
from ..operators import similar as S
from ..operators.balance import stratified_split
from ..operators.labels import encode, label_map
from ..scale import kept, spread
from ..session import shared_folder
from ..sources import readers, writers
from ..streaming import incremental
from .label_queries import sql_split
from .registry import query, table
from .text_queries import sql_clean

# ---------------------------------------------------------------- near-duplicates


def vectors(spark, folder):
    """Vectors with a rounded mean, which plays the grey mean of an image."""
    rows = table(spark, folder, "embeddings")
    mean = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda t, x: t + x) / F.size("embedding")
    return rows.select("vec_id", "embedding", (F.round(mean, 2) + F.lit(0.0)).alias("mean"))


PAIRS = """
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e, round(list_sum(embedding::DOUBLE[]) / len(embedding), 2) + 0.0 AS mean FROM embeddings),
    pairs AS (
      SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS cosine
      FROM v a JOIN v b ON a.mean = b.mean AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 9) > 0.3
    )"""


@query("near_duplicate_pairs", f"WITH {PAIRS} SELECT vec_id, other, round(cosine, 6) AS cosine FROM pairs")
def near_duplicate_pairs(spark, folder):
    pairs = S.similar_vectors(vectors(spark, folder), ["mean"], "vec_id", "embedding", 0.3)
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query("near_duplicate_lists", f"WITH {PAIRS} SELECT vec_id, other, count(*) OVER (PARTITION BY vec_id) AS n FROM pairs")
def near_duplicate_lists(spark, folder):
    pairs = S.similar_vectors(vectors(spark, folder), ["mean"], "vec_id", "embedding", 0.3)
    return S.duplicate_rows(pairs, "vec_id").select("vec_id", "other", "n")


@query("near_duplicate_removal", f"WITH {PAIRS} SELECT vec_id, mean FROM v WHERE vec_id NOT IN (SELECT other FROM pairs)")
def near_duplicate_removal(spark, folder):
    rows = vectors(spark, folder)
    return S.without_similar(rows, ["mean"], "vec_id", "embedding", 0.3).select("vec_id", "mean")


def with_near_copies(spark, folder):
    """All vectors, a slightly moved copy of every seventh and an exact copy of every tenth."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    step = lambda i: ((F.col("vec_id") * 31 + i * 17) % 21 - 10) / F.lit(500.0)
    moved = rows.where("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x, i: x + step(i)))
    copies = rows.where("vec_id % 10 = 3")
    shifted = lambda df, by: df.withColumn("vec_id", F.col("vec_id") + by)
    return rows.unionByName(shifted(moved, 1_000_000_000)).unionByName(shifted(copies, 2_000_000_000))


NEAR = """
    v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      UNION ALL SELECT vec_id + 1000000000, label, list_transform(embedding::DOUBLE[], lambda x, i: x + ((vec_id * 31 + (i - 1) * 17) % 21 - 10) / 5e2) FROM embeddings WHERE vec_id % 7 = 0
      UNION ALL SELECT vec_id + 2000000000, label, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 10 = 3),
    c AS (SELECT *, min(vec_id) OVER (PARTITION BY label, e) AS class_id FROM v),
    links AS (
      SELECT a.class_id, b.class_id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS cosine
      FROM c a JOIN c b ON a.label = b.label AND a.vec_id = a.class_id AND b.vec_id = b.class_id AND a.vec_id < b.vec_id
      WHERE round(list_cosine_similarity(a.e, b.e), 9) > 0.95)"""


@query("near_duplicate_links", f"WITH {NEAR} SELECT class_id, other, round(cosine, 6) AS cosine FROM links")
def near_duplicate_links(spark, folder):
    _, links = S.similar_classes(with_near_copies(spark, folder), ["label"], "vec_id", "embedding", 0.95)
    return links.withColumn("cosine", F.round("cosine", 6))


@query(
    "near_duplicate_counts",
    f"""
    WITH {NEAR}, n AS (SELECT class_id, count(*) AS n FROM c GROUP BY 1),
    both_ways AS (SELECT class_id, other, 0 AS earlier FROM links UNION ALL SELECT other, class_id, 1 FROM links),
    linked AS (SELECT b.class_id, sum(n.n)::BIGINT AS n, sum(earlier)::BIGINT AS earlier FROM both_ways b JOIN n ON n.class_id = b.other GROUP BY 1)
    SELECT vec_id, c.class_id, coalesce(linked.n, 0) + n.n - 1 AS n_similar, coalesce(earlier, 0) + (vec_id <> c.class_id)::BIGINT AS n_earlier
    FROM c JOIN n USING (class_id) LEFT JOIN linked ON linked.class_id = c.class_id
    """,
)
def near_duplicate_counts(spark, folder):
    return S.similar_counts(with_near_copies(spark, folder), ["label"], "vec_id", "embedding", 0.95)


# -------------------------------------------------------------- features, models


@query(
    "fusion_features",
    """
    SELECT vec_id AS row_id, len(f)::INT AS width, round(list_sum(f), 6) AS total FROM (
      SELECT vec_id, list_concat([length(text)::DOUBLE, len(string_split(text, ' '))::DOUBLE], embedding::DOUBLE[]) AS f
      FROM embeddings JOIN documents ON doc_id = vec_id)
    """,
)
def fusion_features(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    lengths = F.array(F.length("text").cast("double"), T.word_count("text").cast("double"))
    texts = docs.select(F.col("doc_id").alias("row_id"), lengths.alias("text_vector"))
    images = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("image_vector")
    )
    both = P.fusion_features(texts, images, "row_id", "text_vector", "image_vector")
    total = F.aggregate("features", F.lit(0.0), lambda t, x: t + x)
    return both.select("row_id", F.size("features").alias("width"), F.round(total, 6).alias("total"))


def split_documents(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"), "doc_id")
    coded = encode(docs, "lang", label_map(docs, "lang"))
    return stratified_split(coded, "lang", "doc_id")


def classified(spark, folder):
    """The split documents, and the classes of the held-out ones by a classifier at its own defaults."""
    rows = split_documents(spark, folder)
    model = P.train_text_classifier(rows.where("split = 'train'"), "text", "label_id")
    return rows, P.classify_texts(model, rows.where("split = 'test'"), "doc_id", "text")


@query("text_classifier")
def text_classifier(spark, folder):
    return classified(spark, folder)[1]


@query("text_classifier_held_out", f"SELECT doc_id, lang, true AS beats_largest FROM ({sql_split('documents', 'lang', '0.2', 42)}) WHERE split = 'test'")
def text_classifier_held_out(spark, folder):
    """The held-out documents with their true class, and whether the classifier is right more often than by naming the largest class."""
    rows, found = classified(spark, folder)
    held = kept(rows.where("split = 'test'").select("doc_id", "lang", "label_id").join(found, "doc_id"), "classified")
    right = held.agg(F.avg((F.col("label_id") == F.col("predicted")).cast("int"))).first()[0] or 0.0
    largest = held.groupBy("lang").count().agg(F.max("count") / F.sum("count")).first()[0] or 0.0
    return held.select("doc_id", "lang", F.lit(right > largest).alias("beats_largest"))


def split_vectors(spark, folder):
    return stratified_split(table(spark, folder, "embeddings"), "label", "vec_id")


@query("embedding_classifier")
def embedding_classifier(spark, folder):
    rows = split_vectors(spark, folder)
    model = P.train_vector_classifier(rows.where("split = 'train'"), "embedding", "label")
    return P.classify_vectors(model, rows.where("split = 'test'"), "vec_id", "embedding")


@query("embedding_classifier_dense")
def embedding_classifier_dense(spark, folder):
    rows = split_vectors(spark, folder)
    model = P.train_vector_classifier(rows.where("split = 'train'"), "embedding", "label", 30, hidden=(64, 32))
    return P.classify_vectors(model, rows.where("split = 'test'"), "vec_id", "embedding")


@query("late_fusion")
def late_fusion(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "text")
    images = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")
    rows = stratified_split(images.join(docs, "row_id"), "label", "row_id")
    model = P.train_late_fusion(
        rows.where("split = 'train'"), "text", "embedding", "label", text_size=64, hidden=(64, 32), iterations=20
    )
    return P.classify_fused(model, rows.where("split = 'test'"), "row_id", "text", "embedding")


@query("grid_search")
def grid_search(spark, folder):
    rows = split_vectors(spark, folder).where("split = 'train'")
    _, trials = P.grid_search(rows, "embedding", "label", [0.0, 0.01, 0.1], [0.0, 0.5], iterations=10)
    stored = writers.store_results(spark, shared_folder(spark, "trials"), trials.withColumn("run", F.lit(1)), "trial", "run")
    return E.leaderboard(stored, "trial", "val_accuracy")


@query("compare_heads")
def compare_heads(spark, folder):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    rows = split_vectors(spark, folder)
    heads = {
        "logistic": LogisticRegression(maxIter=20, regParam=0.01),
        "forest": RandomForestClassifier(numTrees=10, maxDepth=4, seed=42),
    }
    found = P.compare_heads(rows.where("split = 'train'"), rows.where("split = 'test'"), "embedding", "label", heads)
    stored = writers.store_results(spark, shared_folder(spark, "models"), found.withColumn("run", F.lit(1)), "model", "run")
    return E.leaderboard(stored, "model", "val_accuracy")


@query("word_vectors")
def word_vectors(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return P.word_vectors(docs, "doc_id", "text", size=16)


@query("extract_features", "SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])), 4) AS length FROM embeddings")
def extract_features(spark, folder):
    def make_predict():
        import numpy as np

        def predict(batch):
            return np.sqrt((batch.astype("float64") ** 2).sum(axis=1, keepdims=True)).astype("float32")

        return predict

    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    out = P.extract_features(rows, "embedding", make_predict, 64)
    return out.select("vec_id", F.round(F.get("features", F.lit(0)).cast("double"), 4).alias("length"))


@query("submission")
def submission(spark, folder):
    rows = split_vectors(spark, folder)
    model = P.train_vector_classifier(rows.where("split = 'train'"), "embedding", "label", 20)
    found = P.classify_vectors(model, rows.where("split = 'test'"), "vec_id", "embedding")
    codes = [str(r["code"]) for r in label_map(rows, "label").orderBy("label_id").collect()]  # one row per class
    target = shared_folder(spark, "submission")
    writers.write_submission(P.original_codes(found, codes), target, "vec_id")
    return readers.read_csv(spark, target, "vec_id bigint, prdtypecode int", multi_line=False)


# ------------------------------------------------------------------ files, streams


@query("csv_round_trip", "SELECT doc_id AS row_id, text, lang FROM documents")
def csv_round_trip(spark, folder):
    target = shared_folder(spark, "csv")
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")
    writers.write_csv(spread(rows, "row_id"), target, quote_all=True)
    return readers.read_csv(spark, target, "row_id bigint, text string, lang string")


@query(
    "split_files",
    "SELECT p_partkey, p_name, CASE WHEN p_size <= 30 THEN 'train' WHEN p_size <= 40 THEN 'val' ELSE 'test' END AS split FROM part",
)
def split_files(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    target = shared_folder(spark, "splits")
    paths = {s: f"{target}/{s}" for s in ("train", "val", "test")}
    writers.write_csv(part.where("p_size <= 30").drop("p_size"), paths["train"])
    writers.write_csv(part.where("p_size > 30 and p_size <= 40").drop("p_size"), paths["val"])
    writers.write_csv(part.where("p_size > 40").drop("p_size"), paths["test"])
    return readers.read_split_csvs(spark, paths, "p_partkey bigint, p_name string", multi_line=False)


@query(
    "split_table",
    "SELECT doc_id, lang, CASE WHEN source IN ('src1', 'src2') THEN 'val' ELSE 'train' END AS part FROM documents",
)
def split_table(spark, folder):
    from .fusion import load_splits, save_splits

    rows = table(spark, folder, "documents").select("doc_id", "lang", "source")
    part = F.when(F.col("source").isin("src1", "src2"), "val").otherwise("train")
    target = shared_folder(spark, "split-table")
    save_splits(rows.withColumn("split", part), target)
    parts = [load_splits(spark, target, p).select("doc_id", "lang", F.lit(p).alias("part")) for p in ("train", "val")]
    return parts[0].unionByName(parts[1])


@query(
    "result_store",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id",
)
def result_store(spark, folder):
    """All events reach the store in three writes; the latest of each user is read from it."""
    target = shared_folder(spark, "store")
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id")
    latest = [F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id")]
    for third in (0, 1, 2):
        out = writers.store_results(
            spark, target, rows.where(F.col("event_id") % 3 == third).groupBy("user_id").agg(*latest), "user_id", "event_id"
        )
    return out


@query("stream_clean_available_now", f"SELECT doc_id, lang, {sql_clean('text')} AS text FROM documents")
def stream_clean_available_now(spark, folder):
    schema = table(spark, folder, "documents").schema

    def clean(df):
        return df.select("doc_id", "lang", T.clean_text("text").alias("text"))

    return incremental.process_new_files(spark, folder, "documents.parquet", schema, clean)


@query(
    "stream_first_arrivals",
    """
    SELECT user_id, event_type, event_id, epoch_us(ts) AS at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
    """,
)
def stream_first_arrivals(spark, folder):
    """Two deliveries with a restart between them; the second ends with a row that only moves the clock."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2)
    source, target, state = (shared_folder(spark, n) for n in ("events", "arrivals", "arrival-state"))

    def earliest(stream):
        return incremental.first_arrivals(stream, "ts", ["user_id", "event_type"], "event_id", "1 hour")

    clock = events.limit(1).select([(F.col("ts") + F.expr("INTERVAL 9999 DAYS")).alias("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
    for delivery in (events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle).unionByName(clock)):
        delivery.write.mode("append").parquet(source)
        out = incremental.process_new_files(spark, source, "*.parquet", events.schema, earliest, target, state)
    return out.select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("at"))
