"""Registered queries: evaluation reports, histories, leaderboards, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import evaluate as E
from ..operators import history as H
from ..operators import labels as N
from .registry import query, table

# The first ten values of an embedding play the logits of ten classes.


def scored(spark, folder):
    rows = table(spark, folder, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return rows.select("vec_id", "label", logits.alias("logits"))


def predicted(spark, folder):
    return scored(spark, folder).select("vec_id", "label", N.argmax("logits").alias("pred"))


PRED = "(SELECT vec_id, label, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INT AS pred FROM embeddings)"


@query(
    "softmax_argmax",
    """
    WITH l AS (SELECT vec_id, embedding[1:10]::DOUBLE[] AS z FROM embeddings),
    e AS (SELECT vec_id, z, [exp(x - list_max(z)) FOR x IN z] AS p FROM l)
    SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS predicted, round(list_max(p) / list_sum(p), 6) AS confidence FROM e
    """,
)
def softmax_argmax(spark, folder):
    out = E.predictions(scored(spark, folder), "logits")
    return out.select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"))


@query(
    "prediction_names",
    f"""
    WITH m(code, name) AS (SELECT n_nationkey::INT, n_name FROM nation)
    SELECT p.vec_id, p.label, p.pred, a.name AS true_name, b.name AS pred_name, p.label = p.pred AS correct
    FROM {PRED} p LEFT JOIN m a ON a.code = p.label LEFT JOIN m b ON b.code = p.pred
    """,
)
def prediction_names(spark, folder):
    names = table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("code"), "n_name")
    rows = C.with_names(predicted(spark, folder), "label", names, "n_name", "true_name")
    rows = C.with_names(rows, "pred", names, "n_name", "pred_name")
    return rows.withColumn("correct", F.col("label") == F.col("pred"))


MATRIX = f"""
    counts AS (SELECT label AS true_class, pred AS pred_class, count(*) AS n FROM {PRED} GROUP BY ALL),
    classes AS (SELECT true_class AS c FROM counts UNION SELECT pred_class FROM counts),
    matrix AS (
      SELECT a.c AS true_class, b.c AS pred_class, coalesce(n, 0) AS n
      FROM classes a CROSS JOIN classes b LEFT JOIN counts ON counts.true_class = a.c AND counts.pred_class = b.c
    ),
    sums AS (
      SELECT c AS class, (SELECT sum(n) FROM matrix WHERE true_class = c AND pred_class = c)::DOUBLE AS tp,
        (SELECT sum(n) FROM matrix WHERE pred_class = c)::DOUBLE AS predicted, (SELECT sum(n) FROM matrix WHERE true_class = c)::BIGINT AS support
      FROM classes
    ),
    rated AS (
      SELECT class, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, support FROM sums
    ),
    report AS (
      SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1, support FROM rated
    )"""


def matrix(spark, folder):
    return E.confusion(predicted(spark, folder), "label", "pred")


@query("confusion_matrix", f"WITH {MATRIX} SELECT true_class, pred_class, n FROM matrix")
def confusion_matrix(spark, folder):
    return matrix(spark, folder)


@query("confusion_normalized", f"WITH {MATRIX} SELECT true_class, pred_class, round(n / sum(n) OVER (PARTITION BY true_class), 2) AS share FROM matrix")
def confusion_normalized(spark, folder):
    return E.confusion_normalized(matrix(spark, folder))


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("classification_report", f"WITH {MATRIX} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report")
def classification_report(spark, folder):
    return rounded(E.class_report(matrix(spark, folder)), "precision", "recall", "f1")


@query(
    "report_averages",
    f"""
    WITH {MATRIX} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
      round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
      round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support,
      round((SELECT sum(n) FILTER (true_class = pred_class) / sum(n) FROM matrix), 6) AS accuracy
    FROM report
    """,
)
def report_averages(spark, folder):
    out = E.report_averages(matrix(spark, folder))
    return rounded(out, *[c for c in out.columns if c != "support"])


@query("confused_pairs", f"WITH {MATRIX} SELECT true_class, pred_class, n FROM matrix WHERE true_class <> pred_class AND n > 0 ORDER BY n DESC, true_class DESC, pred_class DESC LIMIT 10")
def confused_pairs(spark, folder):
    return E.confused_pairs(matrix(spark, folder))


@query(
    "best_worst_classes",
    f"""
    WITH {MATRIX}, r AS (
      SELECT class, f1, row_number() OVER (ORDER BY f1 DESC, class)::INT AS best_rank, row_number() OVER (ORDER BY f1, class)::INT AS worst_rank FROM report)
    SELECT class, round(f1, 6) AS f1, best_rank, worst_rank FROM r WHERE best_rank <= 3 OR worst_rank <= 3
    """,
)
def best_worst_classes(spark, folder):
    return rounded(E.best_and_worst(E.class_report(matrix(spark, folder))), "f1")


def halves(spark, folder):
    """Two predictions of every row, from the first and from the next ten values."""
    rows = table(spark, folder, "embeddings")
    return (
        rows.select("label", N.argmax(F.slice("embedding", 1, 10)).alias("pred")),
        rows.select("label", N.argmax(F.slice("embedding", 11, 10)).alias("pred")),
    )


def sql_f1(name: str, cut: str) -> str:
    pred = f"(SELECT label, (list_position({cut}, list_max({cut})) - 1)::INT AS pred FROM embeddings)"
    return f"""
    {name} AS (
      SELECT c AS class, coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0)::DOUBLE AS f1 FROM (
        SELECT c, count(*) FILTER (label = c AND pred = c) AS tp, count(*) FILTER (label = c) AS support, count(*) FILTER (pred = c) AS predicted
        FROM {pred} p, (SELECT DISTINCT label AS c FROM embeddings) GROUP BY c))"""


@query(
    "report_compare",
    f"""
    WITH {sql_f1('a', 'embedding[1:10]')}, {sql_f1('b', 'embedding[11:20]')}
    SELECT class, round(a.f1, 6) AS val_f1, round(b.f1, 6) AS test_f1, round(b.f1 - a.f1, 6) AS difference FROM a JOIN b USING (class)
    """,
)
def report_compare(spark, folder):
    a, b = [E.class_report(E.confusion(x, "label", "pred")) for x in halves(spark, folder)]
    return rounded(E.compare_reports(a, b), "val_f1", "test_f1", "difference")


@query(
    "overfit_gap",
    """
    WITH p AS (
      SELECT label, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INT AS a,
        (list_position(embedding[11:20], list_max(embedding[11:20])) - 1)::INT AS b FROM embeddings),
    s AS (SELECT avg(CASE WHEN a = label THEN 1.0::DOUBLE ELSE 0 END) AS train, avg(CASE WHEN b = label THEN 1.0::DOUBLE ELSE 0 END) AS val, count(DISTINCT b) AS predicted_classes FROM p)
    SELECT round(train, 6) AS train_accuracy, round(val, 6) AS val_accuracy, round(train - val, 6) AS gap, predicted_classes,
      CASE WHEN train - val > 0.15 THEN 'significant' WHEN train - val > 0.08 THEN 'moderate' ELSE 'good' END AS gap_verdict,
      CASE WHEN val >= 0.65 THEN 'excellent' WHEN val >= 0.58 THEN 'good' WHEN val >= 0.52 THEN 'modest' ELSE 'baseline' END AS accuracy_verdict
    FROM s
    """,
)
def overfit_gap(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "label", N.argmax(F.slice("embedding", 1, 10)).alias("a"), N.argmax(F.slice("embedding", 11, 10)).alias("b")
    )

    def share(c):
        return F.avg(F.when(F.col(c) == F.col("label"), 1.0).otherwise(0.0))

    one = rows.agg(share("a").alias("train_accuracy"), share("b").alias("val_accuracy"), F.count_distinct("b").alias("predicted_classes"))
    gap = F.col("train_accuracy") - F.col("val_accuracy")
    judged = one.withColumns(
        {"gap": gap, "gap_verdict": E.gap_verdict(gap), "accuracy_verdict": E.accuracy_verdict("val_accuracy")}
    )
    return rounded(judged, "train_accuracy", "val_accuracy", "gap")


@query(
    "accuracy_by_split",
    f"""
    WITH p AS (SELECT p.*, CASE WHEN length(d.text) < 500 THEN 'train' WHEN length(d.text) < 2000 THEN 'val' ELSE 'test' END AS split
      FROM {PRED} p JOIN documents d ON d.doc_id = p.vec_id),
    a AS (SELECT avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) FILTER (split = 'train') AS train,
      avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) FILTER (split = 'val') AS val,
      avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) FILTER (split = 'test') AS test FROM p)
    SELECT round(train, 6) AS train, round(val, 6) AS val, round(test, 6) AS test,
      round(val - train, 6) AS val_minus_train, round(test - val, 6) AS test_minus_val FROM a
    """,
)
def accuracy_by_split(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.length("text").alias("n"))
    part = F.when(F.col("n") < 500, "train").when(F.col("n") < 2000, "val").otherwise("test")
    rows = predicted(spark, folder).join(docs, "vec_id").withColumn("split", part)
    out = E.accuracy_by_split(rows, "split", "label", "pred")
    return rounded(out, *out.columns)


# ------------------------------------------------------------------- histories

# Events play batch rows of training runs: user = run, day = epoch.


def batches(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_type", "value")
    return events.withColumn("day", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1)


BATCHES = "(SELECT user_id, event_type, value, (ts::DATE - DATE '2024-01-01' + 1)::INT AS day FROM events)"


@query(
    "epoch_means",
    f"""
    SELECT user_id, day, round(avg(value) FILTER (event_type IN ('click', 'view')), 6) AS loss,
      round(avg(value) FILTER (event_type IN ('purchase', 'signup')), 6) AS eval_loss,
      round(avg(value) FILTER (event_type = 'error'), 6) AS eval_accuracy
    FROM {BATCHES} GROUP BY user_id, day
    """,
)
def epoch_means(spark, folder):
    def only(*types):
        return F.when(F.col("event_type").isin(*types), F.col("value"))

    metrics = {"loss": only("click", "view"), "eval_loss": only("purchase", "signup"), "eval_accuracy": only("error")}
    return rounded(H.epoch_means(batches(spark, folder), "user_id", "day", metrics), *metrics)


@query(
    "weighted_epoch_means",
    f"""
    WITH b AS (SELECT user_id, day, value, 1 + user_id % 7 AS size, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS correct FROM {BATCHES})
    SELECT user_id, day, round(sum(value * size) / sum(size), 6) AS loss, round(sum(correct) / sum(size), 6) AS accuracy FROM b GROUP BY user_id, day
    """,
)
def weighted_epoch_means(spark, folder):
    rows = batches(spark, folder).withColumns(
        {"size": 1 + F.col("user_id") % 7, "correct": F.when(F.col("event_type") == "error", 0).otherwise(1)}
    )
    return rounded(H.weighted_epoch_means(rows, "user_id", "day", "value", "correct", "size"), "loss", "accuracy")


def history(spark, folder):
    """One row per run and epoch: epochs are numbered by day, losses rounded."""
    means = H.epoch_means(batches(spark, folder), "user_id", "day", {"loss": F.col("value")})
    return H.numbered_epochs(means.withColumn("loss", F.round("loss", 6)), "user_id", "day")


HISTORY = f"""
    hist AS (
      SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS epoch, loss
      FROM (SELECT user_id, day, round(avg(value), 6) AS loss FROM {BATCHES} GROUP BY ALL)
    )"""


@query(
    "early_stopping",
    f"""
    WITH RECURSIVE {HISTORY},
    st AS (
      SELECT user_id, 1 AS epoch, loss AS best, 0 AS wait, NULL::INT AS stop_epoch FROM hist WHERE epoch = 1
      UNION ALL
      SELECT h.user_id, h.epoch, CASE WHEN h.loss < s.best - 0.5::DOUBLE THEN h.loss ELSE s.best END,
        CASE WHEN h.loss < s.best - 0.5::DOUBLE THEN 0 ELSE s.wait + 1 END,
        CASE WHEN NOT h.loss < s.best - 0.5::DOUBLE AND s.wait + 1 >= 6 THEN h.epoch END
      FROM st s JOIN hist h ON h.user_id = s.user_id AND h.epoch = s.epoch + 1 WHERE s.stop_epoch IS NULL
    )
    SELECT user_id, arg_max(best, epoch) AS best, arg_max_null(stop_epoch, epoch) AS stop_epoch,
      (SELECT max(h.epoch) FROM hist h WHERE h.user_id = st.user_id) AS epochs
    FROM st GROUP BY user_id
    """,
)
def early_stopping(spark, folder):
    return H.early_stopping(history(spark, folder), "user_id", "epoch", "loss", patience=6, min_delta=0.5)


@query(
    "best_epoch",
    f"WITH {HISTORY} SELECT user_id, epoch AS best_epoch, loss AS best_score FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY loss, epoch) = 1",
)
def best_epoch(spark, folder):
    return H.best_epoch(history(spark, folder), "user_id", "epoch", "loss")


@query(
    "best_epoch_max",
    f"WITH {HISTORY} SELECT user_id, epoch AS best_epoch, loss AS best_score FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY loss DESC, epoch) = 1",
)
def best_epoch_max(spark, folder):
    return H.best_epoch(history(spark, folder), "user_id", "epoch", "loss", mode="max")


def stages(spark, folder):
    rows = history(spark, folder)
    second = rows.where("epoch > 10").withColumn("epoch", F.col("epoch") - 10)
    return H.stack_stages(rows.where("epoch <= 10"), second.withColumn("loss", F.col("loss") / 2), "user_id", "epoch")


STAGES = """
    stages AS (
      SELECT user_id, epoch, loss, 1 AS stage FROM hist WHERE epoch <= 10
      UNION ALL SELECT user_id, epoch - 10 + 10, loss / 2, 2 FROM hist WHERE epoch > 10
    )"""


@query("continuous_epochs", f"WITH {HISTORY}, {STAGES} SELECT user_id, epoch, loss, stage FROM stages")
def continuous_epochs(spark, folder):
    return stages(spark, folder).select("user_id", "epoch", "loss", "stage")


@query("learning_curves", f"WITH {HISTORY}, {STAGES} SELECT user_id, stage, epoch, unnest(['loss', 'half']) AS metric, unnest([loss, loss / 2]) AS value FROM stages")
def learning_curves(spark, folder):
    rows = stages(spark, folder).withColumn("half", F.col("loss") / 2)
    return H.learning_curves(rows, "user_id", "epoch", ["loss", "half"])


@query(
    "topk_trials",
    f"WITH {HISTORY} SELECT user_id, loss FROM (SELECT user_id, arg_max(loss, epoch) AS loss FROM hist GROUP BY user_id) ORDER BY loss DESC, user_id LIMIT 5",
)
def topk_trials(spark, folder):
    return H.top_trials(H.last_scores(history(spark, folder), "user_id", "epoch", ["loss"]), "user_id", "loss")


# ------------------------------------------------------------------ leaderboards


@query(
    "leaderboard_upsert",
    """
    SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS accuracy, arg_max(event_type, event_id) AS model_file
    FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id
    """,
)
def leaderboard_upsert(spark, folder):
    rows = table(spark, folder, "events").select(
        "user_id", "event_id", F.col("value").alias("accuracy"), F.col("event_type").alias("model_file")
    )
    stored, new = rows.where("model_file = 'purchase'"), rows.where("model_file = 'signup'")
    return E.upsert_latest(stored, new, "user_id", "event_id")


@query(
    "leaderboard",
    """
    WITH l AS (SELECT event_type AS model, avg(value) AS accuracy, sum(value) / 60 AS minutes FROM events GROUP BY ALL)
    SELECT model, round(accuracy, 6) AS accuracy, round(minutes, 6) AS minutes, round(accuracy / minutes, 9) AS accuracy_per_minute,
      row_number() OVER (ORDER BY accuracy DESC, model)::INT AS place FROM l
    """,
)
def leaderboard(spark, folder):
    board = table(spark, folder, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.avg("value").alias("accuracy"), (F.sum("value") / 60).alias("minutes")
    )
    placed = E.leaderboard(board, "model", "accuracy", "minutes")
    return rounded(placed.withColumn("accuracy_per_minute", F.round("accuracy_per_minute", 9)), "accuracy", "minutes")


@query(
    "remaining_models",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)",
)
def remaining_models(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    return E.remaining(orders, orders.where("o_orderstatus = 'F'"), "o_custkey")


@query(
    "class_set_difference",
    """
    SELECT p_size, 'first' AS side FROM (SELECT p_size FROM part WHERE p_brand = 'Brand#2' EXCEPT SELECT p_size FROM part WHERE p_brand = 'Brand#3')
    UNION ALL
    SELECT p_size, 'second' FROM (SELECT p_size FROM part WHERE p_brand = 'Brand#3' EXCEPT SELECT p_size FROM part WHERE p_brand = 'Brand#2')
    """,
)
def class_set_difference(spark, folder):
    part = table(spark, folder, "part").select("p_size", "p_brand")
    return E.class_set_difference(part.where("p_brand = 'Brand#2'"), part.where("p_brand = 'Brand#3'"), "p_size")


# ------------------------------------------------------------------------ audits


def enriched(spark, folder):
    """Documents with a made-up reply: some missing, some empty, some unchanged."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text", "n_chars")
    kind = F.col("n_chars") % 10
    reply = (
        F.when(kind == 0, F.lit(None)).when(kind == 1, "[EMPTY]").when(kind == 2, F.col("text")).otherwise(F.md5("text"))
    )
    return docs.withColumn("reply", reply)


ENRICHED = """(SELECT doc_id, lang, text, CASE n_chars % 10 WHEN 0 THEN NULL WHEN 1 THEN '[EMPTY]' WHEN 2 THEN text ELSE md5(text) END AS reply FROM documents)"""
VALID = "(reply IS NOT NULL AND reply <> '[EMPTY]' AND reply <> text)"


@query(
    "enrich_audit",
    f"""
    SELECT lang, count(*) AS total, count(reply) AS not_null, count(*) FILTER (reply = '[EMPTY]') AS empty,
      count(*) FILTER (reply = text) AS identical, count(reply) - count(*) FILTER (reply = '[EMPTY]') - count(*) FILTER (reply = text) AS changed
    FROM {ENRICHED} GROUP BY lang
    """,
)
def enrich_audit(spark, folder):
    return E.enrichment_audit(enriched(spark, folder), "text", "reply", by=["lang"])


@query("enriched_rows", f"SELECT doc_id, {VALID} AS valid FROM {ENRICHED}")
def enriched_rows(spark, folder):
    return enriched(spark, folder).select("doc_id", E.is_enriched("text", "reply").alias("valid"))


@query(
    "resume_point",
    f"SELECT count(*) AS resume_at FROM {ENRICHED} WHERE doc_id < coalesce((SELECT min(doc_id) FROM {ENRICHED} WHERE NOT {VALID}), 9223372036854775807)",
)
def resume_point(spark, folder):
    return E.resume_point(enriched(spark, folder), "doc_id", E.is_enriched("text", "reply"))


@query("resume_remaining", f"SELECT doc_id, lang FROM {ENRICHED} WHERE NOT {VALID}")
def resume_remaining(spark, folder):
    rows = enriched(spark, folder)
    finished = rows.where(E.is_enriched("text", "reply"))
    return C.without_keys(rows.select("doc_id", "lang"), finished, "doc_id")


@query(
    "throughput",
    """
    WITH s AS (SELECT event_type, sum(value) AS total_time, sum(1 + user_id % 5)::BIGINT AS rows FROM events GROUP BY ALL)
    SELECT event_type, round(total_time, 6) AS total_time, rows, round(total_time / rows, 6) AS avg_time_per_row,
      round(rows / total_time, 6) AS rows_per_second, round(total_time / rows * 67932 / 3600, 6) AS expected_hours FROM s
    """,
)
def throughput(spark, folder):
    rows = table(spark, folder, "events").withColumn("rows", 1 + F.col("user_id") % 5)
    out = E.throughput(rows, "event_type", "value", "rows", 67932)
    return rounded(out, "total_time", "avg_time_per_row", "rows_per_second", "expected_hours")
