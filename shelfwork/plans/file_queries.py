"""Registered queries: files written from a given table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich as L
from ..operators import explore as X
from ..operators import vocab as V
from ..session import shared_folder
from ..sources import readers, writers
from .registry import query, table
from .vocab_queries import PROFILES, batched, docs, strict_digest


@query(
    "read_catalogue_csv",
    """
    SELECT p_partkey AS row_id, p_name AS designation, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_type || chr(10) || '"' || p_brand || '", x' END AS description,
      p_partkey * 10 AS productid, p_size::BIGINT AS imageid FROM part
    """,
)
def read_catalogue_csv(spark, folder):
    """A catalogue with line breaks, quotes and empty descriptions."""
    part = table(spark, folder, "part")
    text = F.concat("p_type", F.lit('\n"'), "p_brand", F.lit('", x'))
    rows = part.select(
        F.col("p_partkey").alias(" "), F.col("p_name").alias("designation"),
        F.when(F.col("p_size") % 3 != 0, text).alias("description"), (F.col("p_partkey") * 10).alias("productid"), F.col("p_size").alias("imageid"),
    )
    target = shared_folder(spark, "catalogue")
    writers.write_csv(rows, target)
    return readers.read_csv(spark, target, readers.CATALOGUE, null_as=" ")


@query(
    "read_label_map",
    "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS label_id, n_name AS code FROM nation",
)
def read_label_map(spark, folder):
    """One JSON object of ids and names."""
    nation = table(spark, folder, "nation")
    entries = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    pairs = F.transform(entries, lambda e, i: F.struct(i.cast("string"), e["n_name"]))
    target = shared_folder(spark, "labels")
    nation.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).coalesce(1).write.text(target)
    return readers.read_label_map(spark, f"{target}/part-*.txt")


LOGS = """
    log AS (
      SELECT user_id, event_id, round(event_id / 1000.0::DOUBLE, 4) AS epoch, round(value, 6) AS loss FROM events
    )"""


#: Event ids in a block: a log holds the events of a block at most, and epochs are numbered block by block.
BLOCK = 1 << 16


@query("log_history", f"WITH {LOGS} SELECT epoch, loss, loss / 2 AS eval_loss, loss / 4 AS eval_Accuracy FROM log")
def log_history(spark, folder):
    """Training logs, one JSON file for each group of users and block of events."""
    rows = table(spark, folder, "events").select(
        (F.col("user_id") % 8).alias("trial"), F.expr(f"event_id div {BLOCK}").alias("block"),
        F.round(F.col("event_id") / 1000.0, 4).alias("epoch"), F.round("value", 6).alias("loss"),
    )
    entry = F.struct("epoch", "loss", (F.col("loss") / 2).alias("eval_loss"), (F.col("loss") / 4).alias("eval_Accuracy"))
    target = shared_folder(spark, "logs")
    logs = rows.groupBy("trial", "block").agg(F.collect_list(entry).alias("log_history"))
    logs.write.partitionBy("trial", "block").json(target)
    return readers.read_log_history(spark, target)


TRIALS = """
    e AS (SELECT event_type AS trial_id, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS epoch FROM events),
    last AS (SELECT trial_id, arg_max(value, epoch) AS accuracy, max(epoch) AS epochs FROM e GROUP BY trial_id)"""


@query(
    "trial_overview",
    f"WITH {TRIALS} SELECT trial_id, accuracy, epochs, CASE WHEN trial_id LIKE '%e%' THEN 'units=' || length(trial_id) ELSE '' END AS parameters FROM last",
)
def trial_overview(spark, folder):
    """Histories and parameters of trials, a folder each, an epoch in a line; some trials have no parameters."""
    from pyspark.sql import Window as W

    events = table(spark, folder, "events").select(F.col("event_type").alias("trial"), "event_id", "value")
    events = events.withColumn("block", F.coalesce(F.expr(f"event_id div {BLOCK}"), F.lit((1 << 63) - 1)))  # null ids are last
    before = W.partitionBy("trial").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    offsets = events.groupBy("trial", "block").agg(F.count("*").alias("n"))
    offsets = offsets.select(F.col("trial").alias("own"), F.col("block").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("trial", "block").orderBy("event_id"))
    numbered = events.withColumn("place", place).join(offsets, F.expr("trial <=> own and block = at"))
    epochs = numbered.select("trial", (F.col("before") + F.col("place")).alias("epoch"), F.col("value").alias("accuracy"), F.col("value").alias("loss"))
    target = shared_folder(spark, "trials")
    epochs.write.partitionBy("trial").json(f"{target}/histories")
    named = events.select("trial").where(F.contains(F.col("trial"), F.lit("e"))).distinct()
    hyper = F.struct(F.struct(F.create_map(F.lit("units"), F.length("trial").cast("string")).alias("values")).alias("hyperparameters"))
    named.select("trial", F.to_json(hyper["hyperparameters"]).alias("value")).write.partitionBy("trial").text(f"{target}/parameters")
    trial = F.element_at(F.split(readers.path_part(F.col("_metadata.file_path"), -2), "="), -1).alias("trial_id")
    history = spark.read.schema("epoch long, accuracy double").json(f"{target}/histories").select(trial, "epoch", "accuracy")
    parameters = spark.read.schema("values map<string,string>").json(f"{target}/parameters").select(trial, F.col("values").alias("parameters"))
    scores = history.groupBy("trial_id").agg(F.max_by("accuracy", "epoch").alias("accuracy"), F.max("epoch").alias("epochs"))
    shown = readers.with_parameters(scores, parameters)
    text = F.array_join(F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return shown.select("trial_id", "accuracy", "epochs", text.alias("parameters"))


@query(
    "save_parts",
    """
    SELECT p_partkey AS row_id, p_name AS text, p_size AS prdtypecode, 'image_' || p_partkey || '_product_' || p_size || '.jpg' AS image_name,
      'raw/image_' || p_partkey || '_product_' || p_size || '.jpg' AS image_path FROM part
    """,
)
def save_parts(spark, folder):
    """Texts, labels and paths of a split in files of their own, joined again by row."""
    from ..operators import columns as C

    part = table(spark, folder, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("text"), F.col("p_size").alias("prdtypecode"))
    named = C.with_paths(
        part.withColumns({"imageid": F.col("row_id"), "productid": F.col("prdtypecode")}), {"raw": "raw/", "preprocessed": "pre/", "grey": "grey/"}
    )
    target = shared_folder(spark, "parts")
    writers.save_parts(named, target, "train", ["text"])
    x = readers.read_csv(spark, f"{target}/X_train", "row_id bigint, text string", multi_line=False)
    y = readers.read_csv(spark, f"{target}/y_train", f"row_id bigint, prdtypecode {dict(part.dtypes)['prdtypecode']}", multi_line=False)
    paths = readers.read_csv(spark, f"{target}/images_train", "row_id bigint, image_name string, image_path string, pre string", multi_line=False)
    return x.join(y, "row_id").join(paths.drop("pre"), "row_id")


@query(
    "language_distribution",
    f"""
    WITH {PROFILES},
    s AS (SELECT g.doc_id, p.lang, sum(p.share) AS score FROM grams g JOIN profiles p ON p.gram = g.gram GROUP BY ALL),
    b AS (SELECT doc_id, lang AS detected FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1),
    c AS (SELECT detected, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, detected) AS r FROM b GROUP BY detected),
    g AS (SELECT CASE WHEN r <= 2 THEN detected ELSE 'Others' END AS detected, sum(n)::BIGINT AS n FROM c GROUP BY 1)
    SELECT detected, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 9) AS percent FROM g
    """,
)
def language_distribution(spark, folder):
    """Documents per detected language, the rare ones together."""
    rows = docs(spark, folder, "lang")
    found = V.detect_language(rows, "doc_id", "text", V.language_profiles(rows, "lang", "text"), "lang")
    return X.top_with_others(found.where("detected is not null"), "detected", 2).withColumn("percent", F.round("percent", 9))


STRICT = "SELECT doc_id, CASE WHEN contains(text, '@') THEN 'error' WHEN ends_with(text, ',') THEN 'missing' ELSE 'ok' END AS status FROM documents"


@query("error_table", f"WITH s AS ({STRICT}) SELECT status, count(*) AS n, min(doc_id) AS first FROM s WHERE status <> 'ok' GROUP BY status")
def error_table(spark, folder):
    """Failed and missing replies, appended to a table by two runs and read from it."""
    target = shared_folder(spark, "errors")
    rows = docs(spark, folder)
    for half in (0, 1):
        replies = L.enrich_rows(rows.where(F.col("doc_id") % 2 == half), "doc_id", "text", strict_digest)
        writers.append_rows(L.quarantine(replies, "doc_id"), target)
    return spark.read.parquet(target).groupBy("status").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("reply_log", f"WITH s AS ({STRICT}) SELECT d.doc_id, CASE WHEN status = 'ok' THEN md5(d.text) END AS reply, status FROM documents d JOIN s USING (doc_id)")
def reply_log(spark, folder):
    """All replies as JSON lines."""
    target = shared_folder(spark, "replies")
    writers.write_json_lines(L.enrich_rows(docs(spark, folder), "doc_id", "text", strict_digest, on_error="null"), target)
    return spark.read.schema("doc_id long, reply string, status string").json(target)


@query(
    "path_lookup",
    """
    SELECT p.p_partkey, l.path FROM part p LEFT JOIN (
      SELECT p_name AS file, max('tree/' || p_type || '/' || p_name) AS path FROM part WHERE p_size > 25 GROUP BY p_name
    ) l ON l.file = p.p_name
    """,
)
def path_lookup(spark, folder):
    """The path of each part's file in a listing."""
    part = table(spark, folder, "part")
    listing = part.where("p_size > 25").select(F.col("p_name").alias("file"), F.concat(F.lit("tree/"), "p_type", F.lit("/"), "p_name").alias("path"))
    index = readers.file_index(listing)
    return part.select("p_partkey", F.col("p_name").alias("file")).join(index, "file", "left").select("p_partkey", "path")


@query("parse_replies_loose", "SELECT doc_id, md5(text) AS reply FROM documents")
def parse_replies_loose(spark, folder):
    """Replies numbered ``1.`` inside a line each, and bare ones of batches of one text."""
    rows = batched(spark, folder)
    group = ["chunk", "length_class", "batch"]
    pairs = F.sort_array(F.collect_list(F.struct("number", "doc_id", F.md5("text").alias("line"))))
    replies = rows.groupBy(*group).agg(pairs.alias("rows"))
    listed = F.array_join(F.transform("rows", lambda p: F.concat(p["number"].cast("string"), F.lit(". "), p["line"])), "\n")
    reply = F.when(F.size("rows") == 1, F.get("rows", F.lit(0))["line"]).otherwise(listed)
    parsed = replies.withColumn("reply", reply).withColumn("m", T.parse_numbered("reply", inline=True, single=True))
    return parsed.select("m", F.explode("rows").alias("r")).select("r.doc_id", T.strip(F.try_element_at("m", F.col("r.number").cast("string"))).alias("reply"))
