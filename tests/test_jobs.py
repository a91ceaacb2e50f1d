"""Sources, sinks, enrichment, histories, streams, models."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from shelfwork.operators import columns as C
from shelfwork.operators import enrich as L
from shelfwork.operators import evaluate as E
from shelfwork.operators import features as P
from shelfwork.operators import history as H
from shelfwork.operators import vocab as V
from shelfwork.plans.catalogue import Settings, prepare
from shelfwork.sources import readers, writers
from shelfwork.streaming import incremental


def test_catalogue_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        ',designation,description,productid,imageid\n5,"a ""big"" one","line\nbreak",7,9\n8,b,,1,2\n'
    )
    rows = readers.read_csv(spark, str(tmp_path / "x.csv"), readers.CATALOGUE).orderBy("row_id").collect()
    assert tuple(rows[0]) == (5, 'a "big" one', "line\nbreak", 7, 9)
    assert rows[1]["description"] is None
    filled = readers.read_csv(spark, str(tmp_path / "x.csv"), readers.CATALOGUE, null_as="")
    assert filled.where("row_id = 8").first()["description"] == ""


def test_csv_keeps_awkward_text(spark, tmp_path):
    texts = ['say "x"', "a,b", "new\nline", "back\\slash", " spaces ", None, "é;"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    for quote_all in (False, True):
        path = str(tmp_path / f"out{quote_all}")
        writers.write_csv(df, path, quote_all=quote_all)
        back = readers.read_csv(spark, path, "row_id bigint, text string").orderBy("row_id").collect()
        assert [r["text"] for r in back] == texts


def test_label_map_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"0": "10", "1": "40", "2": "1140"}))
    got = {r["label_id"]: r["code"] for r in readers.read_label_map(spark, str(tmp_path / "m.json")).collect()}
    assert got == {0: "10", 1: "40", 2: "1140"}


def test_trials(spark, tmp_path):
    for name, acc in (("trial_00", [0.1, 0.4]), ("trial_01", [0.3, 0.2])):
        d = tmp_path / name
        d.mkdir()
        zeros = [0.0] * len(acc)
        (d / "history.json").write_text(json.dumps({"loss": zeros, "val_loss": zeros, "accuracy": zeros, "val_accuracy": acc}, indent=1))
    (tmp_path / "trial_00" / "trial.json").write_text(json.dumps({"hyperparameters": {"values": {"rnn_type": "gru", "units": 64}}}))
    history = readers.read_histories(spark, str(tmp_path))
    last = H.last_scores(history, "trial_id", "epoch", ["val_accuracy", "loss"])
    best = H.top_trials(last, "trial_id", "val_accuracy", 1).first()
    assert (best["trial_id"], best["val_accuracy"]) == ("trial_00", 0.4)
    parameters = readers.read_parameters(spark, str(tmp_path))
    got = {r["trial_id"]: r["parameters"] for r in readers.with_parameters(last, parameters).collect()}
    assert got == {"trial_00": {"rnn_type": "gru", "units": "64"}, "trial_01": {}}


def test_log_history(spark, tmp_path):
    log = {"log_history": [{"epoch": 1.0, "loss": 2.0}, {"epoch": 1.0, "eval_loss": 1.5, "eval_Accuracy": 0.5}, {"epoch": 1.0, "loss": 4.0}]}
    (tmp_path / "s.json").write_text(json.dumps(log))
    rows = readers.read_log_history(spark, str(tmp_path / "s.json")).withColumn("run", F.lit(1))
    metrics = {"loss": F.col("loss"), "eval_loss": F.col("eval_loss"), "acc": F.col("eval_Accuracy")}
    assert tuple(H.epoch_means(rows, "run", "epoch", metrics).first()) == (1, 1.0, 3.0, 1.5, 0.5)


STAGE_2 = [
    # val_loss falls once and then stays: six epochs without a gain end the run
    0.60, 0.61, 0.62, 0.60, 0.63, 0.64, 0.65,
]


def test_early_stopping(spark):
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(STAGE_2)] + [(2, 1, 0.5), (2, 2, 0.4)], "run int, epoch int, val double")
    got = {r["run"]: (r["best"], r["stop_epoch"]) for r in H.early_stopping(df, "run", "epoch", "val", 6, 1e-4).collect()}
    assert got == {1: (0.60, 7), 2: (0.4, None)}
    best = {r["run"]: r["best_epoch"] for r in H.best_epoch(df, "run", "epoch", "val").collect()}
    assert best == {1: 1, 2: 2}


def test_store_keeps_latest(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = "model string, at int, acc double"
    writers.store_results(spark, root, spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6)], schema), "model", "at")
    out = writers.store_results(spark, root, spark.createDataFrame([("a", 2, 0.7)], schema), "model", "at")
    assert {r["model"]: r["acc"] for r in out.collect()} == {"a": 0.7, "b": 0.6}


def test_the_function_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def call(texts):
        with open(log, "a") as file:
            file.writelines("x\n" for _ in texts)
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string")
    out = L.enrich(df, "id", ["text"], call, "m")
    assert {r["id"]: r[-1] for r in out.collect()} == {i: f"TEXT {i}" for i in range(20)} and out.count() == out.count() == 20
    assert open(log).read().count("x") == 20
    long = L.compare_models(df, "id", "text", {"a": call, "b": call})
    assert long.count() == long.distinct().count() == 40 and open(log).read().count("x") == 60


def test_a_write_touches_its_buckets_only(spark, tmp_path):
    root, schema = str(tmp_path / "store"), "model string, at int, acc double"
    many = spark.createDataFrame([(f"m{i}", 1, float(i)) for i in range(500)] + [(None, 1, 0.5)], schema)
    assert writers.store_results(spark, root, many, "model", "at").count() == 501
    one = spark.createDataFrame([("m7", 2, -1.0), ("m7", 1, -9.0)], schema)
    out = writers.store_results(spark, root, one, "model", "at")
    assert len(list((tmp_path / "store" / "data" / "v2").glob("store_bucket=*"))) == 1
    assert {r["model"]: r["acc"] for r in out.collect()} == {f"m{i}": float(i) for i in range(500)} | {"m7": -1.0, None: 0.5}
    own = writers.read_results(spark, root, many.schema, one, "model")
    assert [tuple(r) for r in own.collect()] == [("m7", 2, -1.0)] and len(own.inputFiles()) == 1
    # a write that dies before its manifest leaves the last version
    broken = spark.createDataFrame([("m8", 3, 0.0)], schema)
    broken.write.mode("overwrite").parquet(f"{root}/data/v3/store_bucket=1")
    assert writers.read_results(spark, root, many.schema).count() == 501
    none = writers.store_results(spark, root, broken.limit(0), "model", "at")
    assert none.count() == 501 and writers.read_results(spark, str(tmp_path / "no"), many.schema).count() == 0


def test_stored_statistics_are_read_again(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "stats")
    assert readers.stored_or_computed(spark, path, compute).count() == 3
    assert readers.stored_or_computed(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_split_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", 10, 5, 6)], "row_id bigint, text string, prdtypecode int, imageid bigint, productid bigint")
    rows = C.with_paths(df, {"raw": "r/", "preprocessed": "p/", "grey": "g/"})
    writers.save_parts(rows, str(tmp_path), "train", ["text"])
    back = spark.read.option("header", True).csv(str(tmp_path / "images_train")).first()
    assert back["image_path_preprocessed"] == "p/10/image_5_product_6.jpg"
    writers.append_rows(df, str(tmp_path / "log"))
    writers.append_rows(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_columns(spark):
    df = spark.createDataFrame([(1, "A")], "id int, t string")
    with pytest.warns(UserWarning):
        assert C.on_columns(df, ["t", "u"], F.lower).first()["t"] == "a"
    with pytest.raises(ValueError):
        C.require_columns(df, ["u"], on_missing="error")
    assert C.output_column("text", "llama3.2:3b") == "text_llama3_2_3b"


def test_keep_first_with_one_hot_text(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}", i) for i in range(100, 0, -1)], "id int, t string, x int")
    got = C.keep_first(df, "t", "id").collect()
    assert len(got) == 51 and [r["x"] for r in got if r["t"] == "same"] == [1]


def test_chunks_and_batches(spark):
    df = spark.createDataFrame([(i * 3, "w " * (1 if i % 4 else 250)) for i in range(1003)], "id bigint, t string")
    chunked = L.with_chunks(df, "id", 250)
    sizes = [r["count"] for r in chunked.groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [251, 251, 251, 250]
    batched = L.with_batches(chunked, "id", "t")
    per = batched.groupBy("chunk", "length_class", "batch").count().groupBy("length_class").agg(F.max("count")).collect()
    assert dict(map(tuple, per)) == {"short": 5, "medium": 3}


def test_enrichment_retries_and_errors(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "gap"), (3, "boom"), (4, None)], "id bigint, t string")

    def call(texts):
        if "boom" in texts:
            raise RuntimeError("no")
        return {str(i + 1): t.upper() for i, t in enumerate(texts) if t and t != "gap"}

    rows = {r["id"]: r for r in L.enrich_rows(df, "id", "t", call).collect()}
    assert [rows[i]["status"] for i in (1, 2, 3, 4)] == ["ok", "missing", "error", "ok"]
    assert rows[3]["reply"] == "boom" and rows[4]["reply"] == "EMPTY"
    batched = L.with_batches(L.with_chunks(df.where("id <= 2"), "id"), "id", "t")
    got = {r["id"]: (r["reply"], r["status"], r["calls"]) for r in L.enrich_batches(batched, "id", "t", call).collect()}
    assert got == {1: ("OK", "ok", 3), 2: (None, "missing", 3)}
    wide = L.enrich(df.where("id < 3"), "id", ["t"], call, "m:1")
    assert set(wide.columns) == {"id", "t", "t_m_1"}
    with pytest.raises(ValueError):
        L.enrich(df, "id", ["t"], call, "m", kind="other")


def test_vocabulary_cap_and_padding(spark):
    df = spark.createDataFrame([(1, "b a a, c"), (2, ""), (3, "zzz a b c d e")], "id int, t string")
    vocab = V.vocabulary(df, "t", 4)
    assert {r["term"]: r["term_id"] for r in vocab.collect()} == {"a": 2, "b": 3}
    seq = {r["id"]: (r["ids"], r["mask"]) for r in V.encode_sequences(df, "id", "t", vocab, 5, 4).collect()}
    assert seq[1] == ([3, 2, 2, 1, 0], [1, 1, 1, 1, 0])
    assert seq[2] == ([0] * 5, [0] * 5)
    assert seq[3] == ([1, 2, 3, 1, 1], [1] * 5)


def test_spelling_equals_all_pairs(spark):
    words = ["chair"] * 30 + ["chairs"] * 25 + ["table"] * 22 + ["chaair", "tabel", "hair", "chait", "tables", "xyzzy", "chairss"]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    got = {r["term"]: r["fix"] for r in V.spelling_fixes(df, "t").collect()}
    assert got == {"chaair": "chair", "hair": "chair", "chait": "chair", "tables": "table", "chairss": "chairs"}


def test_reports(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1)]
    matrix = E.confusion(spark.createDataFrame(pairs, "t int, p int"), "t", "p")
    assert matrix.count() == 9
    report = {r["class"]: r for r in E.class_report(matrix).collect()}
    assert report[0]["precision"] == 1.0 and report[0]["recall"] == pytest.approx(5 / 7)
    assert report[2]["f1"] == 0.0 and report[2]["support"] == 1
    averages = E.report_averages(matrix).first()
    assert averages["accuracy"] == pytest.approx(8 / 11)
    assert averages["macro_recall"] == pytest.approx((5 / 7 + 1 + 0) / 3)
    assert [tuple(r) for r in E.confused_pairs(matrix).collect()] == [(0, 1, 2), (2, 1, 1)]


def test_verdicts(spark):
    df = spark.createDataFrame([(0.2, 0.7), (0.15, 0.58), (0.05, 0.1)], "gap double, acc double")
    got = [tuple(r) for r in df.select(E.gap_verdict("gap"), E.accuracy_verdict("acc")).collect()]
    assert got == [("significant", "excellent"), ("moderate", "good"), ("good", "baseline")]


def test_resume_point(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "b"), (3, "c", "z")], "id int, t string, r string")
    assert E.resume_point(df, "id", E.is_enriched("t", "r")).first()[0] == 1
    done = df.where("id <> 2")
    assert E.resume_point(done, "id", E.is_enriched("t", "r")).first()[0] == 2


def test_stream_takes_only_new_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id int, t string"

    def upper(df):
        return df.withColumn("t", F.upper("t"))

    spark.createDataFrame([(1, "a")], schema).write.mode("append").parquet(source)
    assert incremental.process_new_files(spark, source, "*.parquet", schema, upper, target, state).count() == 1
    spark.createDataFrame([(2, "b")], schema).write.mode("append").parquet(source)
    out = incremental.process_new_files(spark, source, "*.parquet", schema, upper, target, state)
    assert sorted(map(tuple, out.collect())) == [(1, "A"), (2, "B")]


def test_classifiers_learn(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    rows = [(i, i % 3, (rnd.normal(size=6) + np.eye(6)[i % 3] * 4).tolist(), ["red ring", "blue bolt", "hot gear"][i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, c int, v array<double>, t string")
    fused = P.train_late_fusion(df, "t", "v", "c", text_size=16, hidden=(8,), iterations=40)
    outs = {
        "text": P.classify_texts(P.train_text_classifier(df, "t", "c"), df, "id", "t"),
        "vector": P.classify_vectors(P.train_vector_classifier(df, "v", "c"), df, "id", "v"),
        "fused": P.classify_fused(fused, df, "id", "t", "v"),
    }
    for name, out in outs.items():
        right = out.join(df, "id").agg(F.avg((F.col("c") == F.col("predicted")).cast("int"))).first()[0]
        assert right > 0.9, name
    _, trials = P.grid_search(df, "v", "c", [0.0, 0.1], [0.0], iterations=5)
    assert trials.count() == 2 and trials.agg(F.max("val_accuracy")).first()[0] > 0.8


@pytest.mark.parametrize("answers", [["a"], ["a", "b", "c"], []])
def test_replies_of_another_number_are_a_mismatch(answers):
    replies, asked, error = L._replies(lambda texts: answers, ["x", "y"], 2)
    assert replies == [None, None] and asked == 3 and L._status(None, error) == "mismatch"
    assert f"{len(answers)} replies to 2 texts" in error


@pytest.mark.parametrize("method", ["none", "undersample", "oversample"])
def test_a_users_function_is_called_once_for_each_batch(spark, tmp_path, method):
    rows = spark.createDataFrame(
        [(i, "a" if i % 4 else "b", f"title {i}", None) for i in range(200)], "id bigint, label string, title string, description string"
    )
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(texts):
        (calls / uuid.uuid4().hex).write_text(str(len(texts)))
        return [t.upper() for t in texts]

    with pytest.raises(ValueError, match="store"):
        prepare(rows, "id", "label", "title", "description", Settings(enrichment=call, balance=method))
    settings = Settings(enrichment=call, balance=method, store=str(tmp_path / "store"), shorten=False)
    for _ in range(2):  # a second run has nothing left to ask
        out = prepare(rows, "id", "label", "title", "description", settings)
        got = out.collect()
        assert out.count() == {"none": 200, "undersample": 100, "oversample": 300}[method]
        assert all(r["text_model"] == r["text"].upper() for r in got)
        asked = sum(int(f.read_text()) for f in calls.iterdir())
        assert asked == (100 if method == "undersample" else 200)


def test_logs_and_histories_are_bounded(spark, tmp_path, monkeypatch):
    from shelfwork.plans import file_queries

    monkeypatch.setattr(file_queries, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    n, block = 150_000, 1 << 16  # all of one user and one type
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit(8).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") / 2).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    logs = file_queries.log_history(spark, str(tmp_path))
    assert logs.count() == n and logs.agg(F.countDistinct("epoch")).first()[0] == n
    sizes = spark.read.json(f"{tmp_path}/logs").select(F.size("log_history").alias("n")).collect()
    assert len(sizes) == 3 and max(r["n"] for r in sizes) == block
    assert [tuple(r) for r in file_queries.trial_overview(spark, str(tmp_path)).collect()] == [("view", (n - 1) / 2, n, "units=4")]
    assert spark.read.text(f"{tmp_path}/trials/histories").agg(F.max(F.length("value"))).first()[0] < 100
