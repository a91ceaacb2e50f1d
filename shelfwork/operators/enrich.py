"""Batched enrichment of texts with a user's function.

The function gets a list of texts and returns a list (or a map from 1-based
number) of replies. It runs on executors; a lost task repeats its calls, so it
must give the same reply for the same text. Results are written before use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as T
from ..scale import by_own_key, kept, small_text_batches, with_position
from .columns import output_column

KINDS = ("batch", "row")


def balanced_chunk(position: Column, rows: Column, chunks: Column) -> Column:
    """Chunk of a position when ``rows`` rows are cut into even chunks, the first ones one longer."""
    size, longer = F.floor(rows / chunks), rows % chunks
    head = longer * (size + 1)
    in_tail = longer + F.floor((position - head) / F.greatest(size, F.lit(1)))
    return F.when(position < head, F.floor(position / (size + 1))).otherwise(in_tail).cast("bigint")


def with_chunks(df: DataFrame, key: str, chunk_rows: int = 250) -> DataFrame:
    """Cut the table, in key order, into max(1, n // chunk_rows) even chunks."""
    rows = df.agg(F.count("*")).scalar()
    chunks = F.greatest(F.lit(1).cast("bigint"), F.floor(rows / F.lit(chunk_rows)))
    placed = with_position(df, key, "_pos")
    return placed.withColumn("chunk", balanced_chunk(F.col("_pos"), rows, chunks)).drop("_pos")


def fixed_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Batch number of every row, in key order: 0 for the first ``size`` rows, and so on."""
    return with_position(df, key, "_pos").withColumn("batch", F.floor(F.col("_pos") / size)).drop("_pos")


def length_class(text: str) -> tuple[Column, Column]:
    """Name and batch size of the length class of a text."""
    words = T.word_count_white(text)
    name = size = None
    for label, below, batch in fixed.LENGTH_CLASSES:
        if below is None:
            return name.otherwise(label), size.otherwise(batch)
        name = F.when(words < below, label) if name is None else name.when(words < below, label)
        size = F.when(words < below, batch) if size is None else size.when(words < below, batch)
    raise ValueError("the last length class must be open")


def with_batches(df: DataFrame, key: str, text: str) -> DataFrame:
    """Even batches inside every chunk and length class, and the number of a row in its batch.

    Keys and lengths are numbered; the texts meet their numbers by key.
    """
    name, size = length_class(text)
    sized = df.select(key, "chunk", name.alias("length_class"), size.alias("batch_size"))
    group = W.partitionBy("chunk", "length_class")  # a chunk has at most two chunk sizes of rows
    place = F.row_number().over(group.orderBy(key)) - 1
    rows = F.count("*").over(group)
    placed = sized.withColumns({"_place": place, "_rows": rows})
    batches = F.ceil(F.col("_rows") / F.col("batch_size"))
    batched = placed.withColumn("batch", balanced_chunk(F.col("_place"), F.col("_rows"), batches))
    number = F.row_number().over(W.partitionBy("chunk", "length_class", "batch").orderBy(key))
    return by_own_key(df, batched.withColumn("number", number).drop("_place", "_rows", "batch_size", "chunk"), key)


def batch_prompts(batched: DataFrame, text: str) -> DataFrame:
    """The numbered text of every batch."""
    pairs = F.collect_list(F.struct("number", F.col(text).alias("line")))
    return batched.groupBy("chunk", "length_class", "batch").agg(
        F.count("*").cast("int").alias("rows"), T.numbered_batch(pairs).alias("prompt")
    )


MISMATCH = "mismatch"


def _status(reply, error: str | None) -> str:
    if error:
        return MISMATCH if error.startswith(f"{MISMATCH}:") else "error"
    return "missing" if reply is None else "ok"


def _replies(call, texts: list, retries: int):
    """Ask until every text has a reply, at most ``retries`` times more."""
    replies, error = [None] * len(texts), None
    asked = 0
    while asked <= retries:
        asked += 1
        try:
            answer = call(list(texts))
            if isinstance(answer, dict):
                answer = [answer.get(str(i + 1)) for i in range(len(texts))]
            answer = list(answer)
        except Exception as problem:  # noqa: BLE001 - the user's function may raise anything
            error = f"{type(problem).__name__}: {problem}"
            break
        if len(answer) != len(texts):  # which reply belongs to which text is not known
            replies, error = [None] * len(texts), f"{MISMATCH}: {len(answer)} replies to {len(texts)} texts"
            continue
        replies, error = answer, None
        if all(r is not None for r in replies):
            break
    return replies, asked, error


def enrich_batches(
    batched: DataFrame, key: str, text: str, call: Callable, retries: int = 2, on_error: str = "null"
) -> DataFrame:
    """Run the function once per batch. One row per text: reply, status, calls, error.

    A batch travels as one row (a few texts), so Arrow carries many batches at a
    time, up to a fixed number, and no batch is split. With ``on_error='input'`` a failed text is its
    own reply.
    """
    if on_error not in ("null", "input"):
        raise ValueError("on_error is 'null' or 'input'")
    small_text_batches(batched.sparkSession)
    kind = dict(batched.dtypes)[key]
    grouped = batched.groupBy("chunk", "length_class", "batch").agg(
        F.sort_array(F.collect_list(F.struct("number", key, F.col(text).alias("t")))).alias("rows")
    )
    flat = grouped.select(F.col(f"rows.{key}").alias("keys"), F.col("rows.t").alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for keys, texts in zip(frame["keys"], frame["texts"], strict=True):
                replies, asked, error = _replies(call, list(texts), retries)
                for k, t, r in zip(keys, texts, replies, strict=True):
                    status = _status(r, error)
                    if error:
                        r = t if on_error == "input" else None
                    out.append((k, r, status, asked, error))
            yield pd.DataFrame(out, columns=[key, "reply", "status", "calls", "error"])

    return flat.mapInPandas(run, f"{key} {kind}, reply string, status string, calls int, error string")


def enrich_rows(df: DataFrame, key: str, text: str, call: Callable, on_error: str = "input") -> DataFrame:
    """Row by row: null and empty texts become ``Empty`` before the call."""
    small_text_batches(df.sparkSession)
    single = df.select(
        key, T.fill_empty(text).alias(text), F.col(key).cast("bigint").alias("chunk"),
        F.lit("row").alias("length_class"), F.lit(0).alias("batch"), F.lit(1).alias("number"),
    )
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text], strict=True):
                replies, asked, error = _replies(call, [t], 0)
                status = _status(replies[0], error)
                reply = (t if on_error == "input" else None) if error else replies[0]
                out.append((k, reply, status, asked, error))
            yield pd.DataFrame(out, columns=[key, "reply", "status", "calls", "error"])

    schema = f"{key} {kind}, reply string, status string, calls int, error string"
    return single.select(key, text).mapInPandas(run, schema)


def enrich(
    df: DataFrame, key: str, columns: Sequence[str], call: Callable, model: str,
    kind: str = "batch", chunk_rows: int = 250, retries: int = 2, on_error: str = "null",
) -> DataFrame:
    """Enrich several columns; every column gets a reply column named after the model.

    The replies are written to the shared folder before anyone reads them, so that
    the function is asked once, however often the result is used.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    out = df
    for c in columns:
        if kind == "batch":
            batched = with_batches(with_chunks(df.select(key, c), key, chunk_rows), key, c)
            replies = enrich_batches(batched, key, c, call, retries, on_error)
        else:
            replies = enrich_rows(df, key, c, call, on_error)
        replies = kept(replies.select(key, F.col("reply").alias(output_column(c, model))), "replies")
        out = out.join(replies, key, "left")
    return out


def enrich_resumable(
    df: DataFrame, key: str, text: str, call: Callable, store: str, chunk_rows: int = 250, retries: int = 2
) -> DataFrame:
    """Enrich the rows the store has no good reply for, append the replies, return the store.

    The replies are on disk before anyone reads them. A run that dies leaves only
    whole appends behind; the next run continues with the rows that are missing.
    """
    spark = df.sparkSession
    done = _stored(spark, store)
    open_rows = df.select(key, text)
    if done is not None:
        open_rows = open_rows.join(done.where("status = 'ok'").select(key), key, "left_anti")
    batched = with_batches(with_chunks(open_rows, key, chunk_rows), key, text)
    enrich_batches(batched, key, text, call, retries).write.mode("append").parquet(store)
    rows = _stored(spark, store)
    best = F.min(F.struct((F.col("status") != "ok").alias("bad"), "reply", "status", "calls", "error")).alias("b")
    return rows.groupBy(key).agg(best).select(key, "b.reply", "b.status", "b.calls", "b.error")


def _stored(spark, path: str) -> DataFrame | None:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return None
    return spark.read.parquet(path)


def compare_models(df: DataFrame, key: str, text: str, calls: dict[str, Callable], chunk_rows: int = 250) -> DataFrame:
    """Several functions side by side: long form ``(key, model, reply, status)``, written before it is read, each function asked once."""
    batched = with_batches(with_chunks(df.select(key, text), key, chunk_rows), key, text)
    long = None
    for model, call in calls.items():
        one = enrich_batches(batched, key, text, call).withColumn("model", F.lit(model))
        one = kept(one.select(key, "model", "reply", "status"), "replies")
        long = one if long is None else long.unionByName(one)
    return long


def side_by_side(long: DataFrame, key: str, text: str, models: Sequence[str]) -> DataFrame:
    """One reply column per model."""
    wide = long.groupBy(key).pivot("model", list(models)).agg(F.first("reply"))
    return wide.select(key, *[F.col(f"`{m}`").alias(output_column(text, m)) for m in models])


def quarantine(replies: DataFrame, key: str) -> DataFrame:
    """Failed and missing replies, for the error table."""
    return replies.where("status <> 'ok'").select(key, "status", "calls", "error")
