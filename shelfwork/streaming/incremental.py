"""Incremental runs: new files only, restart from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder

JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def stream_files(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """A stream over the Parquet tables of a folder whose names match the pattern: files, and folders with part files."""
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{{{pattern}}}")  # braces: a pattern, even without a star


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is new since the last run, then stop.

    The checkpoint remembers finished files; a run that dies is repeated from
    the last finished batch, and the file sink drops its partial output.
    """
    writer = stream.writeStream.format("parquet").outputMode(mode)
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    running.awaitTermination()


def process_new_files(
    spark: SparkSession, folder: str, pattern: str, schema, clean: Callable[[DataFrame], DataFrame],
    target: str | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Clean the new files of a folder and return the table written so far."""
    target = target or shared_folder(spark, "stream-out")
    checkpoint = checkpoint or shared_folder(spark, "stream-state")
    cleaned = clean(stream_files(spark, folder, pattern, schema))
    run_available(cleaned, target, checkpoint)
    return spark.read.schema(cleaned.schema).parquet(target)


def drop_repeats_on_arrival(stream: DataFrame, event_time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Keep the first row per key; keys are forgotten once they are older than the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


#: Groups of keys that share a state, the same for every run of a checkpoint; rows of one that are reduced at once; the time of a key that is done.
BUCKETS, HELD_ROWS, DONE = 2048, 100_000, -(1 << 63)


def first_rows(rows: pa.Table) -> pa.Table:
    """The first row of each ``_key`` by ``_time`` and ``_tie``."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("_key", "_time", "_tie")])).combine_chunks()
    key = rows["_key"]
    return rows.filter(pa.chunked_array([[True], *pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).chunks], pa.bool_())) if len(key) else rows


def packed(rows: pa.Table) -> bytes:
    """A table as bytes, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def first_arrivals(stream: DataFrame, event_time: str, keys: Sequence[str], tie: str, delay: str) -> DataFrame:
    """The earliest row of each key, once, when the watermark has passed it; of equal times the one with the smallest ``tie``.

    A row may come up to ``delay`` after later ones and still be the earliest; what
    comes later than that is dropped. Keys are dealt to BUCKETS groups, and a task goes through the
    rows of a group at once, as a table: the state of a group holds each key's earliest row so far, with a
    timer at the first of their times; after a row is out, only a mark that its key is done. Both
    survive a restart. Rows without time are left out; rows without a key only
    move the watermark, so a last row with a late time and no key lets all others go.
    """
    names = stream.columns
    rows = stream.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    # one condition with the time in it is not moved below the watermark, which rows without a key must reach
    known = F.array_compact(F.array(*[F.col(c).cast("string") for c in (event_time, *keys)]))
    same = [(F.col(c) + F.lit(0).cast(kind)).alias(c) if (kind := dict(stream.dtypes)[c]) in ("float", "double") else F.col(c) for c in keys]  # -0.0 is 0.0
    rows = rows.where(F.size(known) == 1 + len(keys)).withColumns(
        {"_key": F.to_json(F.struct(*same), JSON_TIME), "_time": F.unix_micros(event_time), "_tie": F.col(tie), "_row": F.to_json(F.struct(*names), JSON_TIME)}
    )
    # the event time stays for the watermark; the others travel in the row
    rows = rows.select(F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int").alias("_bucket"), event_time, "_key", "_time", "_tie", "_row")
    held = pa.schema([("_key", pa.string()), ("_time", pa.int64()), ("_tie", to_arrow_type(rows.schema["_tie"].dataType)), ("_row", pa.string())])

    def earliest(_bucket, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        tables = [pa.ipc.open_stream(bytes(state.get[0])).read_all()] if state.exists else []
        if not state.hasTimedOut:
            for part in parts:
                tables.append(pa.Table.from_pandas(part[held.names], held, preserve_index=False))
                if sum(map(len, tables[1:])) > max(HELD_ROWS, len(tables[0])):
                    tables = [first_rows(pa.concat_tables(tables))]
        best = first_rows(pa.concat_tables(tables))
        times = best["_time"].to_numpy()
        due = (times != DONE) & (times // 1000 + 1 < now)
        out = best.filter(pa.array(due))["_row"].to_pylist()
        if out:
            nothing = pa.scalar(None, pa.string())
            marks = [best["_key"], pc.if_else(due, DONE, best["_time"]), pc.if_else(due, pa.scalar(None, held.field("_tie").type), best["_tie"]), pc.if_else(due, nothing, best["_row"])]
            best = pa.Table.from_arrays(marks, schema=held)
        state.update((packed(best),))
        waiting = times[(times != DONE) & ~due]
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting.min()) // 1000 + 1, 1))
        if out:
            yield pd.DataFrame({"_row": out})

    kept = rows.groupBy("_bucket").applyInPandasWithState(earliest, "_row string", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return kept.select(F.from_json("_row", schema, JSON_TIME).alias("_row")).select("_row.*")
