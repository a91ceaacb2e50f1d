"""What several operators share: tables, stored tables, a bounded broadcast, words in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import TEXT_ROWS, small_text_batches  # noqa: F401
from ..session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A side of at most so many rows and so many bytes in its files is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes of text in a sample that a model is fitted on.
SAMPLE_BYTES = 256 << 20
#: Parts of a hot key's rows in a join with what is not broadcast.
SALTS = 32
#: Bytes of text that numpy works on at once.
CHUNK = 1 << 18
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIME = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
INVERSE = pow(PRIME, -1, 1 << 64)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``; ``sql`` states the same result."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: its lineage ends here."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a stored ``df`` has few rows and few bytes in its files."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return planned <= size and df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A stored ``df`` with a broadcast hint if its files and its rows are few, else as it is."""
    return F.broadcast(df) if fits(df, rows, size) else df


def salted_join(rows: DataFrame, side: DataFrame, on: list[str], spread, salts: int = SALTS, how: str = "left") -> DataFrame:
    """``rows`` joined to a stored ``side``: broadcast if it is small, else each key of it meets ``salts`` parts of its rows.

    ``spread`` is a column that differs among the rows of a hot key.
    """
    if fits(side):
        return rows.join(F.broadcast(side), on, how)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    return salted.join(side.withColumn("_salt", parts), [*on, "_salt"], how).drop("_salt")


def hash_sample(
    df: DataFrame, on: str | list[str], rows: int, salt: str = "sample", size: str | None = None, most: int = SAMPLE_BYTES
) -> DataFrame:
    """All of ``df`` if it has at most ``rows`` rows and ``most`` bytes, else those with the lowest hashes of ``on``.

    ``on`` tells all rows of ``df`` apart (group them first), so that no value holds
    more of the sample than one row; then their number stays four standard
    deviations below ``rows``. The column ``size`` has each row's bytes. No task or
    driver ranks them.
    """
    on = [on] if isinstance(on, str) else on
    n, total = df.agg(F.count("*"), F.sum(F.col(size) if size else F.lit(0))).first()
    share = min(1.0 if n <= rows else max(rows - 4 * rows**0.5, rows / 2) / n, 1.0 if not total or total <= most else most / total)
    return df if share == 1 else df.filter(F.pmod(F.xxhash64(F.lit(salt), *on), F.lit(1 << 31)) < int(share * (1 << 31)))


def text_sample(df: DataFrame, text: str, rows: int, also: tuple[str, ...] = (), most: int = SAMPLE_BYTES) -> DataFrame:
    """Of the different ``text``s (and values ``also``) of ``df`` at most ``rows`` and about ``most`` bytes, a row each, with its md5 ``digest``.

    Copies count once, whatever their keys; rows with nulls in these columns are left out.
    """
    on = ["digest", *also]
    of = df.withColumn("digest", text_digest(text)).dropna(subset=on)
    pool = of.groupBy(*on).agg(F.max(F.octet_length(text)).alias("size"))
    taken = hash_sample(pool, on, rows, "sample", "size", most).select(*on)  # bounded, so that the join below may broadcast it
    return of.join(F.broadcast(taken), on).dropDuplicates(on)


def ascii_lower(text):
    """A-Z in lower case, other letters as they are; the quick way where a text is all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def in_text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python in batches of TEXT_ROWS rows at most."""
    small_text_batches(df.sparkSession)
    return df


def text_digest(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def bucket(key, modulus: int):
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of a string column, their bytes and offsets: about ``most`` bytes, one text at least."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1), i + 16_384)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and its inverse for i below ``n``."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((PRIME, INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; no run crosses a text's bounds ``at``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = at[1:] - 1
    after[ends[ends >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    return _lower[data]


def blank_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    return runs(~_blank[data], at)


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each span lies in."""
    return np.searchsorted(at, starts, "right") - 1
