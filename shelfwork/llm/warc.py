"""WARC archives in Zstandard: written from a table, read back record by record.

An archive is a skippable frame that holds a dictionary, then one frame for each
record. Equal payloads are stored once: the row with the smallest key is a
response, the others are revisits that refer to it. Tasks write archives to a
folder that all executors share and return a list of them; reading starts from
that list, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import BROADCAST_ROWS, in_text_batches, query, small, stored, table, text_sample

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of an archive after which the next one begins, and read at once.
ARCHIVE, READ = 64 << 20, 1 << 20
#: The dictionary, and the pages it is trained on: so many at most, none longer than this.
DICTIONARY, SAMPLE_ROWS, SAMPLE_CHARS = 16 << 10, 256, 64 << 10
SALTS, LEVEL = 16, 3
#: Tasks that read archives, at most.
READERS = 20_000
KEY = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def trained_dictionary(pages: DataFrame, text: str = "html", rows: int = SAMPLE_ROWS) -> bytes:
    """A dictionary from at most ``rows`` different pages, those with the lowest hashes; empty if they are too few."""
    known = pages.select(F.col(text).alias("text")).filter(F.length("text").between(1, SAMPLE_CHARS))
    sample = [r["text"].encode() for r in text_sample(known, "text", rows).orderBy("digest").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, sample, level=LEVEL).as_bytes() if len(sample) > 8 else b""
    except zstandard.ZstdError:  # too little text to train on
        return b""


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: list[tuple[str, object]], first: str) -> bytes:
    return "".join([first, "\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode()


def record(key, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record: a response, or a revisit if ``refers_to`` is a key."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{KEY}{'' if key is None else key}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", urllib.parse.quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~")),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if revisit:
        fields[5:5] = [("WARC-Refers-To", f"<{KEY}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return _head(fields, "WARC/1.1") + block + b"\r\n\r\n"


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


def with_first(pages: DataFrame, key: str, text: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` with ``first``: the smallest key of equal payloads where there are several rows of them."""
    rows = pages.withColumn("payload", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    groups = rows.groupBy("payload").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = stored(groups, "payloads")
    few = small(groups, broadcast_rows)
    if few is not groups:
        return rows.join(few, "payload", "left")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(spread, ["payload", "salt"], "left")


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", text: str = "html", dictionary: bytes | None = None
) -> DataFrame:
    """Write every row as a record to archives in ``folder``; returns (archive, records), stored.

    Null text is an empty payload, null url ``about:blank``; what a header
    cannot hold is percent-encoded. A null key is written as an empty one. Rows with
    the smallest key of equal payloads are responses, repeated ones too; a group
    whose keys are all null has responses only. An empty table writes no archive.
    """
    dictionary = trained_dictionary(pages, text) if dictionary is None else dictionary
    rows = with_first(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(text).alias("text")), "key", "text")
    rows = rows.select("key", "url", "text", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True, write_content_size=True).compress
        system, place = _opened(folder)
        system.create_dir(place, recursive=True)
        start = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        number, frames, size = 0, [], 0

        def close() -> pa.RecordBatch:
            # no other attempt of this task writes a file of this name
            name = f"part-{TaskContext.get().partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{place}/{name}", compression=None) as out:
                out.write(start)
                for f in frames:
                    out.write(f)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(frames)], pa.int64())})

        for batch in batches:
            for k, u, t, r in zip(*[batch.column(i) for i in range(4)], strict=True):
                frames.append(press(record(k.as_py(), u.as_py(), (t.as_py() or "").encode(), r.as_py())))
                size += len(frames[-1])
                if size >= ARCHIVE:
                    yield close()
                    number, frames, size = number + 1, [], 0
        if frames:
            yield close()

    return stored(in_text_batches(rows).mapInArrow(run, "archive string, records long"), "archives")


class Truncated(ValueError):
    pass


class Reader:
    """The frames of an archive, read piece by piece."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0

    def need(self, n: int) -> bool:
        """Have ``n`` bytes from here on in hand, unless the file ends before."""
        while len(self.held) - self.at < n:
            more = self.file.read(max(READ, n - len(self.held) + self.at))
            if not more:
                return False
            self.held, self.at = self.held[self.at :] + more, 0
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise Truncated("the archive ends inside a frame")
        self.at += n
        return self.held[self.at - n : self.at]

    def number(self, offset: int, size: int) -> int:
        if not self.need(offset + size):
            raise Truncated("the archive ends inside a frame")
        return int.from_bytes(self.held[self.at + offset : self.at + offset + size], "little")

    def dictionary(self) -> bytes:
        """What the leading skippable frame holds; no such frame, no dictionary."""
        if self.need(8) and self.number(0, 4) == SKIPPABLE:
            size = self.number(4, 4)
            self.take(8)
            return self.take(size)
        return b""

    def frames(self) -> Iterator[bytes]:
        """Frame by frame, found by the sizes in their block headers."""
        while self.need(1):
            if self.number(0, 4) != FRAME:
                raise ValueError("no Zstandard frame where one should start")
            flags = self.number(4, 1)
            single = flags >> 5 & 1
            at = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = False
            while not last:
                block = self.number(at, 3)
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                if kind == 3:
                    raise ValueError("a reserved kind of block")
                at += 3 + (1 if kind == 1 else size)
            yield self.take(at + 4 * (flags >> 2 & 1))


def parsed(data: bytes) -> dict:
    """The parts of a record; ``problem`` says what is wrong with it, if anything."""
    out = dict.fromkeys(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem"))
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(x.partition(": ")[::2] for x in lines[1:])
    if not found or not lines[0].startswith("WARC/"):
        return out | {"problem": "header"}
    id_of = lambda x: None if x is None else x.removeprefix(f"<{KEY}").removesuffix(">") or None
    out |= {
        "record_type": fields.get("WARC-Type"), "page_id": id_of(fields.get("WARC-Record-ID")), "url": fields.get("WARC-Target-URI"),
        "refers_to": id_of(fields.get("WARC-Refers-To")), "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
    }
    if out["record_type"] not in ("response", "revisit") or "WARC-Date" not in fields or "WARC-Record-ID" not in fields:
        return out | {"problem": "header"}
    size = fields.get("Content-Length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "length"}
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    told = dict(x.partition(": ")[::2] for x in http.decode("utf-8", "replace").split("\r\n")[1:]).get("Content-Length", "")
    if not told.isdigit():
        return out | {"problem": "header"}
    out["payload_bytes"] = int(told)
    if out["record_type"] == "response":
        out["payload"] = payload
        if len(payload) != int(told):
            return out | {"problem": "length"}
        if sha1(payload) != out["payload_digest"]:
            return out | {"problem": "digest"}
    return out


FIELDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """One row per record of the listed archives: its fields, ``problem``, and the payload if asked for.

    A list without rows gives no records. An archive that breaks off, or has fewer
    or more records than listed, fails; a record whose header, length or digest is
    wrong is returned with its ``problem``. Archives are read in pieces; one record
    at a time is in memory.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["problem"] + ["payload"] * payload
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _opened(folder)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = 0
                with system.open_input_stream(f"{place}/{name}", compression=None) as file:
                    reader = Reader(file)
                    dictionary = reader.dictionary()
                    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
                    press, rows, size = zstandard.ZstdDecompressor(dict_data=own), [], 0
                    for frame in reader.frames():
                        data = press.decompress(frame)
                        rows.append(parsed(data))
                        seen, size = seen + 1, size + len(data) * payload
                        if len(rows) >= 4096 or size >= READ:
                            yield _batch(rows, names, kinds)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names, kinds)
                if count is not None and seen != count:
                    raise ValueError(f"{name} has {seen} records, not {count}")

    tasks = min(max(archives.count(), 1), READERS)  # stated, or else the short list would end in one task
    return archives.select("archive", "records").repartition(tasks).mapInArrow(
        run, FIELDS + ", problem string" + (", payload binary" if payload else "")
    )


def _batch(rows: list[dict], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names)


@query("op7_warc")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back."""
    place = shared_folder(spark, "warc")
    records = read_archives(write_archives(table(spark, folder, "pages"), place), place)
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), "problem",
    )
