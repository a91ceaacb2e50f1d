import base64
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from shelfwork.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first int"


def rows_of(frame, rows):
    return frame(SCHEMA, [(*r, "x", 1) for r in rows])


PAGES = [
    (5, "http://a.example/é b\r\nX: y", "<p>hello</p>"), (2, None, "<p>hello</p>"), (7, "http://c", "<p>hello</p>"), (3, "http://d", None), (4, "", ""),
    (9, "http://e", "ü" * 70_000), (None, "http://f", "<p>hello</p>"), (None, "http://g", "alone"), (2, None, "<p>hello</p>"), (11, "http://h", "WARC/1.1\r\n\r\n"),
]


def wanted(pages):
    first = {}
    for key, _, html in pages:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    out = []
    for key, _, html in pages:
        data = (html or "").encode()
        head = first.get(html or "")
        revisit = head is not None and key != head
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((None if key is None else str(key), len(data), digest, "revisit" if revisit else "response", str(head) if revisit else None, None, None if revisit else data))
    return sorted(out, key=str)


def read(spark, folder, archives):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem", "payload"]
    rows = warc.read_archives(archives, folder, payload=True).select(cols).collect()
    return sorted([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows], key=str)


@pytest.mark.parametrize("dictionary", [None, b"", b"<p>hello</p><html><body>" * 9])
def test_round_trip(spark, frame, tmp_path, dictionary):
    archives = warc.write_archives(rows_of(frame, PAGES), str(tmp_path), dictionary=dictionary)
    assert read(spark, str(tmp_path), archives) == wanted(PAGES)
    urls = {r["page_id"]: r["url"] for r in warc.read_archives(archives, str(tmp_path)).collect()}
    assert urls["5"] == "http://a.example/%C3%A9%20b%0D%0AX:%20y" and urls["2"] == "about:blank"


def test_salted_join_gives_the_same(spark, frame):
    pages = rows_of(frame, PAGES).select(F.col("page_id").alias("key"), F.col("html").alias("text"))
    a, b = (sorted(map(str, warc.with_first(pages, "key", "text", n).select("key", "first").collect())) for n in (10**6, 0))
    assert a == b


def test_small_archives_and_a_trained_dictionary(spark, frame, tmp_path, monkeypatch):
    pages = [(i, f"http://x/{i}", f"<html><body><h1>Title {i % 40}</h1>" + "".join(f"<p>line {j} of {i % 40}</p>" for j in range(60)) + "</body></html>") for i in range(300)]
    dictionary = warc.trained_dictionary(rows_of(frame, pages))
    assert dictionary
    archives = warc.write_archives(rows_of(frame, pages).coalesce(1), str(tmp_path))
    assert read(spark, str(tmp_path), archives) == wanted(pages)
    path = next(tmp_path.glob("*.zst"))
    reader = warc.Reader(io.BytesIO(path.read_bytes()))
    assert reader.dictionary() == dictionary and len(list(reader.frames())) == archives.first()["records"]


def test_leftovers_of_lost_tasks_are_not_read(spark, frame, tmp_path):
    archives = warc.write_archives(rows_of(frame, PAGES), str(tmp_path))
    (tmp_path / "part-000000-0000-lost.warc.zst").write_bytes(b"half an archive")
    assert read(spark, str(tmp_path), archives) == wanted(PAGES)


def test_damage_is_told(frame, tmp_path):
    whole = warc.record(1, "http://a", b"payload", None)
    assert warc.parsed(whole)["problem"] is None
    assert warc.parsed(whole.replace(b"payload", b"paXload"))["problem"] == "digest"
    assert warc.parsed(whole.replace(b"payload", b"payloads"))["problem"] == "length"
    assert warc.parsed(whole.replace(b"WARC-Type: response", b"WARC-Type: other"))["problem"] == "header"
    assert warc.parsed(b"")["problem"] == "header"
    frame_ = zstandard.ZstdCompressor(write_checksum=True).compress(whole)
    with pytest.raises(warc.Truncated):
        list(warc.Reader(io.BytesIO(frame_ + frame_[:-9])).frames())
    with pytest.raises(ValueError, match="no Zstandard frame"):
        list(warc.Reader(io.BytesIO(frame_ + b"rubbish")).frames())


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 500_000, bytes(range(256)) * 900])
@pytest.mark.parametrize("size", [True, False])
def test_frames_are_found_by_their_blocks(data, size):
    press = zstandard.ZstdCompressor(write_content_size=size, write_checksum=size)
    frames = [press.compress(data), press.compress(b"next"), press.compress(data)]
    assert list(warc.Reader(io.BytesIO(b"".join(frames))).frames()) == frames


def test_empty_table(spark, frame, tmp_path):
    archives = warc.write_archives(rows_of(frame, []), str(tmp_path))
    assert archives.collect() == [] and read(spark, str(tmp_path), archives) == []
