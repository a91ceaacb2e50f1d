import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwork.streaming import incremental

SCHEMA = "id long, who string, at timestamp, note string"
START = dt.datetime(2024, 1, 1)


def minute(m, us=0):
    return START + dt.timedelta(minutes=m, microseconds=us)


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    clean = lambda stream: incremental.first_arrivals(stream, "at", ["who"], "id", "10 minutes")
    schema = spark.createDataFrame([], SCHEMA).schema
    out = incremental.process_new_files(spark, f"{folder}/in", "*.parquet", schema, clean, f"{folder}/out", f"{folder}/state")
    return sorted((r["who"], r["id"], r["us"], r["note"]) for r in out.select("who", "id", F.unix_micros("at").alias("us"), "note").collect())


@pytest.fixture
def us():
    return lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6 + t.microsecond


def test_the_earliest_row_survives_restarts(spark, tmp_path, us):
    first = [(5, "a", minute(3, 7), "x"), (4, "a", minute(3, 7), 'tie "wins"'), (9, "a", minute(2, 8), "earliest so far"), (1, "b", minute(30), None), (2, None, minute(5), "no key"), (3, "c", None, "no time")]
    # the watermark of the first delivery is at minute 20: a is out, b waits
    assert deliver(spark, tmp_path, first) == [("a", 9, us(minute(2, 8)), "earliest so far")]
    # late by less than the delay: the new first row of b; by more: dropped, a new key too; a again: done
    second = [(7, "b", minute(25), "earlier"), (8, "a", minute(26), "again"), (6, "a", minute(1), "too late"), (10, "d", minute(12), "too late")]
    assert len(deliver(spark, tmp_path, second)) == 1
    third = [(11, None, minute(10_000), "clock"), (12, "e", minute(31), "e")]
    assert deliver(spark, tmp_path, third) == [("a", 9, us(minute(2, 8)), "earliest so far"), ("b", 7, us(minute(25)), "earlier"), ("e", 12, us(minute(31)), "e")]


def test_tables_of_part_files_and_none(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a", START, None) for i in range(20)], SCHEMA)
    rows.repartition(4).write.parquet(f"{tmp_path}/in/notes.parquet")
    rows.write.parquet(f"{tmp_path}/in/others.parquet")

    def run(folder, out):
        return incremental.process_new_files(spark, f"{tmp_path}/{folder}", "notes.parquet", rows.schema, lambda s: s.select("id"), f"{tmp_path}/{out}", f"{tmp_path}/{out}-state")

    assert sorted(r["id"] for r in run("in", "out").collect()) == list(range(20))
    rows.where("id < 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/notes.parquet")
    assert run("in", "out").count() == 23  # the new part file only
    part = next((tmp_path / "in" / "others.parquet").glob("*.parquet"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "notes.parquet").write_bytes(part.read_bytes())
    assert run("one", "single").count() > 0
    (tmp_path / "none").mkdir()
    assert run("none", "empty").count() == 0


def test_many_rows_of_a_key_and_ties(spark, tmp_path, us):
    rows = [(i * 37 % 400, "abc"[i % 3], minute(20 - i * 7 % 11), f"note {i}") for i in range(400)]
    want = sorted(min((r[2], r[0], r[1], r[3]) for r in rows if r[1] == who) for who in "abc")
    got = deliver(spark, tmp_path, [*rows, (0, None, minute(10_000), "clock")])
    assert got == sorted((who, i, us(t), note) for t, i, who, note in want)
    assert len({r[2] for r in rows if r[1] == "a"}) < sum(r[1] == "a" for r in rows)


def test_many_keys_share_a_state(spark, tmp_path, us, monkeypatch):
    monkeypatch.setattr(incremental, "BUCKETS", 8)
    monkeypatch.setattr(incremental, "HELD_ROWS", 50)
    rows = [(i * 7 % 900, f"user {i % 300}", minute(i % 300 * 11 % 90, (900 - i) % 5), f"note {i}") for i in range(900)]
    late = [r for r in rows if r[2] >= minute(80)]
    early = [r for r in rows if r[2] < minute(80)]
    best = sorted(min((r[2], r[0], r[1], r[3]) for r in rows if r[1] == f"user {u}") for u in range(300))
    out = sorted((who, i, us(t), note) for t, i, who, note in best if t < minute(69))  # the watermark: 10 minutes before the last row
    assert deliver(spark, tmp_path, early) == out and len(out) < len({r[1] for r in early}) < 300
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() <= 8  # not one for each key
    assert deliver(spark, tmp_path, [*late, (0, None, minute(10_000), "clock")]) == sorted((who, i, us(t), note) for t, i, who, note in best)
