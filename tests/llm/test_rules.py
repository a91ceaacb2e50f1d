import random
import re
from collections import Counter

import duckdb
import pytest

from shelfwork.llm import common, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept int, bucket string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), len(lines)


def bucket(v):
    shift = max(v.bit_length() - 8, 0)
    return shift * 128 + (v >> shift)


def least(b):
    shift = max(b // 128 - 1, 0)
    return (b - shift * 128) << shift


def values(c):
    n, chars, symbols, dup, rep, lines = c
    return {"word_length": 1000 * chars // n, "symbols": 1000 * symbols // n, "dup_lines": 1000 * dup // lines, "repeated": 1000 * rep // n}


def brute(rows, enough):
    groups = {}
    for _, text, lang, source in rows:
        c = counts(text)
        if c[0]:
            for group in ((lang, source), (lang,), ()):
                groups.setdefault(group, []).append(values(c))
    out = []
    for key, text, lang, source in rows:
        c = counts(text)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        kept = not failed
        if c[0]:
            own = next(groups[g] for g in ((lang, source), (lang,), ()) if len(groups[g]) >= enough or not g)
            for rule, floor, two in (("word_length", 100, True), ("symbols", 20, False), ("dup_lines", 100, False), ("repeated", 50, False)):
                b = sorted(bucket(v[rule]) for v in own)
                q1, q3 = least(b[(25 * len(b) + 99) // 100 - 1]), least(b[(75 * len(b) + 99) // 100 - 1] + 1) - 1
                spread = max(q3 - q1, floor)
                kept &= q3 + 5 * spread >= values(c)[rule] >= (q1 - 5 * spread if two else 0)
        out.append((key, *c[:5], failed, kept))
    return sorted(out, key=str)


def some(n=260):
    r, rows = random.Random(2), []
    for i in range(n):
        lang, source = r.choice(["en"] * 5 + ["de", None]), r.choice(["a"] * 6 + ["b", None])
        words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 8 if lang == "en" else 12))) for _ in range(r.randint(5, 80))]
        kind = r.randrange(12)
        if kind == 0:
            words = [w * 4 for w in words]
        elif kind == 1:
            words = [w + "#$" for w in words]
        elif kind == 2:
            words = words[:9] * 3 + words
        elif kind == 3:
            words = [words[0] + "\n", words[1] + "\n"] * 12 + words
        rows.append((i, " ".join(words), lang, source))
    return rows


ODD = [
    (None, "a b c", "en", "a"), (None, None, None, None), (901, "", "en", "a"), (902, " \n\t ", "en", "b"), (903, "same " * 5000, "en", "a"), (904, "x" * 300_000, "en", "a"),
    (905, "# * $", "zz", "q"), (906, "seven words are not yet a window", "en", "a"), (907, "no-break space   é\U0001f600", "en", "a"), (908, "a\n\na\n a\nb", "en", "a"),
    (909, " ".join(f"w{i}" for i in range(20_000)) * 2, "en", "a"), (910, "tie " + "one two three four five six seven eight " * 2 + "end " * 3, "en", "a"),
] + [(1, "again and again " * 3, "en", "a")] * 3


@pytest.mark.parametrize(("rows", "enough"), [(some() + ODD, 30), (some() + ODD, 1), (some(40), 1000), (ODD[:3], 200), ([], 200)])
def test_same_as_brute_force(frame, rows, enough):
    got = rules.judged(frame(SCHEMA, [(*r, "w", 1, "b") for r in rows]), enough=enough).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, enough)


def test_hot_groups_without_broadcast(frame, monkeypatch):
    monkeypatch.setattr(common, "fits", lambda df, *_: False)
    rows = some()
    got = rules.judged(frame(SCHEMA, [(*r, "w", 1, "b") for r in rows]), enough=30).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 30)


def test_sketches_merge(frame):
    rows = some()
    measured = rules.measures(frame(SCHEMA, [(*r, "w", 1, "b") for r in rows]), {"g": common.F.col("lang"), "s": common.F.col("source")})
    parts = rules.merged(rules.sketches(measured, ["g", "s"]), ["g"])
    assert sorted(map(str, parts.collect())) == sorted(map(str, rules.sketches(measured, ["g"]).collect()))


def test_buckets_of_numbers(spark):
    df = spark.createDataFrame([(v,) for v in [*range(3000), 10**6, 2**40 + 12345, 2**62]], "v long")
    for v, b, low, high in df.select("v", rules.bucket_of(common.F.col("v")), rules.least_of(rules.bucket_of(common.F.col("v"))), rules.least_of(rules.bucket_of(common.F.col("v")) + 1)).collect():
        assert b == bucket(v) and low <= v < high and high - low <= max(1, v // 100)


def test_query_and_its_sql(spark, frame, tmp_path):
    rows = [(i, *r[1:]) for i, r in enumerate(some() + ODD)]
    frame("doc_id long, text string, lang string, source string", rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in rules.op12_rules(spark, str(tmp_path)).collect()], key=str)
    assert got == brute(rows, rules.ENOUGH)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(rules._sql()).fetchall(), key=str) == got
