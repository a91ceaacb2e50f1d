import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwork.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    n_chars = None if n_chars is None else n_chars + more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """The root, and each leaf's list of (is left, digest) or None."""
    paths, own, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for j, i in enumerate(own):
            other = i ^ 1
            paths[j].append((other < i, nodes[other]) if other < len(nodes) else None)
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        own = [i // 2 for i in own]
    return nodes[0], paths


def brute(rows):
    trees, out = {}, []
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = []
    for lang in langs:
        own = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        done.append((own, *climb([leaf_of(r) for r in own])))
    if not done:
        return []
    root, above = climb([d[1] for d in done])
    for (own, subroot, paths), high in zip(done, above, strict=True):
        for row, path in zip(own, paths, strict=True):
            path = path + high
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            d = leaf_of(row, 1 if changed else 0)
            for s in path:
                d = h(d) if s is None else h(s[1], d) if s[0] else h(d, s[1])
            out.append((row[0], leaf_of(row), subroot, root, h(*(s[1] for s in path if s)), d, d == root))
    return sorted(out, key=str)


def some(n, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        lang = r.choice(["en"] * 6 + ["de", "fr", "é", "z", None])
        rows.append((i, r.choice(["", "a b", None, "ü" * r.randint(0, 9), f"text {i}"]), lang, r.choice([None, "", "s"]), r.choice([None, 0, 7])))
    return rows


ODD = [(None, "a", "en", "s", 1), (None, None, None, None, None), (5, "x" * 200_000, "en", "s", 2), (5, "other", "en", "s", 2), (7, "", "only", "", 0)] + [(9, "again", "en", "s", 1)] * 40


def columns(df):
    paths = F.col("path")
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(paths), merkle.folded(F.col("leaf"), paths)).collect()]


@pytest.mark.parametrize(("rows", "bits"), [(some(300) + ODD, 2), (some(300) + ODD, 10), (some(17), 1), (some(1), 3), ([(1, "a", "x", None, 1), (2, "b", "y", None, 1)], 2), ([], 2)])
def test_same_as_brute_force(frame, rows, bits):
    docs = frame(SCHEMA, [(*r, "l", 1, "r") for r in rows])
    got = columns(merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id", bits=bits))
    assert all(x[5] == x[3] for x in got)
    assert sorted([x[:5] for x in got], key=str) == [x[:5] for x in brute(rows)]


def test_query_and_its_sql(spark, frame, tmp_path):
    rows = [r for r in some(200, 3) + ODD if r[0] is not None]
    docs = frame("doc_id long, text string, lang string, source string, n_chars long", rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert sorted([tuple(r) for r in merkle.op13_merkle(spark, str(tmp_path)).collect()], key=str) == want
    assert {x[-1] for x in want} == {True, False}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(merkle._SQL).fetchall(), key=str) == want
