import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfwork.llm import periods

SCHEMA = "doc_id long, text string, runs string, n_words string, collapsed int"


def split(text):
    return [w.decode() for w in (text or "").encode().split()]  # of bytes: at ASCII blanks only


def brute(words):
    """All runs by comparing the words with themselves at each distance."""
    ids = {}
    x, found = np.array([ids.setdefault(w, len(ids)) for w in words]), {}
    for q in range(1, len(x) // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (x[q:] == x[:-q]).astype(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(24, 3 * q):
                found.setdefault((a, b + q), q)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(key, text):
    words, h = split(text), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def some(n=150, seed=1):
    r, out = random.Random(seed), []
    for _ in range(n):
        letters, words = "ab" if r.random() < 0.5 else "abcdefgh", []
        for _ in range(r.randint(0, 6)):
            own = [r.choice(letters) * r.randint(1, 3) for _ in range(r.randint(1, 30))]
            words += (own * r.randint(1, 30))[: r.randint(1, 200)]
        out.append(" ".join(words))
    return out


def fibonacci(n):
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b)


def thue_morse(n):
    return " ".join("ab"[bin(i).count("1") & 1] for i in range(n))


ODD = [
    None, "", " \n\t ", "one", "same " * 24, "same " * 23, "same " * 5000, "x" * 100_000, fibonacci(3000), thue_morse(4096), "a b " * 12, "a b " * 11 + "a",
    " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(700)) + (" " + " ".join(f"w{i}" for i in range(700))) * 2,
    "é ü\n" * 30, "a a b " * 20 + "a a a " * 20, " ".join(["u"] * 30 + ["v"] * 30 + ["w"]) + " " + " ".join((["u"] * 30 + ["v"] * 30 + ["w"]) * 4),
]


@pytest.mark.parametrize("text", ODD + some())
def test_runs_of_a_text(text):
    (n, runs, left), = periods.find(pa.array([text], pa.string()))
    words = (text or "").split(" ") if text and " " not in text and "\n" not in text else (text or "").encode().split()
    words = [w for w in words if w]
    assert n == len(words) and runs == brute(words)
    assert b" ".join(left) == (kept([w if isinstance(w, str) else w.decode() for w in words], runs)).encode()


def test_all_texts_of_a_batch(frame):
    texts = ODD + some(60, 5)
    rows = [(i, t, "r", "n", 1) for i, t in enumerate(texts)] + [(None, texts[4], "r", "n", 1), (3, "twice", "r", "n", 1), (3, "twice", "r", "n", 1)]
    got = periods.collapsed(frame(SCHEMA, rows)).collect()
    want = []
    for key, text, *_ in rows:
        words = split(text)
        want.append((key, len(words), brute(words), kept(words, brute(words))))
    assert sorted([(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got], key=str) == sorted(want, key=str)
    assert periods.collapsed(frame(SCHEMA, [])).collect() == []


def test_grammar_spells_its_sequence():
    for text in some(40, 9) + [fibonacci(500), "a " * 300]:
        ids = {}
        symbols = [ids.setdefault(w, len(ids)) for w in text.split()]
        rules, line = periods.re_pair(symbols)
        spell = lambda s: [s] if s >= 0 else spell(rules[-1 - s][0]) + spell(rules[-1 - s][1])
        assert [x for s in line for x in spell(s)] == symbols
        pairs = {}
        for i, pair in enumerate(zip(line, line[1:])):
            assert i - pairs.setdefault(pair, i) < 2  # no pair is left twice


def test_query(spark, frame, tmp_path):
    rows = [(i, t) for i, t in enumerate(some(120, 7) + ODD)] + [(None, "a b " * 40), (10, None)]
    frame("doc_id long, text string", rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in rows:
        words = planted(key, text) if " " not in (text or "") else [w.decode() for w in text.encode().split()]
        runs, best = brute(words), (None, None, None, None)
        if runs:
            s, n, p = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
            best = (s, n, p, 1000 * n // p)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((key, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept(words, runs).encode()).hexdigest()))
    got = [tuple(r) for r in periods.op11_periods(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 and t for k, t in rows)
