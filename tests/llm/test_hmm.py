import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from shelfwork.llm import hmm


def small_model(states=3, symbols=5, seed=0):
    r = np.random.default_rng(seed)
    share = lambda *s: (x := r.uniform(0.1, 1, s)) / x.sum(-1, keepdims=True)
    return hmm.Hmm(share(states), share(states, states), np.ascontiguousarray(share(states, symbols).T))


def by_paths(model, seq):
    total = 0
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:], strict=False):
            p *= model.move[a, b] * model.emit[s, b]
        total += p
    return math.log(total)


SEQUENCES = [np.array(s) for s in ([0], [1, 2, 3, 4, 0], [2, 2], [4, 3, 1, 1], [0, 0, 0, 0, 0, 0])]


def test_forward_sums_over_all_paths():
    model = small_model()
    got = hmm.forward(hmm.Sorted(SEQUENCES), model)[0]
    assert np.allclose(got, [by_paths(model, s) for s in SEQUENCES])
    assert np.allclose(got, hmm.forward_in_batches(SEQUENCES, model))


def test_expected_counts_are_those_of_all_paths():
    model, seq = small_model(), [1, 2, 3, 3, 0]
    start, moves, emits, log = hmm.expected(hmm.Sorted([np.array(seq)]), model)
    want = np.zeros_like(moves), np.zeros_like(emits), np.zeros_like(start)
    for path in itertools.product(range(3), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:], strict=False):
            p *= model.move[a, b] * model.emit[s, b]
        want[2][path[0]] += p
        for a, b in itertools.pairwise(path):
            want[0][a, b] += p
        for s, b in zip(seq, path, strict=True):
            want[1][s, b] += p
    whole = math.exp(log)
    assert np.allclose(moves, want[0] / whole) and np.allclose(emits, want[1] / whole) and np.allclose(start, want[2] / whole)


def test_long_sequences_do_not_underflow():
    got = hmm.forward(hmm.Sorted([np.zeros(20_000, np.int64)]), small_model())[0]
    assert np.isfinite(got).all() and got[0] < -1000


def texts(n=120):
    r = random.Random(1)
    sides = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    rows = [(i, " ".join(r.choice(sides[i % 2]) for _ in range(r.randint(0, 60))).title()) for i in range(n)]
    return rows + [(9001, None), (9002, ""), (9003, "unseen word"), (9004, "A1 " * 30_000), (None, "a1 b2"), (1, "a1 a1"), (1, "a1 a1")]


@pytest.mark.parametrize(("near", "symbols"), [(1 << 18, 1 << 14), (12, 5), (1, 1)])
def test_scores(frame, near, symbols):
    rows = texts()
    got = hmm.score(frame("doc_id long, text string, row string, key int, hash int", [(*r, "x", 1, 2) for r in rows]), near=near, symbols=symbols, states=3, rounds=3).collect()
    bucket = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    tokens = [(k, (t or "").encode().lower().split() + [None]) for k, t in rows]
    c = collections.Counter(w for k, ws in tokens if not bucket(k) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [
        (k, bucket(k), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for k, ws in tokens
    ]
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], key=str) == sorted(want, key=str)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if near > 100:  # states tell the two kinds of text apart, also in held-out ones
        held = [r for r in got if r["held_out"] and r["n_tokens"] > 5 and r["doc_id"] and r["doc_id"] < 9000]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_the_model_is_a_distribution_over_words(frame):
    """All texts of one word, with the end: their probabilities and those of an end at once sum to one at most."""
    rows = texts(60)
    words = sorted({w for _, t in rows for w in (t or "").lower().split()})
    docs = frame("doc_id long, text string", rows + [(20_000 + i, w) for i, w in enumerate(words) if zlib.crc32(str(20_000 + i).encode()) % 10 == 0])
    got = hmm.score(docs, near=40, symbols=20, states=2, rounds=2).collect()
    assert sum(10 ** r["score"] for r in got if r["doc_id"] and r["doc_id"] >= 20_000) < 1


def test_a_batch_of_no_words_and_an_empty_table(frame):
    assert hmm.score(frame("doc_id long, text string", [])).collect() == []
    one = hmm.score(frame("doc_id long, text string", [(2, None)]), rounds=1).collect()
    assert [(r["n_tokens"], r["n_known"]) for r in one] in ([(1, 0)], [(1, 1)])
