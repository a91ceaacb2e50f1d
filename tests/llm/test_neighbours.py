import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwork.llm import neighbours


def brute(rows, asks, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q, v in rows:
        if asks(q):
            best = {}
            for i, x in rows:
                if i != q:
                    s = 0.0
                    for a, b in zip(v, x, strict=True):
                        s += a * b
                    best[i] = max(s, best.get(i, -np.inf))
            for i, s in best.items():
                out.setdefault(q, {})
                out[q][i] = max(s, out[q].get(i, -np.inf))
    return {q: sorted(((-s, i) for i, s in found.items()))[:k] for q, found in out.items()}


def search(frame, rows, k, **more):
    df = frame("vec_id long, embedding array<float>, class int, block int, score int", [(*r, 1, 2, 3) for r in rows])
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 5 == 0, k, **more).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["id"]))
    for found in got.values():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
    return {q: [x[1:] for x in found] for q, found in got.items()}


def rounded(found):
    return {q: [(round(s, 9), i) for s, i in x] for q, x in found.items()}


ODD = [(901, None), (902, []), (903, [0.0] * 8), (904, [1.0] * 7 + [float("nan")]), (905, [1.0] * 7 + [float("inf")]), (906, [1.0] * 7), (907, [1.0] * 7 + [None]), (None, [1.0] * 8)]


@pytest.mark.parametrize("n", [3, 40, 300])
def test_small_tables_are_searched_exactly(frame, n):
    r = np.random.default_rng(n)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 8)]) for i in range(n)]
    rows = [(i, v if any(v) else [1.0] + [0.0] * 7) for i, v in rows]
    rows += rows[:2] + [(1000 + i, rows[0][1]) for i in range(60)] + [(0, rows[-1][1])]
    got = search(frame, rows + ODD, 6, block=16, tile=8)
    assert rounded(got) == rounded(brute(rows, lambda q: q % 5 == 0, 6))


def test_fewer_candidates_than_asked_for(frame):
    assert search(frame, [(0, [1.0, 0.0]), (5, [0.5, 0.5])], 20) == {0: [(-0.5, 5)], 5: [(-0.5, 0)]}
    assert search(frame, [(0, [1.0, 0.0])], 20) == {} and search(frame, [], 20) == {}


def test_windows_reach_the_recall_on_data_with_structure(frame):
    """Points along few directions: the curves' windows suffice, without a pass over all blocks."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(400, 16))
    x = np.repeat(centres, 25, axis=0) + 0.02 * r.normal(size=(10_000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    order = r.permutation(len(x))
    facts = {}
    df = frame("vec_id long, embedding array<float>", [(int(i), [float(a) for a in x[j]]) for i, j in enumerate(order)])
    got = neighbours.nearest(df, F.col("id") % 20 == 0, 20, block=64, facts=facts).toPandas()
    assert not facts["scan"] and facts["blocks"] > 100
    hits = 0
    x = x[order]
    for q, found in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20]) & set(found["id"]))
    assert hits / (20 * got["query_id"].nunique()) >= 0.9


def test_the_curve_steps_to_a_neighbouring_cell():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()
