import random

import numpy as np
import pytest
import xxhash

from shelfwork.llm import simhash


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(prints, near=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= near:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def clusters(seed, centres, members, flips):
    r, out = random.Random(seed), set()
    for _ in range(centres):
        centre = r.getrandbits(64)
        for _ in range(members):
            x = centre
            for _ in range(r.randint(0, flips)):
                x ^= 1 << r.randrange(64)
            out.add(int(np.uint64(x).view(np.int64)))
    return sorted(out)


@pytest.mark.parametrize(("members", "shape"), [(4096, (40, 6, 4)), (5, (4, 60, 5)), (3, (1, 150, 3))])
def test_components_of_links(frame, members, shape):
    prints = [*clusters(3, *shape), 0, 1, 3, 15, -1]
    edges = simhash.links(frame("fingerprint long", [(p,) for p in prints]), members=members)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components(sorted(set(prints)))
    assert {p: roots.get(p, p) for p in want} == want


def test_links_are_a_forest_in_each_file():
    own = np.array(clusters(5, 1, 500, 2))
    assert len(simhash._chain(np.array([0, -(1 << 63)]), 2)) == 1
    assert len(simhash._chain(own, 64)) == len(own) - 1


TEXTS = [
    "The cat sat on the mat", "the  CAT\tsat on\nthe mat", "", None, "   ", "one", "one two", "ÉTÉ été", "x" * 50_000, "word " * 40_000,
    "The cat sat on the mat",
]


def test_near_duplicates(frame):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 1), (None, "alone here", "x", 1), (5, "one", "x", 1)]
    got = simhash.near_duplicates(frame("doc_id long, text string, fingerprint string, key int", rows)).collect()
    prints = {brute_print(t) for _, t, *_ in rows}
    roots = brute_components(sorted(prints))
    least = {}
    for key, text, *_ in rows:
        if key is not None:
            root = roots[brute_print(text)]
            least[root] = min(key, least.get(root, key))
    want = [(k, brute_print(t), least.get(roots[brute_print(t)])) for k, t, *_ in rows]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_empty_table(frame):
    none = frame("doc_id long, text string", [])
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.representatives(none).collect() == []


def test_one_row_of_each_group_stays(frame):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 1), (None, "alone here", "x", 2), (5, "one", "x", 3), (5, "other words", "x", 4)]
    rows += [(None, "alone here", "x", 5)]
    got = simhash.representatives(frame("doc_id long, text string, component_id string, key int", rows)).collect()
    roots = brute_components(sorted({brute_print(t) for _, t, *_ in rows}))
    best = {}
    for at, (key, text, *_) in enumerate(rows):
        root, rank = roots[brute_print(text)], (key is None, key or 0, at)
        best[root] = min(best.get(root, rank), rank)
    assert sorted([tuple(r) for r in got], key=str) == sorted([rows[at] for *_, at in best.values()], key=str)
