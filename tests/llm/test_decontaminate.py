import re

import pytest

from shelfwork.llm.decontaminate import contamination

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set())
            if item is not None:
                windows[tuple(w[s : s + n])].add(str(item))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


PASSAGE = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, PASSAGE), (2, "One TWO three"), (2, "one two three"), (3, None), (4, ""), (5, " ".join(["same"] * 20)), (None, "null id here"), (10, PASSAGE)]
DOCS = [
    (1, "x " + PASSAGE + " y"), (2, PASSAGE[: len(PASSAGE) // 2]), (3, "zero one, two. THREE four"), (4, None), (5, ""),
    (6, "!!! ..."), (7, "same " * 300), (8, "ÉTÉ one two three été"), (9, "a " * 5000 + PASSAGE), (None, PASSAGE), (1, PASSAGE),
    (1, PASSAGE), (11, " ".join(f"w{i}" for i in range(12))), (12, " ".join(f"w{i}" for i in range(5, 18))), (13, "see null-ID here"),
    (14, " ".join(f"w{i}" for i in [*range(0, 14), *range(10, 25)])),
]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], [(3, None)], []])
def test_same_as_brute_force(frame, items):
    docs = frame("doc_id long, text string, n_hit string, words string", [(*d, "x", "y") for d in DOCS])
    got = contamination(docs, frame("item_id long, text string, key string", [(*i, "z") for i in items])).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got], key=str) == brute(DOCS, items)


def test_no_documents(frame):
    assert contamination(frame("doc_id long, text string", []), frame("item_id long, text string", ITEMS)).collect() == []


def test_joins_without_broadcast(frame, monkeypatch):
    from shelfwork.llm import decontaminate

    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    got = contamination(frame("doc_id long, text string", DOCS), frame("item_id long, text string", ITEMS)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got], key=str) == brute(DOCS, ITEMS)
