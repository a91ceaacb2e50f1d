import random
import zlib

import numpy as np
import pytest

from shelfwork.llm import common, labelled, language, quality, toxicity

NAMES = "doc_id long, text string, lang string, score string, label int"


def rank_share(score, label):
    """The probability that a row of label 1 scores above one of label 0."""
    score, label = np.array(score), np.array(label, bool)
    above = (score[label][:, None] > score[~label]).mean()
    return above + (score[label][:, None] == score[~label]).mean() / 2


def words(r, n, letters):
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n)]


def corpus(n=600):
    """Prose, and by turns: shouting (poor), insults in prose (toxic), in two languages."""
    r, rows, labels = random.Random(4), [], []
    for i in range(n):
        lang = "xx" if i % 3 else "yy"
        own = words(r, r.randint(20, 300), "abcdefghi" if lang == "xx" else "klmnöprstü")
        poor, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(max(2, len(own) // 40)):
                own.insert(r.randrange(len(own)), r.choice(["nastyword", "vilething", "awfulness"]))
        text = " ".join(own)
        if poor:
            text = " ".join(w.upper() + "!!" for w in own)
        rows.append((i, text, lang, "z", 3))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


ODD = [(9001, None), (9002, ""), (9003, "   "), (None, "abc abd abe"), (9004, "123 !!"), (9005, "abcd " * 60_000), (9006, "x" * 100_000), (9007, "abc"), (9007, "abc")]


@pytest.fixture(scope="module")
def made():
    return corpus()


def test_quality_on_held_out_rows(frame, made):
    rows, labels = made
    docs = frame(NAMES, rows + [(k, t, None, "z", 0) for k, t in ODD])
    weights = quality.trained(docs, frame("doc_id long, quality int, toxic int, text string", [(*x, "t") for x in labels]))
    got = quality.score(docs, weights)
    assert got.columns == ["doc_id", "text", "lang", "label", "score"]
    found = got.collect()
    assert len(found) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    held = [(r["score"], labels[r["doc_id"]][1]) for r in found if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert rank_share(*zip(*held, strict=True)) > 0.97


def test_toxicity_on_held_out_rows(frame, made):
    rows, labels = made
    docs = frame(NAMES, rows + [(k, t, None, "z", 0) for k, t in ODD])
    model = toxicity.trained(docs, frame("doc_id long, quality int, toxic int, text string", [(*x, "t") for x in labels]))
    assert b" nastyword " in model.toxic and b" nastyword " not in model.ordinary and len(model.toxic) == len(model.ordinary)
    found = toxicity.score(docs, model, keep=["doc_id"]).collect()
    assert len(found) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    held = [(r["score"], labels[r["doc_id"]][2]) for r in found if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert rank_share(*zip(*held, strict=True)) > 0.97


def test_language_on_held_out_rows(frame, made):
    rows, _ = made
    docs = frame(NAMES, rows + [(k, t, None, "z", 0) for k, t in ODD])
    found = language.predict(docs, language.train(docs)).collect()
    assert len(found) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r for r in found}
    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([by[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert np.mean([by[i]["accepted"] for i in held]) > 0.9
    assert {by[i]["lang_pred"] for i in (9001, 9002, 9003, 9004)} == {"und"} and by[9001]["score"] == 0
    assert by[9007]["lang_pred"] in ("xx", "yy")


def test_labels_of_held_out_rows_are_not_read(frame, made):
    rows, labels = made
    docs = frame(NAMES, rows)
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q, t) for k, q, t in labels]
    a, b = (quality.trained(docs, frame("doc_id long, quality int, toxic int", x)) for x in (labels, turned))
    assert np.array_equal(a, b)


def test_contradicting_and_null_labels_are_left_out(frame):
    docs = frame("doc_id long, text string", [(1, "a"), (3, "b"), (4, "c"), (5, "d"), (None, "e")])
    labels = frame("doc_id long, quality int", [(1, 1), (1, 0), (3, 1), (3, 1), (4, None), (None, 1), (77, 1)])
    assert [tuple(r) for r in labelled.labelled_sample(docs, labels, "quality", 4, 99).collect()] == [(3, "b", 1.0)]


def test_without_rows_or_labels(frame):
    docs, none = frame("doc_id long, text string, lang string", [(1, "a b", None)]), frame("doc_id long, text string, lang string", [])
    labels = frame("doc_id long, quality int, toxic int", [])
    assert quality.score(docs, quality.trained(docs, labels)).first()["score"] == 1.0
    assert toxicity.score(docs, toxicity.trained(docs, labels)).first()["score"] == 0.0
    assert language.predict(docs, language.train(docs)).first()["lang_pred"] == "und"
    for df in (quality.score(none, None), toxicity.score(none, None), language.predict(none, None)):
        assert df.collect() == []
    one = frame("doc_id long, quality int, toxic int", [(1, 1, 0)])
    assert 0 <= quality.score(docs, quality.trained(docs, one)).first()["score"] <= 1
    assert toxicity.trained(docs, one) is None


def test_windows_hold_all_words():
    text = ("Ab, cd! " * 50 + "x" * 200 + " é").encode()
    parts = list(toxicity.windows(text))
    assert b" ".join(parts).replace(b"x " * 4, b"").replace(b" ", b"").count(b"x") == 200
    assert max(map(len, parts)) <= toxicity.WINDOW and list(toxicity.windows(b"")) == [b""]


def test_updates_lower_the_loss():
    r = np.random.default_rng(0)
    rows = [(np.array([i % 2, 2 + r.integers(5)]), np.array([1.0, 0.5]), float(i % 2)) for i in range(400)]
    w = quality.ftrl(rows, bits=4)
    assert w[1] > 0.5 > -0.5 > w[0] and np.abs(w[2:7]).max() < 0.5


def test_samples_are_bounded_whatever_the_keys(frame):
    texts = [f"text number {i}" for i in range(3000)]
    for keys in ([None] * 3000, [i % 3 for i in range(3000)], [7 if i < 2400 else i for i in range(3000)], list(range(3000))):
        rows = [(k, t, "xx") for k, t in zip(keys, texts, strict=True)] + [(1, "hot copy", "xx")] * 3000
        df = frame("doc_id long, text string, lang string", rows)
        got = common.text_sample(df, "text", 400, ("lang",)).collect()
        assert 200 < len(got) <= 400 and len({r["text"] for r in got}) == len(got)
    few = common.text_sample(df, "text", 400, most=3000).collect()
    assert 100 < sum(len(r["text"]) for r in few) < 6000
    labels = frame("doc_id long, quality int", [(i, i % 2) for i in range(3000)])
    hot = frame("doc_id long, text string", [(i % 50, t) for i, t in enumerate(texts)] + [(8, "hot copy")] * 3000)
    got = labelled.labelled_sample(hot, labels, "quality", 4, 99, rows=400).collect()
    assert 200 < len(got) <= 400 and all(r["label"] == r["key"] % 2 for r in got)
    assert common.text_sample(df.limit(0), "text", 400).collect() == []
