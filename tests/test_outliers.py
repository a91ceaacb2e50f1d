import math
import random
import re
from collections import Counter

import pytest

from shelfwork.functions import fixed_values as fixed
from shelfwork.operators import outliers as O
from shelfwork.operators import vocab as V


def sentences(text):
    return [s for s in (x.strip(" \t\n\r\f\x0b") for x in re.findall(r"[^.!?]+[.!?]*", text)) if s]


def similar_pairs(text, threshold=0.8):
    sents = sentences(text.lower())
    tokens = [Counter(re.findall(r"\b\w\w+\b", s)) for s in sents]
    n = len(sents)
    df = Counter(t for c in tokens for t in c)
    vectors = []
    for c in tokens:
        v = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({t: x / length for t, x in v.items()})
    return sents, [
        (i, j) for i in range(n) for j in range(i + 1, n)
        if round(sum(x * vectors[j].get(t, 0.0) for t, x in vectors[i].items()), 9) > threshold
    ]


def made_up_texts(count, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "red", "blue", "ring", "bolt", "gear", "the"]
    out = []
    for _ in range(count):
        lines = [" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 14))]
        for _ in range(rnd.randint(0, 8)):
            line = rnd.choice(lines)
            lines.append(line if rnd.random() < 0.5 else line + " " + rnd.choice(words))
        out.append(". ".join(lines) + ".")
    return out


@pytest.fixture(scope="module")
def texts():
    extra = ["", ". . .", "a. a. a.", "same words here. here words same. other thing", "one. two. ! 3"]
    return made_up_texts(60, 5) + extra


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_redundant_sentences_equal_all_pairs(frame, texts):
    got = {
        r["id"]: sorted((x["sent_ix"], x["similar_to"]) for x in r["redundant"])
        for r in O.redundant_sentences(frame, "id", "text").collect()
    }
    for i, text in enumerate(texts):
        _, pairs = similar_pairs(text)
        want = {}
        for a, b in pairs:
            want[b] = min(a, want.get(b, a))
        assert got.get(i, []) == sorted(want.items()), text


def test_pair_counts_equal_all_pairs(frame, texts):
    report = O.redundancy_report(O.similar_sentences(frame, "id", "text"), "id")
    got = {r["id"]: r["similar_pairs"] for r in report.collect()}
    want = {i: len(similar_pairs(t)[1]) for i, t in enumerate(texts)}
    assert got == {i: n for i, n in want.items() if n}


def test_deduped_text(frame, texts):
    got = {r["id"]: r["text"] for r in O.dedupe_sentences(frame, "id", "text").collect()}
    for i, text in enumerate(texts):
        sents, pairs = similar_pairs(text)
        gone = {j for _, j in pairs}
        assert got[i] == " ".join(s for k, s in enumerate(sents) if k not in gone)


def summary(text, best=3):
    sents = sentences(text)
    stop = set(fixed.STOP_WORDS)

    def terms(s):
        return [t for t in re.findall(r"\w+", s) if t not in stop and t not in fixed.PUNCTUATION]

    freq = Counter(t for s in sents for t in terms(s))
    ranked = sorted(range(len(sents)), key=lambda i: -sum(freq[t] for t in terms(sents[i])))
    return ranked[:best], sents


def test_summary(frame, texts):
    by_score = {r["id"]: r["text"] for r in O.summarize(frame, "id", "text").collect()}
    in_order = {r["id"]: r["text"] for r in O.summarize(frame, "id", "text", order="document").collect()}
    for i, text in enumerate(texts):
        ranked, sents = summary(text)
        assert by_score[i] == " ".join(sents[k] for k in ranked)
        assert in_order[i] == " ".join(sents[k] for k in sorted(ranked))


def test_summary_of_the_deduped_text(frame, texts):
    redundant = O.redundant_sentences(frame, "id", "text")
    got = {r["id"]: r["text"] for r in O.summarize(frame, "id", "text", redundant=redundant).collect()}
    deduped = {r["id"]: r["text"] for r in O.dedupe_sentences(frame, "id", "text").collect()}
    for i in range(len(texts)):
        ranked, sents = summary(deduped[i])
        assert got[i] == " ".join(sents[k] for k in ranked)


def test_only_long_texts_change(spark):
    short, long_ = "A b. A b. C d.", " ".join(["Word one two."] * 80)
    df = spark.createDataFrame([(1, short, "x"), (2, long_, "y"), (3, None, "z")], "id int, text string, more string")
    got = {r["id"]: (r["text"], r["more"]) for r in O.transform_long_texts(df, "id", "text", 200).collect()}
    assert got == {1: (short, "x"), 2: ("word one two.", "y"), 3: (None, "z")}


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1, "w " * 199 + "w"), (2, "w " * 198 + "w")], "id int, text string")
    got = {r["id"]: r["is_long"] for r in O.long_text_mask(df, "text", 200).collect()}
    assert got == {1: True, 2: False}


def test_describe(spark):
    import numpy as np

    values = [1, 5, 5, 7, 12, 40]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    row = O.describe(df, "v").first()
    assert row["count"] == 6 and row["min"] == 1 and row["max"] == 40
    assert row["std"] == pytest.approx(np.std(values, ddof=1))
    assert [row["q25"], row["q50"], row["q75"]] == list(np.percentile(values, [25, 50, 75]))


def test_document_terms_are_counted_in_their_rows(spark, frame, texts, monkeypatch):
    def expected(rows):
        found = Counter((k, w) for k, t in rows for w in re.findall(r"[^\W]+", t or ""))
        return {(k, w): n for (k, w), n in found.items() if w not in fixed.STOP_WORDS and w not in fixed.PUNCTUATION}

    def got(df):
        return {(r["id"], r["term"]): r["n"] for r in df.collect()}

    alone = O.document_terms(frame, "id", "text")
    assert "Aggregate" not in alone._jdf.queryExecution().executedPlan().toString()  # no map of a task's documents and terms
    assert got(alone) == expected(enumerate(texts))

    rows = [*enumerate(texts), (None, "bolt gear bolt"), (3, "gear"), (None, "bolt"), (3, None), (4, None), (900, ""), (901, None)]
    again = spark.createDataFrame(rows, "id int, text string")
    monkeypatch.setattr(V, "SUMMED_CHARS", 100)
    assert got(O.document_terms(again, "id", "text")) == expected(rows)  # few keys are repeated
    assert O.document_terms(again, "id", "text").count() == len(expected(rows))
    monkeypatch.setattr(V, "bounded", lambda df: None)
    summed = O.document_terms(again, "id", "text")  # too many to be known to each task
    chars = sum(len(t or "") for _, t in rows)
    assert f", {-(-chars // 100)})" in summed._jdf.queryExecution().executedPlan().toString() and chars > 800
    assert got(summed) == expected(rows)
