"""The learning steps, restated in plain Python."""

import math
import random

import numpy as np
import zstandard

from shelfwork.llm import labelled, language, quality, toxicity


def test_ftrl_updates():
    r = random.Random(2)
    rows = [(np.array(sorted(r.sample(range(16), 3))), np.array([r.uniform(0.1, 1) for _ in range(3)]), float(i % 2)) for i in range(10)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for index, value, label in rows:
            pairs = [*zip(index.tolist(), value.tolist(), strict=True), (16, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - label) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.ftrl(rows, bits=4, epochs=3)
    assert len(got) == 17 and np.allclose(got, [weight(i) for i in range(17)], atol=1e-12) and np.abs(got).max() > 0.1


def test_a_text_scores_as_its_sparse_product(frame):
    text = "Some words, some WORDS again!"
    weights = np.random.default_rng(0).normal(size=(1 << 8) + 1)
    data = np.frombuffer(text.encode(), np.uint8)
    row, index, value = quality.features(data, np.array([0, len(data)]), 8)
    total = weights[-1] + sum(weights[i] * v for i, v in zip(index.tolist(), value.tolist(), strict=True))
    assert set(row) == {0} and math.isclose(sum(v * v for v in value), 1)
    got = quality.score(frame("doc_id long, text string", [(1, text), (2, None)]), weights).collect()
    assert math.isclose(got[0]["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert math.isclose(got[1]["score"], 1 / (1 + math.exp(-weights[-1])), rel_tol=1e-9)


def test_softmax_descent():
    r, bits, classes = random.Random(4), 5, 3
    rows = [(np.array(sorted(r.sample(range(32), 4))), np.array([0.4, 0.3, 0.2, 0.1]), i % classes) for i in range(10)]
    start = np.random.default_rng(1)
    inner = (start.uniform(-1, 1, (32, language.WIDTH)) / language.WIDTH).tolist()
    outer, bias = (start.uniform(-1, 1, (language.WIDTH, classes)) / language.WIDTH).tolist(), [0.0] * classes
    width, steps, done = range(language.WIDTH), 2 * len(rows), 0
    for _ in range(2):
        for index, share, label in rows:
            rate = language.RATE * (1 - done / steps)
            done += 1
            hidden = [sum(s * inner[i][k] for i, s in zip(index, share, strict=True)) for k in width]
            raw = [math.exp(sum(hidden[k] * outer[k][c] for k in width) + bias[c]) for c in range(classes)]
            g = [x / sum(raw) - (c == label) for c, x in enumerate(raw)]
            back = [sum(outer[k][c] * g[c] for c in range(classes)) for k in width]
            for k in width:
                for c in range(classes):
                    outer[k][c] -= rate * hidden[k] * g[c]
            for c in range(classes):
                bias[c] -= rate * 0.1 * g[c]
            for i, s in zip(index, share, strict=True):
                for k in width:
                    inner[i][k] -= rate * len(index) ** 0.5 * s * back[k]
    scores, got = language.descend(rows, classes, bits=bits, epochs=2)
    assert np.allclose(scores, np.array(inner) @ np.array(outer), atol=1e-10) and np.allclose(got, bias, atol=1e-12)


def test_an_answer_is_the_softmax_of_averages(frame):
    model = language.Model(["aa", "bb"], np.random.default_rng(3).normal(size=(1 << language.BITS, 2)).astype(np.float32), np.array([0.1, -0.2]), 0.6)
    rows = [(1, "abc DEF, été"), (2, "zz"), (3, "12 !?"), (4, None)]
    got = {r["doc_id"]: r for r in language.predict(frame("doc_id long, text string", rows), model).collect()}
    for key, text in rows[:2]:
        data = np.frombuffer(text.encode(), np.uint8)
        _, index = language.subwords(data, np.array([0, len(data)]))
        raw = [math.exp(sum(float(model.scores[i, c]) for i in index) / len(index) + model.bias[c]) for c in (0, 1)]
        best = max((0, 1), key=lambda c: raw[c])
        assert got[key]["lang_pred"] == model.languages[best] and math.isclose(got[key]["score"], raw[best] / sum(raw), rel_tol=1e-6)
        assert got[key]["accepted"] == (got[key]["score"] >= 0.6)
    assert [(got[k]["lang_pred"], got[k]["score"], got[k]["accepted"]) for k in (3, 4)] == [("und", 0.0, False)] * 2


def test_distances_of_windows():
    line = toxicity.LINE
    entries = lambda words: b"".join(b"\x01 " + w + b" " for w in words)
    common = entries([b"the", b"house"])
    model = toxicity.Model(line + common + entries([b"gardens"]), line + common + entries([b"dreadful"]))

    def length(content, window):
        settings = zstandard.ZstdCompressionParameters.from_level(
            5, source_size=toxicity.WINDOW + 31, dict_size=len(content), write_content_size=0, write_dict_id=0, strategy=zstandard.STRATEGY_LAZY, min_match=6, search_log=4,
        )
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress(window))

    for text in (b"The DREADFUL house, dreadful! the gardens of others are quite dreadful indeed", b"", b"plain words only", b"x" * 500):
        parts = list(toxicity.windows(text))
        d = [length(model.ordinary, line + b" " + w + b" ") - length(model.toxic, line + b" " + w + b" ") for w in parts]
        over = lambda k: sum(x >= k for x in d)  # noqa: B023, E731
        want = (sum(d) / len(d), max(d), math.log1p(max(sum(d), 0)), math.log1p(over(3)), math.log1p(over(5)), over(4) / len(d))
        assert np.allclose(toxicity.Distance(model).features(text), want)
    assert toxicity.Distance(model).features(b"a dreadful thing")[1] > 2 > toxicity.Distance(model).features(b"a nice thing")[1]


def test_the_curve_has_no_slope_left():
    r = np.random.default_rng(6)
    x = r.normal(size=(40, 2))
    y = (x[:, 0] + r.normal(size=40) > 0).astype(float)
    w = labelled.logistic(x, y, ridge=0.5)
    p = [1 / (1 + math.exp(-(w[0] + w[1] * a + w[2] * b))) for a, b in x]
    assert abs(sum(q - t for q, t in zip(p, y, strict=True)) + 1e-3 * w[0]) < 1e-6
    for k in (0, 1):
        assert abs(sum((q - t) * v[k] for q, t, v in zip(p, y, x, strict=True)) + 0.5 * w[k + 1]) < 1e-6
