import random

import corpus_pipeline

from shelfwork.llm import bpe

from test_decontaminate import brute
from test_simhash import brute_components, brute_print

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        poor, toxic = i % 6 == 0, i % 6 == 1
        w = prose(r.randint(60, 120)).split()
        if toxic:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["nastyword", "vilething"]))
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if poor else " ".join(w), "xx", "s", 0))
        labels.append((i, int(not poor), int(toxic)))
    passage = prose(40)
    clean = prose(400)
    words = clean.split()
    words[7] = "changed"
    rows += [(1000, clean, "xx", "s", 0), (1001, clean, "xx", "s", 0), (1002, " ".join(words), "xx", "s", 0), (1003, prose(20) + " " + passage, "xx", "s", 0), (1004, clean[: len(clean) // 4] + passage.split()[0], "xx", "s", 0), (None, prose(90), None, None, None), (1005, prose(30), "xx", "s", 0), (1005, prose(20) + " " + passage, "xx", "s", 0), (None, prose(9) + " " + passage, None, None, 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept, texts = spark.read.parquet(f"{folder}/documents.parquet"), {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {x["doc_id"] for x in docs.collect()}
        texts[name] = [(x["doc_id"], x["text"]) for x in docs.collect()]
    fine = {i for i in range(300) if i % 6 > 1}
    assert len(fine - kept["decontamination"]) <= 3 and len({i for i in range(0, 300, 6)} & kept["quality"]) <= 1
    assert len({i for i in range(1, 300, 6)} & kept["toxicity"]) <= 2
    roots = brute_components(sorted({brute_print(t) for _, t in texts["toxicity"]}))
    first = {}
    for key, text in sorted(texts["toxicity"], key=lambda x: (x[0] is None, x[0] or 0), reverse=True):
        first[roots[brute_print(text)]] = key
    assert sorted(map(str, first.values())) == sorted(str(k) for k, _ in texts["near_duplicates"])
    assert kept["near_duplicates"] >= {1000, 1003, 1004, None} and 1001 not in kept["near_duplicates"]
    hits = [(row, brute([row], [(1, passage)])[0]) for row in texts["near_duplicates"]]
    clear = [row for row, (_, n, hit, _) in hits if not hit or 20 * hit < n]
    assert sorted(clear, key=str) == sorted(texts["decontamination"], key=str)
    assert 1003 not in kept["decontamination"] and {1000, 1004, 1005, None} <= kept["decontamination"]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    own = bpe.encoder(bpe.multilingual(), bpe.public_tokenizers.PATTERN)
    want = sorted((str(x["doc_id"]), len(own.encode(x["text"])) // 4) for x in docs.collect())
    assert sorted((str(t["doc_id"]), t["n_tokens"]) for t in tokens) == want and all(len(t["ids"]) == t["n_tokens"] for t in tokens)


def test_run_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
