import html
import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwork.functions import fixed_values as fixed
from shelfwork.functions import task_text
from shelfwork.functions import text as T
from shelfwork.operators import vocab as V


def values(spark, texts, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


def test_merge_title_description(spark):
    rows = [("a", "b"), ("a", None), ("a", "a"), ("a", " ")]
    df = spark.createDataFrame(rows, "t string, d string")
    got = [r[0] for r in df.select(T.merge_title_description("t", "d")).collect()]
    assert got == ["a; b", "a;  ", "a", "a;  "]
    blank = [r[0] for r in df.select(T.merge_title_description("t", "d", on_equal="blank")).collect()]
    assert blank[2] == " "
    with pytest.raises(ValueError):
        T.merge_title_description("t", "d", on_equal="other")


def test_merge_parts(spark):
    rows = [("a", "b."), ("", "b"), ("a", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, d string")
    assert [r[0] for r in df.select(T.merge_parts("t", "d")).collect()] == ["a. b", "b", "a", ""]


def test_paths(spark):
    df = spark.createDataFrame([(7, 9)], "i bigint, p bigint")
    assert df.select(T.image_name("i", "p")).first()[0] == "image_7_product_9.jpg"
    assert df.select(T.image_candidates("i", "p")).first()[0] == ["image_7_product_9.jpg", "7.jpg", "image_7.jpg"]


def test_folder_name(spark):
    assert values(spark, ["a b/c", None, "ok-1_2"], T.folder_name) == ["a_b_c", "unknown", "ok-1_2"]


def test_mojibake_order(spark):
    broken = ["cafÃ©", "Â°", "lâ€™eau", None]
    assert values(spark, broken, T.fix_mojibake) == ["café", "°", "l'eau", ""]
    # a short entry comes before the longer one with the same start
    assert values(spark, ["â€\""], T.fix_mojibake) == ['""']
    assert values(spark, ["â€\""], lambda c: T.fix_mojibake(c, longest_first=True)) == ["-"]


def clean(text):
    if text is None or not text.strip():
        return ""
    for old, new in fixed.MOJIBAKE:
        text = text.replace(old, new)
    for pattern, new in (
        (fixed.TAGS, ""), (fixed.WEB_WORDS, ""), (fixed.EMAILS, ""), (fixed.ENTITIES, " "),
        (fixed.OUTSIDE_CHARSET, " "), (fixed.SPACES, " "),
    ):
        text = re.sub(pattern, new, text)
    return text.strip()


SAMPLES = [
    "<p>Un <b>très</b> bon &amp; beau www.site.com produit</p>", "mail me@x.org or http://a.b/c?d=1 now",
    "", None, "  ", "a\t\nb", "100% #1 * été Ÿ œ", "x@y", "no change here.",
]


def test_clean_text_equals_its_definition(spark):
    assert values(spark, SAMPLES, T.clean_text) == [clean(s) for s in SAMPLES]


def test_clean_text_twice_changes_nothing(spark):
    once = values(spark, SAMPLES, T.clean_text)
    assert values(spark, once, T.clean_text) == once


def model(text):
    text = "".join(c for c in unicodedata.normalize("NFD", text.lower().strip()) if unicodedata.category(c) != "Mn")
    text = re.sub(fixed.SPACED_MARKS, r" \1 ", text)
    text = re.sub(fixed.QUOTES_AND_SPACES, " ", text)
    return re.sub(fixed.OUTSIDE_MODEL_TEXT, " ", text)


def test_model_text_equals_its_definition(spark):
    samples = ["Été à Paris!", 'say "hi"; now', "5° (net) 3.5", " trim? ", "¿Qué?", "a_b-c"]
    assert values(spark, samples, T.model_text) == [model(s) for s in samples]


def test_accents(spark):
    samples = ["àéîõüçñ ÀÉ", "Ångström", "é", "ß œ ø", "ἄλφα", "Й"]
    full = ["".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn") for s in samples]
    assert values(spark, samples, T.strip_accents) == full


def test_html_to_text(spark):
    samples = ["<p>a<br>b</p>", "&lt;b&gt;x&lt;/b&gt;", "a &eacute; b", None, " plain "]
    assert values(spark, samples, task_text.html_to_text) == ["ab", "x", "a é b", None, "plain"]


@pytest.mark.parametrize("text", ["déjà vu", "œuvre", "prix 5 € – «bon»", "naïve ÀÉÔ", "plain"])
def test_fix_encoding_undoes_the_mistake(spark, text):
    def sloppy(b):
        out = ""
        for x in b:
            try:
                out += bytes([x]).decode("cp1252")
            except UnicodeDecodeError:
                out += chr(x)
        return out

    broken = sloppy(text.encode("utf-8"))
    assert values(spark, [broken, text, None], task_text.fix_encoding) == [text, text, None]


def test_fix_encoding_leaves_good_text(spark):
    good = ["CAFÉ»", "Été", "Â propos", "5 Å"]
    assert values(spark, good, task_text.fix_encoding) == good


def test_contractions(spark):
    samples = ["i can't've", "don’t you're", "it's o'clock", "none"]
    assert values(spark, samples, task_text.expand_contractions) == [
        "i cannot've", "do not you are", "it is of the clock", "none",
    ]
    longest = values(spark, samples[:1], lambda c: task_text.expand_contractions(c, longest_first=True))
    assert longest == ["i cannot have"]


def test_urls_and_emails(spark):
    samples = ["see http://a.com/x?y=1 now", "www.shop.fr ok", "ftp://1.2.3.4/f", "a.b@c.de x", "plain"]
    expected = [re.sub(fixed.WEB_ADDRESSES, "", re.sub(fixed.EMAILS, "", s)) for s in samples]
    assert values(spark, samples, lambda c: T.remove_web_addresses(T.remove_emails(c))) == expected


def test_letters_digits_punctuation(spark):
    assert values(spark, ["a1b22c"], T.split_letters_digits) == ["a 1 b 22 c"]
    assert values(spark, ["a!b,c'd's"], lambda c: T.remove_punctuation(T.remove_possessives(c))) == ["abcd"]


def test_word_counts(spark):
    samples = ["a b", "a  b", "", " a ", "a\tb\nc"]
    assert values(spark, samples, T.word_count) == [len(s.split(" ")) for s in samples]
    assert values(spark, samples, T.word_count_white) == [len(s.split()) for s in samples]


def test_sentences(spark):
    assert values(spark, ["A b. C!? D", "...", "", "x"], T.sentences) == [["A b.", "C!?", "D"], [], [], ["x"]]


def test_ngrams(spark):
    text = "añb\nc"
    for n in (2, 3, 4, 5, 6):
        assert values(spark, [text], lambda c, n=n: T.char_ngrams(c, n)) == [[text[i : i + n] for i in range(len(text) - n + 1)]]


def test_replies(spark):
    df = spark.createDataFrame([("Translation: a\nb  c", "x"), ("  ", "y"), ("English:", "z")], "r string, o string")
    assert [r[0] for r in df.select(T.clean_reply("r", "o")).collect()] == ["a b c", "y", "z"]


def test_numbered_replies(spark):
    replies = ["1. un\n2. deux\nsuite\n3) trois", "no number", "1. a\n1. b"]
    got = values(spark, replies, T.parse_numbered)
    assert {k: v.strip() for k, v in got[0].items()} == {"1": "un", "2": "deux\nsuite", "3": "trois"}
    assert got[1] == {}
    assert got[2]["1"].strip() == "b"
    assert values(spark, ["whole"], lambda c: T.parse_numbered(c, single=True)) == [{"1": "whole"}]
    inline = values(spark, ["1. un\n2. deux"], lambda c: T.parse_numbered(c, inline=True))
    assert inline == [{"1": "un", "2": "deux"}]


def test_glued_words(spark):
    counts = {"red": 50, "car": 40, "the": 90, "in": 80, "carin": 1, "forêt": 30, "noire": 20, "et": 60, "for": 70}
    table = spark.createDataFrame(list(counts.items()), "term string, n long")
    texts = ["theredcar in2", "Thecar", "forêt forêtnoire", "", None, "the\u00a0car  zzz", "x" * 3000, "ΣΑΣ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r["t"] for r in V.split_glued_words(df, "id", "t", table).orderBy("id").collect()]
    assert got[6].replace(" ", "") == "x" * 3000 and got[7] == "σας"
    assert got[:6] == ["the red car in2", "the car", "forêt forêt noire", "", None, "the car zzz"]


def test_long_words_are_words_too(spark):
    long = "rindfleischetikettierungsaufgaben"  # 33 letters
    table = spark.createDataFrame([(long, 40), (long[:24], 1), ("red", 50), ("rind", 9)], "term string, n long")
    texts = [long, f"red{long}", f"{long}red", long[:30], f"red{'q' * 40}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r["t"] for r in V.split_glued_words(df, "id", "t", table).orderBy("id").collect()]
    assert got == [long, f"red {long}", f"{long} red", f"{long[:24]} {long[24:30]}", f"red {'q' * 40}"]


@pytest.mark.parametrize("known", [0, 2, 100])
def test_glued_words_through_the_filter(spark, known):
    r = random.Random(6)
    counts = {"".join(r.choice("abcdé") for _ in range(r.randint(1, 5))): r.randint(1, 99) for _ in range(60)} | {"a" * 30: 400}
    table = spark.createDataFrame(list(counts.items()), "term string, n long")
    words = ["".join(r.choice(list(counts)) for _ in range(r.randint(1, 4))) for _ in range(40)] + ["zz" + "a" * 30 + "b", "q"]
    rows = [(i, " ".join(r.choices(words, k=9)) + " x1!") for i in range(30)] + [(None, words[0]), (3, words[1]), (40, None), (41, "")]
    got = V.split_glued_words(spark.createDataFrame(rows, "id int, t string"), "id", "t", table, known_terms=known).collect()
    total, pieces = sum(counts.values()), {}
    for w in words:
        own = [{"start": i, "size": len(t), "n": n} for t, n in counts.items() for i in range(len(w)) if w.startswith(t, i)]
        pieces[w] = V.best_split(w, own, total)
    want = [(k, t and " ".join(pieces.get(w, w) for w in t.split(" "))) for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_terms_meet_ends_in_their_ranges():
    ends = sorted(["a", "a", "a", "ab", "abc", "b", "ba", "ca", "cab"] + ["e"] * 9)
    bounds = ["a", "ab", "c", "e", "e", "e"]
    dealt = {(t, V.range_of_end(t, i, bounds)) for i, t in enumerate(ends)}
    assert {at for t, at in dealt if t == "e"} == {4, 5, 6}  # a frequent end is dealt over several ranges
    for term in ("a", "ab", "abc", "b", "c", "e", "z", "0"):
        places = V.ranges_of_term(term, bounds)
        assert len(places) == len(set(places)) and all(at in places for t, at in dealt if t.startswith(term))


def test_no_filter_of_terms_goes_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(V, "bloom", None)  # its size went with the number of terms
    monkeypatch.setattr(V, "RANGE_ENDS", 50)  # many ranges
    r = random.Random(8)
    counts = {"".join(r.choice("abé") for _ in range(r.randint(1, 6))): r.randint(1, 99) for _ in range(300)}
    counts |= {("ab" * 20)[:n]: n for n in (23, 24, 25, 31)} | {"a" * 24 + end: 7 for end in "bcd"}
    tokens = list({"".join(r.choice(list(counts)) for _ in range(r.randint(1, 4))) for _ in range(200)} | {"q" + "ab" * 25, "a" * 30 + "d"})
    rows = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = V.word_splits(rows, spark.createDataFrame(list(counts.items()), "term string, n long"), known_terms=40).collect()
    total, want = sum(counts.values()), {}
    for w in tokens:
        own = [{"start": i, "size": len(t), "n": n} for t, n in counts.items() for i in range(len(w)) if w.startswith(t, i)]
        want[w] = V.best_split(w, own, total)
    assert sorted(map(tuple, got)) == sorted((w, s) for w, s in want.items() if w != s)


def test_the_filter_holds_what_it_was_made_of(spark):
    terms = [f"té{i}" for i in range(3000)] + ["", "\U0001f600"]
    bits = V.bloom(spark.createDataFrame([(t,) for t in terms], "t string"), "t", len(terms)).tobytes()
    assert all(V.may_hold(bits, t) for t in terms) and sum(V.may_hold(bits, f"other{i}") for i in range(3000)) < 60


def test_best_split_is_the_best_of_all(spark):
    counts = {"a": 5, "ab": 9, "b": 2, "ba": 4, "aba": 1}
    known = lambda t: [{"start": i, "size": j - i, "n": counts[t[i:j]]} for i in range(len(t)) for j in range(i + 1, len(t) + 1) if t[i:j] in counts]

    def score(pieces):
        return sum(math.log10(counts[p] / 21) if p in counts else math.log10(10 / 21) - len(p) for p in pieces)

    def ways(t):
        return [[]] if not t else [[t[:i], *w] for i in range(1, len(t) + 1) for w in ways(t[i:])]

    for token in ("abab", "aabba", "babab", "cabc"):
        got = V.best_split(token, known(token), 21).split(" ")
        assert score(got) == pytest.approx(max(map(score, ways(token))))


def test_white_space_of_all_scripts(spark):
    assert values(spark, ["contact a@b.fr\u00a0chaise rouge", "voir www.x.fr\u202fici"], T.clean_text) == ["contact chaise rouge", "voir ici"]
    assert values(spark, ["\u00a0a b\u3000"], T.strip) == ["a b"]
    assert values(spark, ["a\u00a0b c"], T.word_count_white) == [3]


def test_script_and_style_are_not_text(spark):
    page = "<style>p{color:red}</style><script>var a=1;</script><!-- no --><p>Hi</p>"
    assert values(spark, [page], task_text.html_to_text) == ["Hi"]


def test_repair_of_other_scripts(spark):
    samples = ["łódź ęą", "při českých", "Türkçe ığş", "αβγ", "привет", "« CAFÉ»", "Ñ»", "É»", "œuvre"]
    latin = [s.encode().decode("latin-1") for s in samples[:5]]
    assert values(spark, latin, task_text.fix_encoding) == samples[:5]
    assert values(spark, ["Å‚Ä™"], task_text.fix_encoding) == ["łę"]
    assert values(spark, samples[5:8], task_text.fix_encoding) == samples[5:8]
    nested = "é"
    for _ in range(5):
        nested = nested.encode().decode("latin-1")
    assert values(spark, [nested], task_text.fix_encoding) == ["é"]


def test_baseline_chain(spark):
    got = values(spark, ["i don't  like a@b.c http://x.com/y John's 3kg!"], task_text.baseline_text)
    assert got == ["i do not like John 3 kg"]


def test_unescape_is_the_standard_one(spark):
    assert values(spark, ["&copy; &#39;"], task_text.html_to_text) == [html.unescape("&copy; &#39;")]


def test_the_most_frequent_terms_are_cut_at_a_count(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 7), ("e", 2), ("f", 1)], "term string, n long").repartition(3)
    for terms, names, cut in ((0, "", 10), (1, "a", 9), (3, "a", 9), (4, "abcd", 7), (5, "abcde", 2), (99, "abcdef", 1)):
        top, least = V.most_frequent(counts, terms)
        assert ("".join(sorted(top["term"].to_pylist())), least) == (names, cut)
    assert V.most_frequent(counts.limit(0), 5)[0].num_rows == 0


def test_texts_go_to_python_in_small_batches(spark):
    from shelfwork.operators import enrich as L
    from shelfwork.operators import outliers as O

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    rows = spark.createDataFrame([(1, "en", "one two. three")], "id long, lang string, t string")
    uses = [
        lambda: rows.select(task_text.fix_encoding("t")), lambda: rows.select(task_text.html_to_text("t")), lambda: V.language_profiles(rows, "lang", "t"),
        lambda: V.detect_language(rows, "id", "t", rows.selectExpr("lang", "'one' AS gram", "1L AS share"), "lang"),
        lambda: L.enrich_rows(rows, "id", "t", list), lambda: O.similar_sentences(rows, "id", "t"),
        lambda: V.split_glued_words(rows, "id", "t", rows.selectExpr("'one' AS term", "1L AS n")),
    ]
    try:
        for use in uses:
            spark.conf.set(name, "10000")
            use()
            assert int(spark.conf.get(name)) == 1000
        spark.conf.set(name, "64")  # a smaller size stays
        uses[0]()
        assert spark.conf.get(name) == "64"
    finally:
        spark.conf.set(name, was)


def test_profiles_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    rows = [(i, ["a", "b", None][i % 3], None if i % 17 == 0 else f"some words {i * i} {chr(0x1F600 + i % 5)}" + "xy" * (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows + [(200, "a", "zz"), (201, "c", "")], "id long, lang string, t string").repartition(3)
    counts = {}
    for _, lang, t in rows:
        for k in range(len(t or "") - 2):
            counts.setdefault(lang, Counter())[t[k : k + 3]] += 1
    want = set()
    for lang, own in counts.items():
        total = sum(own.values())
        want |= {(lang, g, n * 1_000_000 // total) for g, n in sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[:40]}
    for letters, held in ((1 << 20, 1 << 20), (50, 100), (1, 1)):
        monkeypatch.setattr(V, "LETTERS", letters)
        monkeypatch.setattr(V, "HELD_GRAMS", held)
        assert {tuple(r) for r in V.language_profiles(df, "lang", "t", 40).collect()} == want
