import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwork.llm import bpe

OWN = bpe.Encoder(bpe.multilingual(), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


def test_every_token_is_reached_by_merging():
    assert all(OWN.merge(token) == [rank] for token, rank in OWN.ranks.items())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert OWN.decode(OWN.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aabetthr é_ſ漢!", max_size=200))
def test_as_the_library_on_long_words(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000, "ab" * 2000, "=" * 1500, "漢" * 900, "x\n" * 2000, "ſ" * 700])
def test_runs(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeth", min_size=1, max_size=30), st.text(alphabet="abcdeth", min_size=1, max_size=30))
def test_halves_join(left, right):
    a, b = OWN.merge(left.encode()), OWN.merge(right.encode())
    assert OWN.join(a, b) == OWN.merge((left + right).encode())


def test_both_merges_agree():
    for text in (b"the thing in the that" * 3, b"aaaaaaabbbbbbaaaa", bytes(range(256))):
        assert OWN._merge_long(text) == bpe.Encoder.merge(OWN, text[:48]) if len(text) <= 48 else OWN._merge_long(text)


def test_remembered_is_bounded():
    made = bpe.Remembered(lambda k: [k], 10)
    for k in range(1000):
        assert made[k] == [k]
    assert len(made) <= 10 and len(made.old) <= 10


def test_rows(frame):
    texts = ["The cat", None, "", "été <|endoftext|>", "The cat", "word " * 30_000]
    rows = [(i if i else None, t, "x", 5) for i, t in enumerate(texts)]
    got = bpe.encode(frame("doc_id long, text string, ids string, n_tokens int", rows), bpe.multilingual()).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"] or 0] or ""
        want = LIBRARY.encode_ordinary(text)
        assert r["ids"] == want and r["n_tokens"] == len(want) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode(frame("doc_id long, text string", []), bpe.multilingual()).collect() == []
