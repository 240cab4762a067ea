"""The encoder against the reference library's own encoding."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from upcurrent.llm import tokens
from upcurrent.llm.queries import TOKENIZERS

tiktoken = pytest.importorskip("tiktoken")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def bpe():
    return tokens.SpeculativeBpe(tokens.load_ranks(VOCABULARY))


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(VOCABULARY), special_tokens={})


CASES = [None, "", " ", "\n\n \t", "hello world", "It's 3.14%…", "<|endoftext|>", "日本語テキスト", "🚀🚀👩‍👩‍👧", "\x00\x01", "a\r\nb", "x" * 5000, "ab" * 3000, " " * 3000, "naïve café", "ﬁﬂ", "\u202e\u0301", "1" * 4000]


def test_cases(bpe, exact):
    assert bpe.encode_batch(CASES) == [exact.encode_ordinary(t) if t else [] for t in CASES]
    assert bpe.encode_batch(CASES[::-1]) == [exact.encode_ordinary(t) if t else [] for t in CASES[::-1]]
    assert not bpe.fits.all() and bpe.fits.any()  # some pairs were refused, so exact merging had work


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(bpe, exact, texts):
    assert bpe.encode_batch(texts) == [exact.encode_ordinary(t) for t in texts]


def test_merge_is_exact_and_fast(bpe, exact):
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40)))
        assert bpe.merge(w.encode()) == exact.encode_ordinary(w)


def test_over_a_table(spark, rows, exact, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    data = [(1, "some words"), (2, None), (3, ""), (3, "some words"), (4, "z" * 70 + " end")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'x' AS ids")
    assert rows(tokens.encode(df, VOCABULARY)) == sorted(((i, exact.encode_ordinary(t) if t else []) for i, t in data), key=lambda r: (str(r[0]), str(r[1])))
    assert tokens.encode(df.limit(0), VOCABULARY).count() == 0


def test_pair_memory_is_bounded(exact, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PAIRS", 50)
    rng, small = random.Random(2), tokens.SpeculativeBpe(tokens.load_ranks(VOCABULARY))
    for _ in range(20):
        texts = ["".join(rng.choice("abcdefgh xyz") for _ in range(60)) for _ in range(5)]
        before = len(small.pairs)
        assert small.encode_batch(texts) == [exact.encode_ordinary(t) for t in texts]
        assert (small.pairs[:-1] < small.pairs[1:]).all() and (before <= 50 or len(small.pairs) < before + 300)
