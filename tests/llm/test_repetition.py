"""Repetition against a plain count of repeated n-grams."""

import random

import pytest
from pyspark.sql import functions as F

from upcurrent.llm import repetition as rp


def brute(text, n=rp.NGRAM):
    ws = rp._TOKEN.findall(text)
    norm = [rp._NUMBER.sub("0", w.casefold()) for w in ws]
    seen, covered = set(), [False] * len(ws)
    for i in range(len(ws) - n + 1):
        g = tuple(norm[i : i + n])
        if g in seen:
            covered[i : i + n] = [True] * n
        seen.add(g)
    total = sum(map(len, ws))
    return sum(len(w) for w, c in zip(ws, covered) if c) / total if total else 0.0


def sentence(rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 12))) + "."


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        (None, 0, 0),
        ("", 0, 0),
        ("  \n", 0, 0),
        ("one two", 0, 0),
        ("spam " * 50, 0.9, 1),
        ("Step 1 of 9 took 12 s. " * 20, 0.9, 1),
        ("ALL the same Words here.\n\nall THE   same words here.", 0.4, 0.6),
        ("警告は残り 8 件です。" * 10, 0.8, 1),
        ("x" * 100000, 0, 0),
    ],
)
def test_share(text, low, high):
    assert low <= rp.share(text) <= high


def test_share_is_the_plain_count():
    rng = random.Random(3)
    for _ in range(100):
        parts = [sentence(rng) for _ in range(rng.randint(1, 6))]
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 15)))
        assert rp.share(text) == pytest.approx(brute(text))


def test_every_heavy_document_passes_the_ratio(spark, rows):
    rng = random.Random(5)
    data = [(k, " ".join(sentence(rng) for _ in range(12))) for k in range(150)]
    for k in range(150, 180):
        own = [sentence(rng) for _ in range(10)]
        n = rng.randint(1, 10)
        data.append((k, " ".join(own[: 10 - n // 2] + own[:n] * rng.randint(1, 3))))
    data += [(500, None), (501, ""), (502, "short")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("share", F.lit("clash"))
    out = {r.doc_id: r for r in rp.repetition(df).collect()}
    assert len(out) == len(data)
    truth = {k: brute(t) if t else 0.0 for k, t in data}
    assert {k for k, r in out.items() if r["share"] >= rp.CASE_SHARE} == {k for k, s in truth.items() if s >= rp.CASE_SHARE}
    assert all(r["llr"] == 0 == r["share"] for k, r in out.items() if k >= 500)
    assert rp.repetition(df.limit(0)).count() == 0


def test_share_of_every_document_is_measured(spark):
    rng = random.Random(6)
    data = [(k, " ".join(sentence(rng) for _ in range(12))) for k in range(100)]
    for k in range(100, 140):
        own = [sentence(rng) for _ in range(30)]
        data.append((k, " ".join(own + own[: rng.randint(1, 3)])))
    out = {r.doc_id: r for r in rp.repetition(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    truth = {k: brute(t) for k, t in data}
    assert any(s > 0 and out[k].llr <= 0 for k, s in truth.items())
    assert {k: r["share"] for k, r in out.items()} == pytest.approx(truth)


def test_heavy_documents_are_found_whatever_the_ratio(spark):
    """All documents repeat: the target is empty, and the ratio says nothing."""
    rng = random.Random(7)
    data = []
    for k in range(60):
        own = " ".join(sentence(rng) for _ in range(6))
        data.append((k, " ".join([own] * rng.choice([2, 2, 2, 9]))))
    out = rp.repetition(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert any(r.llr <= 0 for r in out)
    assert {r.doc_id for r in out if r["share"] >= rp.CASE_SHARE} == {k for k, t in data if brute(t) >= rp.CASE_SHARE} == set(range(60))
