"""Truncated values: held-out accuracy on texts cut by the test, and the parts by themselves."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from upcurrent.llm import truncation as tr

NOUNS = ["build", "worker", "cache", "registry", "lockfile", "branch", "runner", "team", "parser", "mirror"]
VERBS = ["updated", "removed", "checked", "renamed", "pinned", "reverted", "merged", "measured"]
ENDS = ["Thanks for reading", "Refs #{}", "More to come...", "cc the {} owners"]


def sentence(rng):
    a, b, c = rng.sample(NOUNS, 3)
    return rng.choice([f"The {a} was {rng.choice(VERBS)} by the {b} because the {c} kept failing.", f"We {rng.choice(VERBS)} {rng.randint(2, 99)} entries of the {a} in version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}.", f"Please check the {a} before the {b} is {rng.choice(VERBS)}!"])


def whole(rng):
    out = " ".join(sentence(rng) for _ in range(rng.randint(2, 8)))
    return out + "\n\n" + rng.choice(ENDS).format(rng.choice(NOUNS)) if rng.random() < 0.3 else out


def corpus(n=1500, seed=1):
    rng, data, truth = random.Random(seed), [], set()
    for k in range(n):
        t, source = whole(rng), rng.choice(["full", "short", None])
        if source == "short" and len(t) > 300:
            t = t[:300]
            truth.add(k)
        elif rng.random() < 0.08 and len(t) > 60:
            t = t[: rng.randint(40, len(t) - 12)]
            if t[-1] in ".!":
                t = t[:-2]
            t += rng.choice(["", "", "…", "...", " [truncated]", "[...]"])
            truth.add(k)
        data.append((k, source, t, None))
    return data, truth


SCHEMA = "id bigint, fetched_via string, body string, commit_messages_concat string"


def test_held_out_accuracy(spark, tmp_path):
    data, truth = corpus()
    data += [(9001, "full", None, ""), (9002, None, "  ", "\n"), (9003, "full", "", None)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("field", F.lit("clash")).repartition(4)
    measured = tr.measure(df, "id", "fetched_via", tr.FIELDS, str(tmp_path / "m"))
    fitted = tr.fit(measured)
    assert [(k, [x[:2] for x in v]) for k, v in fitted.limits.items()] == [(("short", "body"), [("chars", 300)])]
    values = tr.score(measured, pickle.loads(pickle.dumps(fitted)))
    got = {r.id for r in values.where("cut").collect()}
    assert len(got & truth) / len(truth) >= 0.95 and len(got & truth) / len(got) >= 0.95
    assert {r.id for r in tr.truncated(df).collect()} == got
    # Contexts alone, lengths left out of everything.
    alone = {r.id for r in tr.truncated(df, lengths=False).collect()}
    assert len(alone & truth) / len(truth) >= 0.8 and len(alone & truth) / len(alone) >= 0.9
    report = {(r.source, r.field): r for r in tr.truncation_report(values).collect()}
    assert report["short", "body"].rate > report["full", "body"].rate and ("full", "commit_messages_concat") not in report
    assert sum(r.n_cut for r in report.values()) == len(got)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "x", "One whole sentence.", None)], SCHEMA)
    assert tr.truncated(df.limit(0)).count() == 0
    assert tr.truncated(df).count() <= 1


@pytest.mark.parametrize(("text", "short"), [("abc…", "abc"), ("abc...", "abc"), ("abc [truncated]", "abc"), ("abc[...]", "abc"), ("abc (message clipped)", "abc"), ("abc\n[text truncated at 500 characters]", "abc")])
def test_marks(text, short):
    assert tr.stripped(text) == (short, True)


@pytest.mark.parametrize("text", ["done.", "see [more work]x", "etc", "a (b)", ""])
def test_no_marks(text):
    assert tr.stripped(text) == (text, False)


def test_normal_and_limits():
    assert tr.normal("From 1.2.3 to 10.4 in 2024\r\n") == "from \x01 to 0.0 in \x02\n"
    at = lambda t, limits: tr.odds_at(len(t), len(t.encode()), limits)
    assert at("é" * 10, [("bytes", 20, 9.0)]) == at("é" * 9 + "a", [("bytes", 20, 9.0)]) == 9.0
    assert at("é" * 10, [("chars", 20, 9.0)]) == tr.CUT_SHARE and at("x" * 20, [("chars", 20, 3.0), ("bytes", 20, 9.0)]) == 9.0


@pytest.mark.parametrize(("text", "lang"), [("the update is for this", "en"), ("Die Version ist nicht neu und der Test", "de"), ("Привет, это проверка", "cyrillic"), ("ビルド時間は短くなりました", "kana"), ("升级版本修复错误", "han"), ("x", "latin"), ("", "latin"), ("¡¡¡¡", "latin")])
def test_language(text, lang):
    assert tr.language(text) == lang


def test_every_limit_of_a_source_is_found(spark, tmp_path):
    """A source whose limit was raised, with marks behind the cut and longer values of another kind."""
    rng, data = random.Random(5), []
    for k in range(1500):
        t = " ".join(sentence(rng) for _ in range(14))
        data.append((k, "s", t[:200] if k % 3 == 0 else t[:420] + "…" if k % 3 == 1 else t, None))
    same = [(5000 + k, "s", "x" * 40 + " template body number " + str(k % 7), None) for k in range(300)]
    measured = tr.measure(spark.createDataFrame(data + same, SCHEMA), "id", "fetched_via", tr.FIELDS, str(tmp_path / "m"))
    limits = tr.length_odds(measured)
    got = {x[:2] for x in limits["s", "body"]}
    assert {("chars", 200), ("chars", 420)} <= got <= {("chars", 200), ("chars", 419), ("chars", 420)}  # blanks before a mark go with it


def test_noise_leaves_full_tables_to_shorter_contexts():
    """Tables so small that every cell holds many contexts must not make the long contexts speak."""
    data = [t for _, _, t, _ in corpus(1500)[0]]
    scores = {}
    for extra in (0, -9):
        inside, ends = tr.tables(extra), tr.tables(extra)
        tr.add_inside(inside, [tr.normal(t) for t in data], extra)
        for k, cell in enumerate(tr.end_cells([tr.end_of(tr.normal(t)) for t in data], extra)):
            np.add.at(ends[k], cell, 1)
        model = tr.Model(inside, ends, tr.tables(extra), extra=extra)
        tails = ["because the cache kept failing.", "because the cache kept", "please check the runner bef"]
        scores[extra] = model.score(tails, np.zeros(3, bool))[0]
    for s in scores.values():
        assert s[0] > s[1] + 2 and s[0] > s[2] + 2


def test_counts_do_not_depend_on_batching():
    data = [t for _, _, t, _ in corpus(60)[0]]
    a, b = tr.tables(), tr.tables()
    tr.add_inside(a, data)
    for t in data:
        tr.add_inside(b, [t])
    assert all((x == y).all() for x, y in zip(a, b))
    assert int(a[0].sum()) == sum(len(t) - 1 for t in data)


def test_very_long_value():
    short, mark = tr.stripped("word " * 400000 + "end…")
    assert mark and tr.end_of(tr.normal(short)) == "w\x03" + ("word " * 10 + "end")[-tr.TAIL :]
    assert tr.end_of("") == "\x04" and tr.end_of("- item\n") == "- item\n"
