"""Leaked passages against a search of every window."""

import random

from pyspark.sql import functions as F

from upcurrent.llm import leakage
from upcurrent.llm.leakage import ItemIndex, chained, words

RNG = random.Random(4)
VOCABULARY = [f"w{RNG.randint(0, 10**6)}" for _ in range(400)]


def text(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(k, " ".join(text(RNG.randint(15, 90)))) for k in range(30)] + [(98, None), (99, "too short"), (100, "")]


def place(passage, rng):
    return " ".join([*text(rng.randint(0, 120), rng), *passage, *text(rng.randint(0, 120), rng)])


def changed(passage, rate, rng):
    """Every rate-th word replaced or left out."""
    out = list(passage)
    for i in range(len(out) - 2, 0, -rate):
        if rng.random() < 0.5:
            out[i] = "other"
        else:
            del out[i]
    return out


def test_words_ignore_markup_case_and_punctuation():
    assert words('<p class="x">The **Quick**, [brown](http://a.b/c) fox&nbsp;said: “Hi!” 1.2.3</p>\n> -- yes it&#39;s \\emph{so}') == ["the", "quick", "brown", "fox", "said", "hi", "123", "yes", "its", "so"]


def test_planted_passages_are_found():
    rng, index = random.Random(7), ItemIndex(ITEMS)
    for _ in range(300):
        k = rng.randrange(30)
        ws = ITEMS[k][1].split()
        n = rng.randint(15, len(ws))
        s = rng.randint(0, len(ws) - n)
        whole = ws[s : s + n]
        assert k in index.find(place(whole, rng))
        if n >= 24:
            assert k in index.find(place(changed(whole, 7, rng), rng))
        assert k in index.find(place([w.upper() + "," for w in whole], rng).replace(" ", "\r\n> "))


def test_short_or_broken_passages_are_not():
    rng, index = random.Random(8), ItemIndex(ITEMS)
    for _ in range(200):
        k = rng.randrange(30)
        ws = ITEMS[k][1].split()
        assert k not in index.find(place(ws[:13], rng))
        assert k not in index.find(place(changed(ws, 3, rng), rng))


def test_same_as_brute_force():
    rng, index = random.Random(9), ItemIndex(ITEMS)
    for _ in range(150):
        parts = []
        for _ in range(3):
            ws = ITEMS[rng.randrange(30)][1].split()
            s = rng.randint(0, max(0, len(ws) - 14))
            parts += changed(ws[s : s + rng.randint(8, 30)], rng.choice([3, 5, 7, 9, 50]), rng) + text(rng.randint(0, 10), rng)
        coded = [index.vocabulary.get(w, 0) for w in parts]
        brute = {index.ids[k] for k, p in enumerate(index.places) if chained(coded, p, 15, 6)}
        assert set(index.find(" ".join(parts))) == brute


def test_partitions_keep_the_miss_small():
    t, q = leakage.least_overlap(), leakage.PIECE - leakage.SHINGLE + 1
    for size in leakage.SIZES:
        j = t / max(q + size - t, q)
        assert (1 - j) ** leakage.rows_needed(size) <= leakage.MISS


def test_over_tables(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(1, ITEMS[3][1]), (2, None), (3, ""), (4, ITEMS[3][1] + " " + ITEMS[5][1]), (4, ITEMS[3][1]), (5, "word " * 20000)], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("suite", F.lit("s"))
    expect = [(1, 3), (4, 3), (4, 3), (4, 5)]
    assert rows(leakage.leaks(docs, items)) == expect
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 4)
    one_pass = leakage.leaks(docs, items)
    assert rows(one_pass) == expect and one_pass._jdf.queryExecution().toString().count("Physical Plan") == 1 and "Union" not in one_pass._jdf.queryExecution().toString()
    monkeypatch.setattr(leakage, "ITEM_BYTES", 3000)
    several = leakage.leaks(docs, items)
    assert rows(several) == expect and "Union" in several._jdf.queryExecution().toString()
    assert rows(leakage.leaks(docs.limit(0), items)) == [] == rows(leakage.leaks(docs, items.limit(0)))
    report = rows(leakage.leak_report(leakage.leaks(docs, items), items))
    assert ("s", 3, 3) in report and len(report) == len(ITEMS) and ("s", 98, 0) in report


def meets_the_rule(doc, item, least=15, slack=6):
    """Independent of chained: over all pairs of equal words, every (words, errors) that no other one beats, without bounds."""
    chains = []
    for i, w in enumerate(doc):
        for j in item.get(w, ()):
            every = {(1, 0)}
            for i0, j0, front in chains:
                if i0 < i and j0 < j:
                    lost = max(i - i0, j - j0) - 1
                    every |= {(m + 1, e + lost) for m, e in front}
            front, best = [], 0
            for m, e in sorted(every, key=lambda c: (c[1], -c[0])):
                if m > best:
                    front.append((m, e))
                    best = m
            if any(m >= least and e * slack <= m + e for m, e in front):
                return True
            chains.append((i, j, front))
    return False


def found_in(passage):
    item = " ".join(f"a{k}" for k in range(40))
    return ItemIndex([(1, item)]).find(" ".join([f"x{k}" for k in range(33)] + passage + [f"y{k}" for k in range(50)])) == [1]


def test_long_gaps_and_single_words():
    a = [f"a{k}" for k in range(40)]
    assert found_in(a[:10] + a[14:24]) and found_in(a[:10] + ["o"] * 4 + a[14:24])
    assert not found_in(a[:10] + a[15:25]) and not found_in(a[:10] + a[14:23])
    assert found_in(a[:6] + ["o"] + a[7:8] + ["o"] + a[9:17])
    assert found_in(a[:7] + ["o"] + a[8:10] + ["o"] + a[11:13] + ["o"] + a[14:16] + ["o"] + a[17:24])
    loop = " ".join(["b c d"] * 5)
    assert ItemIndex([(1, loop)]).find("before " + loop + " after") == [1]


def test_chained_same_as_independent_program():
    rng, met = random.Random(11), 0
    for _ in range(1500):
        ws = list(range(1, 41)) if rng.random() < 0.5 else [rng.randint(1, 25) for _ in range(40)]
        item = {}
        for j, w in enumerate(ws):
            item.setdefault(w, []).append(j)
        doc, rate = [], rng.uniform(0.05, 0.3)
        for w in ws:
            doc += [w] if rng.random() > rate else rng.choice([[], [0], [0, 0], [0, w], [rng.randint(1, 25)]])
        start = rng.randint(0, 20)
        doc = doc[start : start + rng.randint(14, 40)]
        assert chained(doc, item, 15, 6) == meets_the_rule(doc, item)
        met += meets_the_rule(doc, item)
    assert 300 < met < 1200


def test_found_same_as_independent_program():
    rng, index = random.Random(12), ItemIndex(ITEMS)
    for _ in range(100):
        ws = ITEMS[rng.randrange(30)][1].split()
        s = rng.randint(0, max(0, len(ws) - 24))
        part = [w if rng.random() > 0.17 else "other" for w in ws[s : s + rng.randint(15, 40)]]
        parts = text(rng.randint(0, 40), rng) + part + text(rng.randint(0, 40), rng)
        coded = [index.vocabulary.get(w, 0) for w in parts]
        assert set(index.find(" ".join(parts))) == {index.ids[k] for k, p in enumerate(index.places) if meets_the_rule(coded, p)}
