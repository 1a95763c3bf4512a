import random

import pytest
from pyspark.sql import functions as F

from factmill.llm import spans
from factmill.llm.spans import _repeats, all_amounts, maximal_repeats, shared_amounts, shared_span_pairs

SMALL = {"least": 30, "block": 4, "gram": 16}


def _brute(texts, least):
    grams = {}
    for d, t in texts:
        for i in range(len(t or "") - least + 1):
            grams.setdefault(t[i : i + least], set()).add(d)
    return sorted({(a, b) for ds in grams.values() for a in ds for b in ds if a < b})


def _texts(seed, alphabet="abcdefgh \n", n=40):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    pool = [word(k) for k in (29, 30, 31, 33, 34, 45, 80)] + ["=" * 60, "ab" * 40]
    out = []
    for d in range(n):
        parts = [r.choice(pool) if r.random() < 0.35 else word(r.randrange(5, 60)) for _ in range(r.randrange(0, 5))]
        out.append((d, "".join(parts)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pairs_are_those_of_brute_force(spark, rows, seed):
    texts = _texts(seed) + [(100, None), (101, ""), (102, "x" * 29), (103, "é日\U0001f600" * 20), (104, "zz" + "é日\U0001f600" * 15)]
    df = spark.createDataFrame([(d, t, "c", "c") for d, t in texts], "doc_id long, text string, gram string, entry string")
    assert rows(shared_span_pairs(df, **SMALL)) == sorted(_brute(texts, 30), key=str)


@pytest.mark.parametrize("share", [2, 30])
def test_hot_and_cold_grams_give_the_same(spark, rows, monkeypatch, share):
    monkeypatch.setattr("factmill.llm.spans.HOT_SHARE", share)
    texts = _texts(21)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert rows(shared_span_pairs(df, **SMALL)) == sorted(_brute(texts, 30), key=str)


def test_hot_passage_copies_and_repeated_rows(spark, rows):
    r = random.Random(1)
    notice = "".join(r.choice("abcdefghij ") for _ in range(35))
    copy = "".join(r.choice("klmnop") for _ in range(90))
    texts = [(i, "".join(r.choice("qrstuv") for _ in range(40)) + notice) for i in range(25)] + [(50, copy), (51, copy), (52, copy[3:])]
    df = spark.createDataFrame(texts + [texts[0]], "doc_id long, text string")
    assert rows(shared_span_pairs(df, **SMALL)) == sorted(_brute(texts, 30), key=str)


def test_a_boilerplate_just_too_short_pairs_nothing(spark):
    r = random.Random(2)
    short = "".join(r.choice("abcdefghij ") for _ in range(29))
    texts = [(i, "".join(r.choice("qrstuv") for _ in range(30)) + chr(0x4E00 + i) + short + chr(0x5E00 + i) + "".join(r.choice("klmnop") for _ in range(30))) for i in range(30)]
    assert shared_span_pairs(spark.createDataFrame(texts, "doc_id long, text string"), **SMALL).collect() == []


def test_nothing(spark):
    assert shared_span_pairs(spark.createDataFrame([], "doc_id long, text string"), **SMALL).collect() == []
    with pytest.raises(ValueError):
        shared_span_pairs(spark.createDataFrame([], "doc_id long, text string"), least=10, block=20)


def _maximal(a, b, least):
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if (i and j and a[i - 1] == b[j - 1]) or a[i] != b[j]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                out.add((i, j, n))
    return sorted(out)


def test_repeats_are_maximal():
    r = random.Random(9)
    for _ in range(150):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(5, 60))) for _ in range(2))
        assert _repeats(a, b, 6) == _maximal(a, b, 6), (a, b)
    assert _repeats("x" * 200, "y" + "x" * 150, 100)[0][2] >= 100


def test_shared_amounts(spark):
    texts = _texts(11, n=25)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.doc_id: (x.shared_chars, x.partners) for x in shared_amounts(df, maximal_repeats(df, **SMALL)).collect()}
    text = dict(texts)
    want = {}
    for d, t in texts:
        cover, others = set(), set()
        for e, u in texts:
            if e != d:
                for i in range(len(t) - 29):
                    if t[i : i + 30] in u:
                        cover.update(range(i, i + 30))
                        others.add(e)
        if cover:
            want[d] = (len(cover), len(others))
    assert got == want and text


def test_one_very_long_text(spark, rows):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long[200_000:200_240]), (3, long[5:204])], "doc_id long, text string")
    assert rows(shared_span_pairs(df.withColumn("x", F.lit(1)))) == [(1, 2)]


def test_amounts_have_a_row_for_every_document(spark, rows):
    same = "the same passage of a mail, word for word" * 2
    df = spark.createDataFrame([(1, same), (2, "x" + same), (3, "nothing in common with the others at all, nowhere"), (4, None), (5, ""), (6, "short")], "doc_id long, text string")
    got = rows(all_amounts(df, maximal_repeats(df, **SMALL)))
    assert got == [(1, len(same), len(same), 1), (2, len(same) + 1, len(same), 1), (3, 49, 0, 0), (4, None, 0, 0), (5, 0, 0, 0), (6, 5, 0, 0)]


def test_hot_entries_are_shared_out(spark, rows, monkeypatch):
    monkeypatch.setattr(spans, "HOT_ENTRY", 2)
    shared = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(230))
    texts = [(i, f"{i} " * (i % 5) + shared + f" {i}") for i in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(spans.shared_span_pairs(df)) == sorted([(a, b) for a in range(12) for b in range(a + 1, 12)], key=str)
