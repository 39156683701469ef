import random
import re

import pytest

from veriframe.operators import phrases
from veriframe.session import cut_lineage


def squeezed(s):
    return " ".join(re.split(r"\s+", s.lower())).strip()


def stands(quote, text, gaps):
    """The fragments of the quote in order, each found behind the one before."""
    frags = [f for f in map(squeezed, re.split(phrases.ELLIPSIS, quote) if gaps else [quote]) if f]
    at, t = 0, squeezed(text)
    for f in frags:
        i = t.find(f, at)
        if i < 0:
            return False
        at = i + len(f)
    return bool(frags)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["the", "them", "other", "a", "aa", "aaa", "stone", "river-bed", "é", "x.y", "theory", "of", "bath"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", None, "  \n ", "the\n\nOther  stone", "aaaa" * 9]
    quotes = []
    for t in texts[:60]:
        w = t.split()
        i = rng.randrange(len(w))
        part = " ".join(w[i:i + rng.randrange(1, 7)])
        quotes += [part, part[1:], part[:-1], part + " unseen", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))]
        j = rng.randrange(i, len(w))
        quotes += [f"{part} ... {' '.join(w[j:j + 2])}", f"{' '.join(w[j:j + 1])}[…] {part}", f"{w[0]}…{w[-1]}…"]
    return texts, [*quotes, "a", "aa…aa…aa", "the ... the ... the", "…", "", None, "th", "e o", "THE\tother stone"]


@pytest.mark.parametrize("gaps", [False, True])
def test_equals_scan(spark, corpus, gaps):
    texts, quotes = corpus
    dd = spark.createDataFrame(list(enumerate(texts)), "d int, word string")
    qq = spark.createDataFrame(list(enumerate(quotes)), "q int, part string")
    got = [(r.q, r.d) for r in phrases.locate(qq, "q", "part", dd, "d", "word", gaps).collect()]
    want = {(i, j) for i, q in enumerate(quotes) if q is not None for j, t in enumerate(texts) if t is not None and stands(q, t, gaps)}
    assert len(got) == len(set(got)) and set(got) == want
    assert {i for i, _ in want} >= {quotes.index(q) for q in ("a", "th", "e o", "THE\tother stone")}


def test_empty_tables(spark):
    dd, qq = spark.createDataFrame([(1, "some text")], "d int, t string"), spark.createDataFrame([(1, "text")], "q int, s string")
    assert phrases.locate(qq.limit(0), "q", "s", dd, "d", "t").collect() == []
    assert phrases.locate(qq, "q", "s", dd.limit(0), "d", "t", gaps=True).collect() == []


def test_short_quotes_need_no_index(spark, monkeypatch):
    """Two words are checked where the rarer one is found; only longer quotes have an index of positions, of texts that can hold them."""
    written = []

    def keep(df):
        out = cut_lineage(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(phrases, "cut_lineage", keep)
    texts = ["the cold river bed", "old river", "cold  riverbed stone", "a cold river", "cold river a bed of stone lies", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def run(*quotes):
        written.clear()
        got = phrases.locate(spark.createDataFrame(list(enumerate(quotes)), "k int, q string"), "k", "q", docs, "id", "t")
        return {tuple(r) for r in got.collect()}, sum(n for cols, n in written if "p" in cols)

    assert run("ld river", "cold river", "r bed", "river") == ({(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 2), (1, 3), (1, 4), (2, 0), *((3, i) for i in range(5))}, 0)
    found, rows = run("river a bed of stone")
    assert found == {(0, 4)} and 0 < rows <= 7


def test_common_quotes_are_read_in_the_texts_with_the_same_result(spark, monkeypatch):
    texts = ["the cold river bed", "old river", "cold  riverbed stone", "a cold river", "Cold river a bed of stone lies", None, "", "the the", "breathe, the end"]
    quotes = ["ld river", "cold river", "r bed", "river", "river a bed of stone", "the", "THE", "e ", "the the", "t", "nowhere", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    asked = spark.createDataFrame([*enumerate(quotes), (None, "river")], "k int, q string")
    squeezed = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    want = {(i, j) for i, q in enumerate(quotes) for j, t in enumerate(texts) if q and t and squeezed(q) and squeezed(q) in squeezed(t)}
    run = lambda: sorted(tuple(r) for r in phrases.locate(asked, "k", "q", docs, "id", "t").collect())
    assert run() == sorted(want)
    monkeypatch.setattr(phrases, "FEW", 0)
    assert run() == sorted(want)  # all are common here
    monkeypatch.setattr(phrases, "LOOKED", 2)
    assert run() == sorted(want)  # the others go by the index


def test_words_are_neither_written_by_grams_nor_shuffled_with_their_texts(spark, monkeypatch):
    written = []

    def keep(df):
        out = cut_lineage(df)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        written.append((set(out.columns), out.count(), plan))
        return out

    monkeypatch.setattr(phrases, "cut_lineage", keep)
    docs = spark.createDataFrame([(i, f"word{i} stands beside another{i} in text number{i}") for i in range(300)], "id int, t string")
    quotes = spark.createDataFrame([(0, "ord7 stands bes"), (1, "beside anoth"), (2, "number12")], "k int, q string")
    got = phrases.locate(quotes, "k", "q", docs, "id", "t")
    assert got.where("k = 1").count() == 300 and got.where("k = 2").count() == 11
    assert not [n for columns, n, _ in written if {"g", "word"} <= columns]
    hits = next(plan for columns, _, plan in written if {"q", "d", "s"} <= columns)
    assert "LeftSemi" not in hits and "bitmap" in hits  # a semi-join of all words shuffles them once the list is large
