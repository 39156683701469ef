import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import clashing, documents
from veriframe.llm import tandem_runs


def plain_runs(words, least, times):
    """Every period in turn, smallest first: longest stretches in which words a period apart are equal."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def sha(b):
    return hashlib.sha256(b).hexdigest()


def plain(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 24, 3)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha(b"".join(b"%d,%d,%d\n" % r for r in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def some_words(rng, most):
    w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(most))]
    if w and rng.random() < 0.5:
        a = rng.randrange(len(w))
        w[a:a] = w[a:a + rng.randrange(1, 7)] * rng.randrange(1, 12)
    return w


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (1, 2), (6, 3)])
def test_runs_equal_brute_force(monkeypatch, least, times):
    rng = random.Random(least)
    for looks in (5, 1_000_000):
        monkeypatch.setattr(tandem_runs, "LOOKS", looks)
        for _ in range(150):
            texts = [some_words(rng, 60) for _ in range(rng.randrange(1, 6))]
            assert tandem_runs.runs_of(texts, least, times) == [plain_runs(w, least, times) for w in texts]


def test_squares_are_all_that_branch():
    rng = random.Random(4)
    for _ in range(100):
        codes = [rng.randrange(3) for _ in range(rng.randrange(1, 40))] + [9]
        got = set(zip(*(x.tolist() for x in tandem_runs.branching_squares(np.array(codes))), strict=True))
        assert got == {(i, d) for d in range(1, len(codes)) for i in range(len(codes) - 2 * d)
                       if codes[i:i + d] == codes[i + d:i + 2 * d] and codes[i + d] != codes[i + 2 * d]}


def test_one_word_many_times():
    assert tandem_runs.runs_of([[b"a"] * 30_000, [b"a", b"b"] * 9_000 + [b"a"]], 24, 3) == [[(0, 30_000, 1)], [(0, 18_001, 2)]]


def test_query_equals_definition(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(200 + i, " ".join(w.decode() for w in some_words(rng, 90)), "en", "s", 1) for i in range(120)]
    docs = documents(spark, rows).where("doc_id <> 44 OR doc_id IS NULL").withColumn("text", F.when(F.col("doc_id") == 43, F.substring("text", 1, 3000)).otherwise(F.col("text")))
    want = sorted(repr(plain(r.doc_id, r.text)) for r in docs.collect())
    for words in (300_000, 100):
        monkeypatch.setattr(tandem_runs, "SLICE_WORDS", words)
        found = tandem_runs.periodic_runs(clashing(docs), rewrite=tandem_runs.planted)
        assert sorted(repr(tuple(r)) for r in tandem_runs.summary(found).collect()) == want


def test_general_form(spark):
    docs = spark.createDataFrame([("x", "so it goes so it goes so it goes on"), (None, None), ("y", ""), ("y", "")], "id string, body string")
    got = {(r.id, tuple(map(tuple, r.runs)), r.collapsed) for r in tandem_runs.periodic_runs(docs, "id", "body", least=6, times=3).collect()}
    assert got == {("x", ((0, 9, 3),), "so it goes on"), (None, (), ""), ("y", (), "")}
    assert tandem_runs.periodic_runs(docs.limit(0), "id", "body").collect() == []
    with pytest.raises(ValueError):
        tandem_runs.periodic_runs(docs, times=1)
