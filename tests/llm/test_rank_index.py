import hashlib
import random
import re

import numpy as np
import pytest

from llm_fixtures import clashing, documents
from veriframe.llm import rank_index


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text):
    """The definition, over a token list."""
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(d[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(w), "plain", None, None, sha(text), sha(text)
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 20:
        return doc_id, len(w), "spm", len(pre), len(mid), sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text)
    return doc_id, len(w), "psm", len(pre), len(mid), sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


MARKS = [(100 + i, t, "en", "s", 1) for i, t in enumerate(
    ["a <P> b", "a<S>b", "x<M>", "<", "P> <S <M", "<<P", "S>M>", "a<", "<P <S <M >P>", "line\nline\r\n\ttab", "é漢😀" * 40, "z"] * 6)]


def test_equals_definition(spark):
    docs = documents(spark, MARKS)
    got = sorted(map(repr, (tuple(r) for r in rank_index.digest(rank_index.fill_in_middle(clashing(docs))).collect())))
    assert got == sorted(repr(plain(r.doc_id, r.text)) for r in docs.collect())
    assert {eval(g)[2] for g in got} == {"plain", "psm", "spm"}


def test_batches_of_small_outputs(spark, monkeypatch):
    monkeypatch.setattr(rank_index, "OUTPUT_BYTES", 50)
    docs = documents(spark)
    got = rank_index.digest(rank_index.fill_in_middle(docs)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain(r.doc_id, r.text)) for r in docs.collect())


def test_other_key_and_parameters(spark):
    docs = spark.createDataFrame([("x", "one two three"), (None, "four")], "id string, body string")
    assert {r.form for r in rank_index.fill_in_middle(docs, "id", "body", plain_above=0).collect()} == {"plain"}
    assert {r.form for r in rank_index.fill_in_middle(docs, "id", "body", plain_above=100, spm_below=100).collect()} == {"spm"}
    assert rank_index.fill_in_middle(docs.limit(0), "id", "body").collect() == []


@pytest.mark.parametrize("window,stride,error", [(7, 3, 1), (64, 512, 4), (1 << 20, 512, 48), (1 << 20, 2, 126)])
def test_index_is_exact_and_bounded(monkeypatch, window, stride, error):
    monkeypatch.setattr(rank_index, "WINDOW_BYTES", window)
    monkeypatch.setattr(rank_index, "STRIDE", stride)
    rng = random.Random(window)
    for _ in range(60):
        s = "".join(rng.choice(["a", "Bc", "é", "漢", "😀", " ", "\n", "<", "abcdefghijk" * rng.randrange(1, 9)]) for _ in range(rng.randrange(200)))
        index = rank_index.RankIndex(s.encode(), error)
        ends = np.cumsum([0, *(len(w.encode()) for w in re.findall("[A-Za-z]+|[^A-Za-z]", s))])
        assert [index.offset(r) for r in range(len(ends))] == ends.tolist()
        assert max(abs(index.predict(r) - e) for r, e in enumerate(ends.tolist())) <= error + 1


def test_segments_are_few():
    text = ("some words of prose, and a few more. " * 4_000).encode()
    index = rank_index.RankIndex(text)
    assert index.tokens > 60_000 and len(index.first) < 40


def test_bad_error():
    with pytest.raises(ValueError):
        rank_index.RankIndex(b"x", 127)
