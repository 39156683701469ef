import random
import re

import numpy as np
import pytest

from llm_fixtures import clashing, documents, prose
from veriframe.llm import trie_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(3, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def components(sets, linked):
    """The place of the first set of each class, by comparing every two."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def similar(a, b, percent=90):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("node", [1, 3, 32])
def test_trie_equals_brute_force(monkeypatch, node):
    monkeypatch.setattr(trie_join, "NODE", node)
    rng = random.Random(node)
    for _ in range(80):
        percent = rng.choice([50, 80, 90, 91, 100])
        need, wide = trie_join.Threshold(percent), rng.random() < 0.6
        sets = set()
        for _ in range(rng.randrange(1, 6)):
            base = {rng.getrandbits(64) if wide else rng.randrange(20) for _ in range(rng.randrange(1, 70))}
            for _ in range(rng.randrange(1, 8)):
                s = {x for x in base if rng.random() > 0.04} | {rng.getrandbits(64) if wide else rng.randrange(20) for _ in range(rng.randrange(3))}
                sets.add(tuple(sorted(s)))
        sets = [np.array(s, np.uint64) for s in sorted(sets) if s]
        labels = [rng.randrange(len(sets)) for _ in sets] if rng.random() < 0.3 else list(range(len(sets)))
        plain = [set(s.tolist()) for s in sets]
        want = components(sets, lambda i, j: labels[i] == labels[j] or similar(plain[i], plain[j], percent))  # noqa: B023
        assert same_partition(trie_join.roots(sets, labels, need).tolist(), want)
        for i in range(len(sets)):
            for j in range(i):
                if similar(plain[i], plain[j], percent):
                    assert not need.lonely(len(sets[i])) and not need.lonely(len(sets[j]))
                    assert set(sets[i][:need.prefix(len(sets[i]))].tolist()) & set(sets[j][:need.prefix(len(sets[j]))].tolist())


def test_parts_and_signatures_keep_links(monkeypatch):
    monkeypatch.setattr(trie_join, "PART", 40)
    rng, need = random.Random(5), trie_join.Threshold(90)
    for _ in range(150):
        base = {rng.getrandbits(64) for _ in range(rng.choice([5, 9, 12, 30, 39, 42, 80, 84, 170, 330]))}
        other = {x for x in base if rng.random() > 0.04} | {rng.getrandbits(64) for _ in range(rng.randrange(len(base) // 20 + 2))}
        x, y = (np.array(sorted(s), np.uint64) for s in (base, other))
        if base == other or not similar(base, other):
            continue
        met = [(p, q) for p in trie_join.parts(x, need) for q in trie_join.parts(y, need) if set(p["first"].tolist()) & set(q["first"].tolist())]
        good = [trie_join.has_partner(np.zeros(2, np.int64), np.array([p["m"], q["m"]]), np.stack([np.frombuffer(r["signature"], np.uint64) for r in (p, q)]),
                                      np.arange(2), np.zeros((2, 0), np.int64), need).all() for p, q in met]
        assert any(good)


@pytest.mark.parametrize("rows", [3, 40])
def test_partners_by_group(rows):
    rng, need = np.random.default_rng(rows), trie_join.Threshold(90)
    group = np.sort(rng.integers(0, 4, rows))
    base = rng.integers(0, 1 << 64, (3, 8), np.uint64)
    bits = base[rng.integers(0, 3, rows)] ^ (rng.random((rows, 8)) < 0.2).astype(np.uint64)
    m, label = rng.integers(20, 30, rows), rng.integers(0, rows // 2 + 1, rows)
    met = rng.integers(0, 30, (rows, 2))
    got = trie_join.has_partner(group, m, bits, label, met, need)
    for i in range(rows):
        assert got[i] == any(group[i] == group[j] and label[i] != label[j] and int(np.bitwise_count(bits[i] ^ bits[j]).sum()) * 190 <= 10 * (m[i] + m[j]) and not set(met[i]) & set(met[j]) for j in range(rows))


def test_order_puts_rare_buckets_first():
    rng = np.random.default_rng(1)
    found = np.unique(rng.integers(0, 1 << 64, 500, np.uint64))
    counts = rng.integers(0, 50, 1 << trie_join.BUCKET_BITS)
    out = trie_join.ordered(found, trie_join.bucket_ranks(counts))
    low = np.uint64(64 - trie_join.BUCKET_BITS)
    by_rank = np.argsort(counts, kind="stable")
    assert len(np.unique(out)) == len(found) and (np.diff(counts[by_rank[out >> low]]) >= 0).all()


def corpus(spark):
    """Bases with near copies on both sides of the limit, chains of copies, and a passage that most texts hold."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(5))
    passage, rows = [word() for _ in range(60)], []
    for b in range(12):
        base = [word() for _ in range(rng.choice([8, 12, 40, 150]))] + (passage if b % 3 else [])
        for c in range(10):
            base = list(base) if c % 2 else base
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(text) // 40 + 2))):
                text[rng.randrange(len(text))] = word()
            if c % 4 == 3:
                base = text  # the next ones are copies of a copy
            rows.append((500 + 10 * b + c, " ".join(text).upper() if c == 5 else " ".join(text), "en", "s", 1))
    rng.shuffle(rows)
    return documents(spark, rows)


def plain_result(docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    root = components(rows, lambda i, j: similar(rows[i][1], rows[j][1]))
    least = {}
    for (k, s), r in zip(rows, root, strict=True):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return sorted(repr((k, len(s), k if not s else least.get(r))) for (k, s), r in zip(rows, root, strict=True))


@pytest.mark.parametrize("block,first,part", [(1024, 3, 1000), (4, 1, 30)])
def test_join_equals_brute_force(spark, monkeypatch, block, first, part):
    monkeypatch.setattr(trie_join, "PART", part)
    monkeypatch.setattr(trie_join, "BLOCK", block)
    monkeypatch.setattr(trie_join, "FIRST", first)
    docs = corpus(spark)
    got = trie_join.join_classes(clashing(docs)).select("doc_id", "n_shingles", "component_id").collect()
    want = plain_result(docs)
    assert sorted(repr(tuple(r)) for r in got) == want
    assert len({eval(w)[2] for w in want if 500 <= (eval(w)[0] or 0) < 620}) < 100  # some are linked


def test_small_outputs_and_cache(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "OUTPUT_BYTES", 100)
    monkeypatch.setattr(trie_join, "CACHE", 10)
    docs = corpus(spark).where("doc_id < 560 OR doc_id IS NULL")
    got = trie_join.join_classes(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_result(docs)


def test_empty_table_and_other_names(spark):
    docs = spark.createDataFrame([("x", prose(random.Random(1), 50)), ("w", prose(random.Random(1), 50)), (None, None)], "id string, body string")
    assert {(r.id, r.component_id) for r in trie_join.join_classes(docs, "id", "body").collect()} == {("x", "w"), ("w", "w"), (None, None)}
    assert trie_join.join_classes(docs.limit(0), "id", "body").collect() == []
