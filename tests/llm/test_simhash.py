import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import clashing, documents, prose
from veriframe.llm import simhash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(items, near):
    """item -> least item reachable, by comparing every two."""
    label = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if near(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    found = {rng.getrandbits(64) for _ in range(60)}
    for f in list(found)[:20]:
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            found.add(g)
    ball = rng.getrandbits(64)
    found |= {ball ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {0, (1 << 64) - 1}  # one dense group of 2,016
    prints = sorted(found)
    df = spark.createDataFrame([(signed(f),) for f in prints], "f long")
    edges = simhash.links(df)
    from veriframe.operators.graph import connected_components

    got = {r.node: r.component for r in connected_components(edges).collect()}
    values = np.array([signed(f) for f in prints], np.int64)
    label = values.copy()
    while True:
        least = np.array([label[np.bitwise_count((values ^ v).view(np.uint64)) <= 4].min() for v in values])
        if (least == label).all():
            break
        label = least
    assert {v: got.get(v, v) for v in values.tolist()} == dict(zip(values.tolist(), label.tolist(), strict=True))
    assert edges.count() <= 38 * len(prints)  # one edge for each key that a fingerprint is under, not one for each of the two million pairs


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(a)})
    got = simhash.links(spark.createDataFrame([(signed(f),) for f in prints], "f long")).collect()
    seen = classes([signed(f) for f in prints], lambda a, b: any({a, b} == {r.src, r.dst} for r in got))
    assert len(set(seen.values())) == 1


def awkward(spark):
    rng = random.Random(9)
    long = prose(rng, 900)
    return documents(spark, [(100 + i, long.replace("river", "riverr", i), "en", "s", 1) for i in range(4)])


def test_near_duplicates_on_awkward_rows(spark):
    docs = clashing(awkward(spark))
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    label = classes(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, f in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[label[f]] = min(least.get(label[f], 1 << 60), r.doc_id)
    want = sorted((str(r.doc_id), signed(f), str(least.get(label[f]))) for r, f in zip(rows, prints, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_keep_one_keeps_one_of_each_class(spark):
    docs = clashing(awkward(spark))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [plain_fingerprint(r.text) for r in docs.collect()]
    label = classes(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    left = [label[plain_fingerprint(r.text)] for r in kept.collect()]
    assert len(left) == len(set(left)) and set(left) == set(label.values())
    texts = docs.where(F.col("doc_id") == 1)
    assert kept.where("doc_id = 1").count() <= texts.count()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def test_keep_one_links_every_pair_of_similarity_eight_tenths(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, common = [], [rng.choice(vocabulary) for _ in range(40)]
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 60, 300]))] + common * (i % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(1, 4)):  # up to about one shingle in nine is lost: similarities on both sides of 0.8
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.uniform(0.002, 0.035)))):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    hub = [rng.choice(vocabulary) for _ in range(80)]
    texts += [" ".join(hub[:i] + ["x"] + hub[i + 1:]) for i in range(60)]  # one group of near copies, larger than a block
    sets = [shingles(t) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if near(i, j)]
    plain = [plain_fingerprint(t) for t in texts]
    assert sum((plain[i] ^ plain[j]).bit_count() > 4 for i, j in pairs) > 50
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(label))


@pytest.mark.parametrize("n", [4, 5, 7, 9, 13, 16, 17, 33, 64, 100, 205, 512])
def test_similar_sets_share_the_simhash_of_a_segment(n):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, 1 << 64, k, np.uint64)
    shared = -(-8 * n // 9)
    for _ in range(100):  # the two ends of similarity 0.8: one set in the other, and sets of one size
        whole, both = draw(int(1.25 * n)), draw(2 * n - shared)
        for a, b in ((whole[:n], whole), (both[:n], both[n - shared:])):
            assert len(np.intersect1d(simhash.segment_keys(np.sort(a)), simhash.segment_keys(np.sort(b))))


def test_the_print_of_a_segment_is_the_simhash_of_its_shingles():
    found = np.random.default_rng(3).integers(0, 1 << 64, 6, np.uint64)
    places, prints = simhash.segment_prints(found, 1, 2)
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in found) > len(found))
    assert places.tolist() == list(range(simhash.SEGMENTS)) and set(prints.tolist()) == {want}
    assert not len(simhash.segment_prints(found, 1, 7)[0]) and not len(simhash.segment_keys(found[:3]))


def test_a_key_over_many_batches_has_one_least_set(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, 8, [100 + i // 50] + ([5] if i in (3, 60, 140) else [])) for i in range(150)] + [(900, 8, [999])]
        per = spark.createDataFrame(rows, "s long, n long, bands array<long>")
        got = simhash.candidate_clusters(per.select("s", "n"), per.unionByName(per.where("s % 3 = 0"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.s: r.cluster for r in got} == {i: 0 for i in range(150)}


@pytest.mark.parametrize("distance", [1, 3, 4])
def test_every_near_pair_has_a_viable_chain(distance):
    rng = random.Random(distance)
    ring = simhash.segments(distance)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), distance):
            b ^= 1 << bit
        pair = np.array([a], np.uint64), np.array([b], np.uint64)
        assert any(simhash.near(*pair, np.array([i]), distance)[0] for i in range(len(ring)))


@pytest.mark.parametrize("n", [40, 200, 600])
def test_sets_that_differ_where_it_hurts_most_share_a_key(n):
    """Shingles are replaced so that the fewest common keys are left, as far as similarity 0.8 allows."""
    rng = np.random.default_rng(n)
    whole = np.sort(rng.integers(0, 1 << 64, n, np.uint64))
    mine = simhash.segment_keys(whole)
    left = whole
    while True:
        some = rng.permutation(len(left))[:60]
        tries = [np.delete(left, i) for i in some]
        common = [len(np.intersect1d(simhash.segment_keys(t), mine)) for t in tries]
        best = tries[int(np.argmin(common))]
        if len(best) < 0.8 * n:
            break
        left = best
        assert min(common)


def test_a_set_in_too_few_segments_is_filed_under_shingles_too(monkeypatch):
    monkeypatch.setattr(simhash, "SPARE", 0.1)
    rng = np.random.default_rng(8)
    for n in (4, 30, 200):
        whole = np.sort(rng.integers(0, 1 << 64, n + n // 4, np.uint64))
        part = np.delete(whole, rng.permutation(len(whole))[:n // 4])
        assert len(np.intersect1d(simhash.segment_keys(whole), simhash.segment_keys(part)))


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.9])
def test_other_similarities_lose_no_key(similarity):
    rng = np.random.default_rng(5)
    for n in (5, 20, 130):
        whole = np.sort(rng.integers(0, 1 << 64, int(n / similarity), np.uint64))
        part = np.sort(rng.choice(whole, n, replace=False))
        assert len(part) == len(whole) or len(np.intersect1d(simhash.segment_keys(whole, similarity), simhash.segment_keys(part, similarity)))


def test_similar_sets_are_linked_however_far_their_simhashes_are_apart():
    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 64, 80, np.uint64)
    ends = np.arange(10, dtype=np.uint64)
    low, high = (np.sort(np.concatenate([common, x])) for x in (ends, ~ends))  # shingles whose hashes have nearly no and nearly all bits
    bits = lambda x: 2 * np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) > len(x)
    assert (bits(low) != bits(high)).sum() > 40
    assert simhash.similar_roots([low, high], 0.8).tolist() == [0, 0]
    assert simhash.similar_roots([low, high[high != common[0]]], 0.8).tolist() == [0, 1]


def test_sets_that_share_a_passage_do_not_chain_up(spark, monkeypatch):
    rng = np.random.default_rng(7)
    draw = lambda k: rng.integers(0, 1 << 64, k, np.uint64)
    sets = [draw(100)]
    for _ in range(9):  # each shares 30 of 100 shingles with the one before
        sets.append(np.concatenate([sets[-1][:30], draw(70)])[::-1])
    sets.append(np.concatenate([sets[0][:95], draw(45)]))  # of another number of buckets, similar to none
    sets += [np.concatenate([x[:95], draw(5)]) for x in sets[:3]]
    sets = [np.sort(x) for x in sets]
    rows = [(i, len(x), bytearray(simhash.parities([x], simhash.buckets(len(x))).tobytes()), simhash.segment_keys(x).tolist() + [1]) for i, x in enumerate(sets)]
    per = spark.createDataFrame(rows, "s long, n long, odd binary, bands array<long>")
    clusters = lambda: {r.s: r.cluster for r in simhash.candidate_clusters(per.select("s", "n", "odd"), per, 0.8).collect()}
    assert len({len(r[2]) for r in rows}) == 2
    assert clusters() == {0: 0, 11: 0, 1: 1, 12: 1, 2: 2, 13: 2}
    monkeypatch.setattr(simhash, "PAIRS", 4)
    assert set(clusters().values()) == {0}  # under a key of many sets all are candidates


def test_common_shingles_take_no_part_in_segments_but_no_link_is_lost():
    rng = np.random.default_rng(10)
    draw = lambda k: rng.integers(0, 1 << 64, k, np.uint64)
    passage = draw(60)
    often = np.zeros(1 << simhash.COUNT_BITS, np.int64)
    often[passage >> np.uint64(64 - simhash.COUNT_BITS)] = 1000
    for own in (4, 20, 300):
        for _ in range(30):
            base = np.concatenate([passage, draw(own)])
            near = np.sort(np.concatenate([np.delete(base, rng.permutation(len(base))[:len(base) // 10]), draw(len(base) // 10)]))
            keys = [simhash.segment_keys(np.sort(x), 0.8, often) for x in (base, near)]
            assert len(np.intersect1d(*keys))
    counts = rng.poisson(1000, 1 << simhash.COUNT_BITS)
    counts[5] = 3000
    assert simhash.common_only(counts)[5] == 3000 and (simhash.common_only(counts) > 0).sum() < 5
