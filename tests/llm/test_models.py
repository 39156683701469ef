import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import clashing, documents
from veriframe.llm import kneser_ney, string_kernel

ENGLISH = "the house and the river were quiet when they walked through this old garden with nothing left behind".split()
GERMAN = "das haus und der fluss waren still als sie durch diesen alten garten gingen und nichts blieb zurück".split()


def corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(1000, 1000 + n):
        words, lang = (ENGLISH, "en") if i % 2 else (GERMAN, "de")
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))), lang, "s", 1))
    rows += [(5000 + i, " ".join("".join(rng.choice("#$%&@!xqz") for _ in range(6)) for _ in range(30)), rng.choice(["en", "de"]), "s", 1) for i in range(20)]
    return spark.createDataFrame(rows, documents(spark).schema)


class PlainModel:
    """Interpolated modified Kneser-Ney by its definition, with dictionaries of tuples."""

    def __init__(self, texts, order=4, parts=None):
        self.parts = parts or (lambda t: [["\2", *w, "\3"] for w in re.findall(r"[^\x20\x09-\x0D]+", t)])
        raw = Counter()
        for t in texts:
            for s in self.parts(t):
                for i in range(1, len(s)):
                    raw[tuple(s[max(0, i - order + 1):i + 1])] += 1
        self.c = {order: {g: n for g, n in raw.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            self.c[k] = {g: n for g, n in raw.items() if len(g) == k}
            left = defaultdict(set)
            for g in self.c[k + 1]:
                left[g[1:]].add(g[0])
            self.c[k].update({g: len(x) for g, x in left.items()})
        self.d, self.context = {}, {}
        for k, counts in self.c.items():
            n = [0] + [sum(1 for x in counts.values() if x == i) for i in (1, 2, 3, 4)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            self.d[k] = [min(i, max(0.1, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 * i for i in (1, 2, 3)]
            total, left_over = Counter(), Counter()
            for g, x in counts.items():
                total[g[:-1]] += x
                left_over[g[:-1]] += self.d[k][min(x, 3) - 1]
            self.context[k] = (total, left_over)
        self.symbols = len(self.c[1]) + 1

    def p(self, g):
        k = len(g)
        total, left_over = self.context[k]
        x = self.c[k].get(g, 0)
        own = (x - self.d[k][min(x, 3) - 1]) / total[g[:-1]] if x else 0.0
        rest = left_over[g[:-1]] / total[g[:-1]] if total[g[:-1]] else 1.0
        return own + rest * (1 / self.symbols if k == 1 else self.p(g[1:]))

    def nll(self, text, order=4):
        return sum(-math.log(self.p(tuple(w[max(0, i - order + 1):i + 1]))) for w in self.parts(text) for i in range(1, len(w)))


def distances(text):
    """How long ago each word of a text last stood there: in doublings, 0 for never."""
    last, out = {}, ["first"]
    for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", text)):
        out.append(1 + math.ceil(math.log2(i - last[w])) if w in last else 0)
        last[w] = i
    return [out]


@pytest.mark.parametrize("shard", [4_000_000, 40])
def test_perplexity_equals_the_definition(spark, shard, monkeypatch):
    trusted = corpus(spark, 60).where("doc_id < 5000")
    docs = trusted.where("doc_id < 1020").unionByName(corpus(spark, 20, 2)).unionByName(documents(spark).where("doc_id in (45, 46, 42)"))
    plain = PlainModel([r.text for r in trusted.collect()])
    order = PlainModel([r.text for r in trusted.collect()], parts=distances)
    monkeypatch.setattr(kneser_ney, "SLICE_CHARS", 500)
    monkeypatch.setattr(kneser_ney.Model.__init__, "__defaults__", (shard,))
    model = kneser_ney.train(docs, trusted, "text")
    assert (len(model.shards) > 1) == (shard == 40)
    got = kneser_ney.score(docs, [F.col("text").alias("whole")], "text", model).collect()
    for r in got:
        assert r.nll == pytest.approx(plain.nll(r.whole), rel=1e-4, abs=1e-6)
        assert r.n == sum(len(w) + 1 for w in re.findall(r"[^\x20\x09-\x0D]+", r.whole))
        assert r.order_nll == pytest.approx(order.nll(r.whole), rel=1e-4, abs=1e-6)
        assert r.words == len(re.findall(r"[^\x20\x09-\x0D]+", r.whole))
    assert len(got) == docs.count()


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = [" ".join(ENGLISH), " ".join(GERMAN)]
    plain = PlainModel(texts)
    letters = sorted({g[0] for g in plain.c[1]}) + ["?"]
    for context in [("\2",), ("\2", "t"), ("\2", "t", "h"), ("t", "h", "e"), ("q", "q")]:
        assert sum(plain.p((*context, x)) for x in letters) == pytest.approx(1.0)


def test_quality_keeps_clean_text_and_drops_junk(spark):
    docs = clashing(corpus(spark).unionByName(documents(spark).where("doc_id IS NULL OR doc_id >= 40")))
    trusted = docs.where("doc_id >= 1000 AND doc_id < 1200").select("doc_id")
    got = kneser_ney.classify(docs, trusted).collect()
    assert len(got) == docs.count()
    keep = {r.doc_id: r.keep for r in got}
    assert all(keep[i] for i in range(1000, 1300)) and not any(keep[i] for i in range(5000, 5020))
    assert keep[40] and keep[41] and keep[42]
    kept = kneser_ney.keep_fluent(docs, trusted)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)


@pytest.mark.parametrize("shard", [4_000_000, 40])
def test_text_that_repeats_itself_is_dropped(spark, shard, monkeypatch):
    monkeypatch.setattr(kneser_ney.Model.__init__, "__defaults__", (shard,))
    clean = corpus(spark).where("doc_id < 5000")
    rows = [(6000, "the " * 200, "en", "s", 1), (6001, "fluss " * 40, "de", "s", 1), (6002, "river house " * 60, "en", "s", 1),
            (6003, "they walked through the garden " + "river " * 300, None, "s", 1), (6004, "the the", "en", "s", 1)]
    docs = clean.unionByName(spark.createDataFrame(rows, clean.schema))
    # Read through a join: rows have no fixed place that two scans could agree on.
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id").select(docs.columns)
    trusted = clean.where("doc_id < 1200").select("doc_id")
    kept = {r.doc_id for r in kneser_ney.keep_fluent(joined, trusted).collect()}
    assert kept == {*range(1000, 1300), 6004}
    got = {r.doc_id: r for r in kneser_ney.classify(joined, trusted).collect()}
    assert {i for i, r in got.items() if r.keep} == kept
    # The letters of such text are fluent; only its order is not.
    assert got[6000].perplexity <= got[6000].threshold and got[6000].order_perplexity > got[6000].order_threshold


def test_quality_of_empty_tables(spark):
    docs = documents(spark).where("doc_id < 30")
    nobody = docs.where("false").select("doc_id")
    assert all(r.keep for r in kneser_ney.classify(docs, nobody).collect())
    assert kneser_ney.classify(docs.where("false"), docs.select("doc_id")).collect() == []


def test_quantile_is_exact_to_a_step(spark):
    rng = random.Random(3)
    rows = [(lang, 3.0 * n * rng.uniform(0.5, 1.5), n) for lang in ("en", "de") for n in [rng.randrange(1, 500) for _ in range(400)]]
    got = {r.lang: r for r in kneser_ney.thresholds(spark.createDataFrame(rows, "lang string, nll double, n long"), 0.9).collect()}
    assert set(got) == {"en", "de", "*"}
    for lang in ("en", "de"):
        own = [r for r in rows if r[0] == lang]
        mean = sum(r[1] for r in own) / sum(r[2] for r in own)
        level = sorted((r[1] + kneser_ney.PRIOR * mean) / (r[2] + kneser_ney.PRIOR) for r in own)[math.ceil(0.9 * 400) - 1]
        assert 0 <= got[lang].threshold - math.log(kneser_ney.SLACK) - level < 1.01 / kneser_ney.BINS


def gram_set(text, letter):
    s = [c.lower() if letter(c) else "\1" for c in text]
    out = {tuple(s[i:i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    return {g for g in out if set(g) != {"\1"}}


def test_kernel_equals_the_definition():
    table = string_kernel.letters(string_kernel.class_table() == string_kernel.LETTER)
    texts = [" ".join(ENGLISH), " ".join(GERMAN), "Ünïcödé ß 漢字", "a", "ab", "x1y"]
    sets = [string_kernel.grams(table[np.frombuffer(t.encode("utf-32-le"), np.uint32)]) for t in texts]
    vocabulary = np.unique(np.concatenate(sets))
    x = string_kernel.presence(sets, vocabulary)
    plain = [gram_set(t, str.isalpha) for t in texts]
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in plain] for a in plain]
    assert np.allclose(string_kernel.kernel(x, x), want)
    model = string_kernel.fit([("en", sets[0]), ("de", sets[1]), ("zz", sets[2])])
    scorer = string_kernel.Scorer(model)
    joined = "\0".join(texts)
    char = scorer.char[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[:len(char)]
    char[np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 0)] = 0
    known = string_kernel.presence(sets, model["vocabulary"])
    assert (scorer.presence(char, owner, len(texts)) == known).all()


def test_language_on_held_out_and_awkward_rows(spark):
    docs = clashing(corpus(spark).unionByName(documents(spark).where("doc_id IS NULL OR doc_id >= 40")))
    got = string_kernel.identify(docs).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.where("doc_id BETWEEN 1000 AND 4999").collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and all(r.lang_pred == truth[r.doc_id] for r in held)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (40, 41, 42, 46))
    assert all(0 <= r.score <= 1 for r in got) and by_id[45].lang_pred in ("en", "de")
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in string_kernel.identify(unlabelled).collect()} == {"und"}
    assert string_kernel.identify(docs.where("false")).collect() == []
    kept = string_kernel.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({40, 41, 42, 46}) and kept.where("doc_id >= 1000 AND doc_id < 5000").count() == 300


def test_unlearned_language_and_noise_go_and_missing_labels_are_filled(spark):
    rng = random.Random(6)
    finnish = "kaikki ihmiset syntyvät vapaina tasavertaisina arvoltaan oikeuksiltaan heille annettu järki omatunto toimittava toisiaan kohtaan".split()
    clean = corpus(spark).where("doc_id < 5000").withColumn("lang", F.when(F.col("doc_id") % 10 > 1, F.col("lang")))
    rows = [(6000 + i, " ".join(rng.choice(finnish) for _ in range(40)), None, "s", 1) for i in range(10)]
    rows += [(6100 + i, " ".join("".join(rng.choice("bcdfgjkpqvxyz") for _ in range(6)) for _ in range(40)), None, "s", 1) for i in range(10)]
    kept = {r.doc_id: r.lang for r in string_kernel.keep_identified(clean.unionByName(spark.createDataFrame(rows, clean.schema))).collect()}
    assert kept == {i: "en" if i % 2 else "de" for i in range(1000, 1300)}


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = corpus(spark)
    lying = docs.withColumn("lang", F.when(string_kernel.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted((r.doc_id, r.lang_pred) for r in string_kernel.identify(d).collect()) for d in (docs, lying))
    assert a == b
