import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from veriframe.functions import pages as pg
from veriframe.operators import evidence as ev
from veriframe.operators import patch as pt
from veriframe.operators.graph import reachable

MARK = re.compile(r"(?m)^\[\[page\s+(\d+)\]\]\s*$")


def plain_pages(text):
    """(page, begin, text) by a scan for marker lines."""
    if not MARK.search(text) and "\f" in text:
        text = "".join(f"[[page {i}]]\n{p}\n" for i, p in enumerate(text.split("\f"), 1) if p.strip())
    found = list(MARK.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(int(m.group(1)), m.end() + 1, text[m.end():e]) for m, e in zip(found, ends)]


TEXTS = ["", "no pages at all", "[[page 1]]\nalpha beta\n[[page 2]]\n\n\nsecond page", "front\n[[page 7]]  \nx\n[[page 7]]\ny", "one\ftwo\f \f\ffive\n",
         "\f", "[[page 1]]\nform\ffeed inside", "text [[page 3]] inside a line\n[[page 4]]", "a\r\n[[page 5]]\r\nb"]


def test_pages_of_both_notations(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    rows = df.select("id", pg.page_map(F.col("t")).alias("p"), pg.mark_pages(F.col("t")).alias("m"), pg.page_texts(F.col("t")).alias("x")).collect()
    for r in rows:
        want = plain_pages(TEXTS[r.id])
        assert [tuple(p) for p in r.p] == want, TEXTS[r.id]
        assert all(r.m[b - 1:b - 1 + len(t)] == t for _, b, t in want)
        assert r.x == ([t for *_, t in want] or [TEXTS[r.id]])


def test_page_of_a_place(spark):
    df = spark.createDataFrame([(TEXTS[2],)], "t string").select(pg.page_map(F.col("t")).alias("p"))
    got = df.select(*[pg.page_at(F.col("p"), F.lit(i)).alias(f"c{i}") for i in (1, 11, 22, 35, 45)]).first()
    want = [next((p for p, b, _ in reversed(plain_pages(TEXTS[2])) if b <= i), None) for i in (1, 11, 22, 35, 45)]
    assert list(got) == want and None in want and 2 in want


def test_many_pages_of_one_text(spark):
    """The work on a text grows with its pages, not with their square; of a repeated number the first page counts."""
    n = 20_000
    text = "".join(f"[[page {i % (n - 5) + 1}]]\nline {i}\n" for i in range(n))
    fed = "\f".join(f"line {i}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, fed)], "id int, t string").repartition(2)
    begin = time.time()
    got = {(r.id, r.page): r.text.strip() for r in ev.page_rows(df, "id", "t").collect()}
    assert time.time() - begin < 60
    assert got == {**{(1, i + 1): f"line {i}" for i in range(n - 5)}, **{(2, i + 1): f"line {i}" for i in range(n)}}


def norm(s):
    return " ".join(unicodedata.normalize("NFKC", s).split())


def test_support_of_quotes(spark):
    docs = [("a", "[[page 1]]\nThe  cell count rose by ﬁve per-\n cent.\n[[page 2]]\nÉtude of Ⅻ words\n[[page 2]]\nrepeated number"), ("b", "x\fthe second page"), ("c", None)]
    long = " ".join(["word"] * 26)
    cited = [("a", "1", "cell count rose"), ("a", "1", "Cell count"), ("a", "1", "by five percent."), ("a", "2", "Étude of XII"), ("a", "2", "repeated number"), ("a", "p1", "cell"), ("a", "1", "cell ... rose"),
             ("a", "1", "cell…"), ("a", "NR", "cell"), ("a", "1", "NA"), ("a", "1", ""), ("a", "1", None), ("a", None, "cell"), ("a", "3", "cell"), ("b", "2", "second page"), ("b", "1", "second page"), ("c", "1", "x"),
             ("z", "1", "x"), ("a", "1", long), ("a", "01", "cell count")]
    dd = spark.createDataFrame(docs, "doc string, body string")
    cc = spark.createDataFrame([(i, *r) for i, r in enumerate(cited)], "i int, doc string, page string, quote string")
    got = {r.i for r in ev.quote_supported(cc, dd, "doc", "body", "page", "quote").collect() if r.supported}
    assert got == {0, 2, 3, 14, 19}
    assert ev.quote_supported(cc, dd, "doc", "body", "page", "quote").count() == len(cited)


def test_audit_names_every_fault(spark):
    docs = spark.createDataFrame([(1, "[[page 1]]\nalpha beta gamma\n[[page 2]]\ndelta"), (2, "only\ffeeds here")], "doc int, t string")
    long = "p.9: \"" + "word " * 21 + "\""
    recs = [(1, "", None), (1, "alpha beta", 'p.1: "alpha  beta"'), (1, long, ""), (1, 'p.2: "alpha"', 'p.5: "x"'), (2, 'p.2: "feeds here"', 'p. 2: "feeds"'), (3, 'p.1: "x"', "")]
    df = spark.createDataFrame(recs, "doc int, must string, may string")
    got = sorted(tuple(r) for r in ev.audit_quotes(df, docs, "doc", "t", ["must", "may"], ["must"]).collect())
    assert got == sorted([(1, "must", "missing_evidence"), (1, "must", "format"), (1, "must", "word_limit"), (1, "must", "missing_page"), (1, "must", "not_verbatim_on_page"),
                          (1, "may", "missing_page"), (2, "may", "format"), (3, "full_text", "missing_source")])


def test_reachable_equals_search(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(12)] + [(5, 5), (None, 3)]
    seeds = [1, 2, 2, 100, 999, None]
    got = {r.node: r.hops for r in reachable(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in seeds], "node int")).collect()}
    want, front, hop = {}, {1, 2, 100, 999}, 0
    while front:
        want.update(dict.fromkeys(front, hop))
        front, hop = {d for s, d in edges if s in front and s is not None} - want.keys(), hop + 1
    assert got == want and max(want.values()) >= 12


def test_isolation_by_kind_and_partial_marks(spark):
    ops = spark.createDataFrame([("r", 1, "update", False), ("r", 2, "row", True), ("r", 3, "row", True), ("r", 4, "row", False), ("s", 5, "update", True), ("s", 6, "update", None), ("t", 7, "row", True)],
                                "rec string, op int, kind string, supported boolean")
    dep = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 7), (1, 3), (7, 99)], "op int, depends_on int")
    out = pt.isolate_unsupported(ops, dep, "op", "kind", {"update": "bad update", "row": "bad row"}, "depends")
    assert {r.op: (r.isolated, r.hops) for r in out.collect()} == {1: ("bad update", 0), 2: ("depends", 1), 3: ("depends", 2), 4: ("bad row", 0), 5: ("", None), 6: ("bad update", 0), 7: ("", None)}
    got = {r.rec: (r.n_isolated, r.n_applied, r.completion, len(r.remaining)) for r in pt.partial_records(out, "rec", "op", "kind").collect()}
    assert got == {"r": (4, 0, "partial", 4), "s": (1, 1, "partial", 1)}
