import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriframe.llm import url_aliases

PAGES = [
    (1, "http://a.example.org/x", '<link rel="canonical" href="http://b.example.net/es/1">'),
    (2, "http://b.example.net/es/1", ""),
    (3, "http://c.example.org/y", "<META http-equiv='refresh' content='0; url=http://A.example.org/x#frag'>"),
    (4, "http://d.example.org/z", '<!-- <link rel="canonical" href="http://b.example.net/es/1"> --><p>x</p>'),
    (5, "http://e.example.org/z", '<link href=/z2 rel=canonical>'),
    (6, "http://e.example.org/z2", '<link rel="canonical" href="//f.net/fr/1">'),
    (7, "http://g.example.org/z", '<link rel="canonical" href="http://b.example.net/fr/9"><link rel="canonical" href="https://www.example.com/en/5">'),
    (8, "http://www.example.com/en/1", ""),
    (9, "http://example.com/en/1", ""),
    (10, "http://x.example.com/de/1?q=/en/", ""),
    (11, None, '<link rel="canonical" href="http://b.example.net/es/1">'),
    (12, "no scheme", None),
    (13, "", ""),
    (None, "http://a.example.org/x", None),
    (1, "http://a.example.org/x", '<link rel="canonical" href="http://b.example.net/es/1">'),
    (14, "HTTP://EXAMPLE.COM?x=/en/", ""),
    (15, "http://h.org/a/b?c=1", '<link rel="canonical" href="q.html">'),
    (16, "http://h.org/a/q.html", '<link rel="canonical" href="mailto:x@y.z"><link rel="stylesheet" href="http://k.net/es/1">'),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def verdicts(df):
    return {r.page_id: (r.rule, r.verdict) for r in df.collect()}


def test_aliases_take_the_decision(spark):
    got = verdicts(url_aliases.judge(frame(spark)))
    assert got[1] == (None, "block") and got[3] == (None, "block") and got[2] == ("net/es/", "block")
    assert got[4] == (None, "allow")
    assert got[5] == (None, "block") and got[6] == (None, "block")
    assert got[7] == (None, "allow")  # its component holds an explicit allow
    assert got[8] == ("www.example.com/en/", "allow") and got[9] == ("example.com/en/", "block") and got[10] == ("com/", "allow")
    assert got[11] == got[12] == got[13] == (None, "allow") and got[None] == (None, "block")


def test_equals_sql(spark):
    df = url_aliases.judge(frame(spark))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64", "url": "string", "html": "string"}))
    rows = con.execute(url_aliases.judge_sql()).fetchall()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, rows)) == sorted(key(tuple(r)) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())


def test_redirect_table_empty_table_and_extra_columns(spark):
    extra = frame(spark).withColumn("rule", F.lit(7)).withColumn("host", F.lit("h")).withColumn("node", F.lit(1))
    links = spark.createDataFrame([("http://d.example.org/z", "http://k.net/fr/1"), (None, "http://k.net/fr/1")], "src string, dst string")
    got = verdicts(url_aliases.judge(extra, redirects=links))
    assert got[4] == (None, "block") and got[1] == (None, "block")
    assert url_aliases.judge(frame(spark, [])).collect() == []


def test_tags_over_several_lines(spark):
    rows = [(1, "http://a.org/", '<link\n  href="http://b.net/es/1"\n  rel="canonical"\n>'), (2, "http://c.org/", '<meta\r\n content="0;\n url=http://b.net/fr/1"\r\n http-equiv="refresh">'),
            (3, "http://d.org/", '<LINK data-x="\n"\tREL="alternate\ncanonical" HREF=\n"http://b.net/es/2">'), (4, "http://e.org/", '<link\nrel="alternate"\nhref="http://b.net/es/3">'),
            (5, "http://f.org/", '<link rel="next canonical"\nhref="http://b.net/es/4">')]
    assert verdicts(url_aliases.judge(frame(spark, rows))) == {1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "block")}


@pytest.mark.parametrize("n", [300])
def test_long_chain(spark, n):
    rows = [(i, f"http://s{i}.org/", f'<link rel="canonical" href="http://s{i + 1}.org">') for i in range(n)]
    rows += [(n, f"http://s{n}.org/", '<link rel="canonical" href="http://end.net/es/">')]
    assert {v for _, v in verdicts(url_aliases.judge(frame(spark, rows))).values()} == {"block"}
