"""Readers on small files with the edge cases of real exports, sinks, and streams fed in several steps."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from veriframe.operators.dedup import deduplicate
from veriframe.sources import articles, discover, nested, records, runs, sinks, tagged
from veriframe.streaming import ledger as sl

RIS = "junk before\nTY  - JOUR\nTI  - One title\nAU  - A, B\nAU  - C, DPY  - 2020\nC2  - 42727861\nER  - \nTY  - JOUR\nT1  - Two\nN1  - x PMID: 77777\nDA  - 1999/01\n"
TSV = "PT\tAU\tTI\tPY\tSO\tDI\tPM\tAB\tUT\tDT\nJ\tRoe, A; Li, B\tTab one\t2021\tJ\t10.1/t1\t33333\tabs\tW1\tArticle\t\nJ\tX\tTab two\t2022\r\n"
WOS = "FN Export\nVR 1.0\nPT J\nAU Roe, A\n   Li, B\nTI Long title\n   goes on\nPY 2018\nDI 10.1/w\nER\n\nPT J\nTI Second\nstray line\nER\nEF\n"
BIB = "Scopus\nEXPORT DATE: x\n@ARTICLE{k1,\n author = {Roe, A. and Li, B.},\n title = {About {DNA} repair},\n abstract = {has title = {x} inside},\n year = {2017}\n}\n@ARTICLE{k2,\n title = {Stray},\n abstract = {cut } here},\n doi = {10.1/b2}\n}\n"
CSV = 'Article Title,Author(s),PubYear,Source title,DOI,PubMed ID,EID\n"Quoted, ""title""","Roe, A.; Li, B.",2016,J,10.1/c,44444,e1\n'
J1 = '{"pmid": "11111", "doi": "10.1/j", "title": "JSON one", "authors": ["Roe A"], "year": "2015", "mesh_major": ["M"]}\nnot json\n[1]\n{"pmid": "22222", "title": "JSON two"}\n{"title": "t3"}\n{"title": "t4"}\n{"title": "t5"}\n{"title": "t6"}\n{"title": "t7"}\n{"title": "t8"}\n'
J2 = '{"eid": "e", "dc:title": "Second layout", "prism:doi": "10.1/s", "prism:coverDate": "2014-03-01", "dc:creator": "Roe A."}\n'


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    for name, text in {"pubmed/a_EI.jsonl": J1, "scopus/b_EO.jsonl": J2, "wos/x.ris": RIS, "wos/t_EI.txt": TSV, "wos/w.txt": WOS, "scopus/s.bib": BIB, "scopus/c.csv": CSV, "notes.txt": "hello\n"}.items():
        p = root / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text, encoding="utf-8")
    (root / "pubmed" / "z.jsonl.gz").write_bytes(gzip.compress(b'{"title": "zipped"}\n'))
    (root / "pubmed" / "doc.jsonl").write_text(json.dumps({"records": [{"title": "in doc", "pmid": "55555"}, {"title": "in doc 2"}]}, indent=1))
    return root


def test_ingest_every_format(spark, exports):
    searches = spark.createDataFrame([("Scopus", "E AND O AND T", "S7")], "database string, route string, id string")
    recs = discover.number_rows(discover.ingest(spark, str(exports), searches)).cache()
    by = {r.title: r for r in recs.collect()}
    assert {"One title", "Two", "Tab one", "Tab two", "Long title goes on", "Second", "About {DNA} repair", "Stray", 'Quoted, "title"', "JSON one", "JSON two",
            "Second layout", "zipped", "in doc", "in doc 2"} <= set(by)
    assert len(by) == 21 and recs.count() == 21
    assert by["One title"].authors == ["A, B", "C, D"] and by["One title"].year == "2020" and by["One title"].pmid == "42727861"
    assert by["Two"].pmid == "77777" and by["Two"].year == "1999/01"
    assert by["Tab one"].authors == ["Roe, A", "Li, B"] and by["Tab one"].pubtypes == ["Article"] and by["Tab one"].route == "E AND I AND T"
    assert by["Long title goes on"].authors == ["Roe, A", "Li, B"] and by["Stray"].abstract == "cut" and by["Stray"].doi == "10.1/b2"
    assert by["About {DNA} repair"].abstract == "has title = {x} inside" and by["About {DNA} repair"].authors == ["Roe, A.", "Li, B."]
    assert by['Quoted, "title"'].pmid == "44444" and by['Quoted, "title"'].source_database == "Scopus"
    assert by["Second layout"].year == "2014" and by["Second layout"].search_id == "S7" and by["JSON one"].mesh == ["M"]
    rows = {r.title: r.source_row for r in recs.collect()}
    assert (rows["One title"], rows["Two"], rows["JSON one"], rows["JSON two"], rows["in doc 2"]) == (1, 2, 1, 2, 2)
    assert sorted(r.idx for r in recs.collect()) == list(range(21))
    assert deduplicate(recs).master.count() == 21


def test_bad_json_lines_are_counted(spark, exports):
    df = records.read_json(spark, str(exports / "pubmed" / "a_EI.jsonl"), records.JSON_SCHEMA)
    assert df.where(F.col(records.BAD).isNotNull()).count() == 2 and df.count() == 10


def test_ris_end_tags_and_strays(spark, exports):
    p = tagged.parse_ris(tagged.read_ris_chunks(spark, str(exports / "wos" / "x.ris")).where(F.col("chunk").rlike(tagged.RIS_TAG)))
    assert sorted((r.lenient, r.stray_tags) for r in p.collect()) == [(False, 0), (True, 0)]


def test_tsv_marks_short_lines(spark, exports):
    df = tagged.read_tsv(spark, str(exports / "wos" / "t_EI.txt"))
    assert {r.TI: r.lenient for r in df.collect()} == {"Tab one": False, "Tab two": True}


def test_xml_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<Set><PubmedArticle><MedlineCitation><PMID Version="1">123</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></PubDate></JournalIssue></Journal>
<ArticleTitle>A  title</ArticleTitle><ELocationID EIdType="doi">10.1/e</ELocationID><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText>y</AbstractText></Abstract>
<AuthorList><Author><LastName>Roe</LastName><Initials>A</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>9</PMID><Book><BookTitle>Book</BookTitle><PubDate><Year>2001</Year></PubDate><Publisher><PublisherName>P</PublisherName></Publisher></Book></BookDocument></PubmedBookArticle></Set>""")
    a = articles.article_records(articles.read_xml(spark, str(tmp_path))).collect()
    assert len(a) == 1 and (a[0].pmid, a[0].title, a[0].year, a[0].doi, a[0].abstract, a[0].authors) == ("123", "A title", "1998", "10.1/e", "AIM: x y", ["Roe A", "Group"])
    b = articles.book_records(articles.read_xml(spark, str(tmp_path), articles.BOOK_TAG, articles.BOOK_SCHEMA)).first()
    assert (b.pmid, b.title, b.year, b.journal) == ("9", "Book", "2001", "P")


def test_batches_supersede_or_fail(spark, tmp_path):
    for n, rows in {"batch_001": [("a", "IN"), ("b", "EX")], "batch_002": [("a", "EX")], "notes": [("z", "IN")]}.items():
        (tmp_path / f"{n}.json").write_text(json.dumps([{"record_id": i, "disposition": d} for i, d in rows]))
    df = runs.read_batches(spark, str(tmp_path), "record_id string, disposition string")
    last, old = runs.latest_batches(df, "record_id")
    assert {r.record_id: r.disposition for r in last.collect()} == {"a": "EX", "b": "EX"} and [r.record_id for r in old.collect()] == ["a"]
    with pytest.raises(ValueError, match="more than one batch row"):
        runs.unique_batches(df, "record_id")


def test_nested_tables_and_migration(spark):
    df = spark.createDataFrame([("R", ([(1, ("x", 2), "m")],))], "id string, tables struct<rows: array<struct<k:int, deep: struct<new_name:string, n:int>, _locators: string>>>")
    flat = nested.explode_tables(df, "id")["rows"]
    assert flat.columns == ["doc", "k", "deep.new_name", "deep.n"]
    assert nested.schema_version(df.schema["tables"].dataType["rows"].dataType.elementType, {"v2": {"new_name"}}, "v1") == "v2"
    out = nested.migrate(flat, {"deep.new_name": "old"}, available={"doc", "k", "old", "deep.n"})
    assert out.columns == ["doc", "k", "old", "deep.n"]
    with pytest.raises(ValueError, match="no destination"):
        nested.migrate(flat, {}, available={"doc", "k"})


def test_freeze_writes_once_and_detects_change(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(20)], "k int, v string")
    path = str(tmp_path / "pool")
    assert sinks.freeze(df, path, ["k"]) and not sinks.freeze(df.repartition(5), path, ["k"])
    assert sinks.verify_frozen(spark, path).count() == 20
    assert sinks.freeze(df.withColumn("v", F.coalesce("v", F.lit(""))), path, ["k"])
    df.write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="differs"):
        sinks.verify_frozen(spark, path)


def test_streams_over_several_batches(spark, tmp_path):
    schema = "k string, ts timestamp, seq int, v double"
    log = str(tmp_path / "log")

    def add(rows):
        spark.createDataFrame(rows, "k string, ts string, seq int, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(log)

    def drain():
        s = sl.read_log(spark, log, schema)
        sl.latest_state(s, ["k"], ["seq"], str(tmp_path / "state"), str(tmp_path / "c1")).awaitTermination()
        sl.totals_log(sl.read_log(spark, log, schema), "ts", ["k"], "v", str(tmp_path / "open"), str(tmp_path / "c4")).awaitTermination()
        for op, name, c in ((sl.daily_totals(sl.read_log(spark, log, schema), "ts", ["k"], "v"), "totals", "c2"), (sl.unique_intake(sl.read_log(spark, log, schema), "ts", ["k", "v"], "30 days"), "uniq", "c3")):
            sl.run_to_table(op, str(tmp_path / name), str(tmp_path / c)).awaitTermination()
    add([("a", "2024-01-01 10:00:00", 1, 1.0), ("b", "2024-01-01 11:00:00", 2, 2.0)])
    drain()
    add([("a", "2024-01-03 10:00:00", 3, 5.0), ("a", "2024-01-03 11:00:00", 4, 5.0)])
    drain()
    add([("b", "2024-01-01 12:00:00", 5, 9.0), ("c", "2024-01-09 00:00:00", 6, 1.0)])   # the first row is late
    drain()
    want = {"a": (4, 5.0), "b": (5, 9.0), "c": (6, 1.0)}
    assert {r.k: (r.seq, r.v) for r in sl.read_state(spark, str(tmp_path / "state"), ["k"], ["seq"], schema).collect()} == want
    sl.compact_state(spark, str(tmp_path / "state"), str(tmp_path / "short"), ["k"], ["seq"], schema)
    assert {r.k: (r.seq, r.v) for r in sl.read_state(spark, str(tmp_path / "short"), ["k"], ["seq"], schema).collect()} == want
    totals = {(str(r.start)[:10], r.k): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "totals")).collect()}
    assert totals == {("2024-01-01", "a"): (1, 1.0), ("2024-01-01", "b"): (1, 2.0), ("2024-01-03", "a"): (2, 10.0)}
    assert spark.read.parquet(str(tmp_path / "uniq")).count() == 5
    every = sl.read_totals(spark, str(tmp_path / "open"), ["k"])
    assert {(str(r.start)[:10], r.k): (r.n, r.total) for r in every.collect()} == {**totals, ("2024-01-09", "c"): (1, 1.0)}
    assert sl.late_rows(spark.read.schema(schema).parquet(log), every).first().late == 1
