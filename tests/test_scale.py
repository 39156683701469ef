"""What must hold at any size: no caps, no overflow, no collisions, no quadratic candidates."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.operators import diff as df_
from veriframe.operators import fuzzy as fz
from veriframe.operators import joins as jn
from veriframe.operators import redact as rd
from veriframe.operators import validate as va
from veriframe.operators import workflow as wf
from veriframe.operators.skew import attach_per_key
from veriframe.sources import records, runs, sinks

c = F.col


def test_rounding_agreement_at_any_number_of_decimals(spark):
    rows = [("1.12345678901", "1.123456789014"), ("1.12345678901", "1.12345678902"), ("2.675", "2.67"), ("2.675", "2.68"), ("1.1234567890123456789012", "1.1234567890123456789013"), ("0.5", "0"), ("1.5", "2"), ("1.26", "1.2")]
    rng = random.Random(1)
    for _ in range(300):
        d = rng.randrange(0, 9)
        a = f"{rng.uniform(0, 50):.{d}f}5"
        rows.append((a, f"{round(float(a), d):.{d}f}"))
        rows.append((a, f"{float(a) + 10.0 ** -d:.{d}f}"))
    df = spark.createDataFrame(rows, "a string, b string")
    places = lambda s: len(s.partition(".")[2])
    want = [round(float(a), n) == round(float(b), n) for a, b in rows for n in [min(places(a), places(b))]]
    assert [r[0] for r in df.select(df_.within_rounding(c("a"), c("b"))).collect()] == want
    assert want[:8] == [True, False, True, False, True, True, True, False]


def test_null_parents_pair(spark):
    a = spark.createDataFrame([(None, 1, "x"), ("p", 2, "y"), (None, 3, "z")], "parent string, k int, v string")
    got = df_.align_by_ordinal(a, a, "parent", ["k"], F.lit(0)).collect()
    assert sorted((r.how, r.a.k, r.b.k) for r in got) == [("ordinal", 1, 1), ("ordinal", 2, 2), ("ordinal", 3, 3)]
    by_key = df_.align_by_key(a, a, ["parent"], ["k"]).collect()
    assert [r.how for r in by_key] == ["key", "key"]


def test_digest_separates_cells_and_does_not_overflow(spark):
    def digest(rows):
        return sinks.fingerprint(spark.createDataFrame(rows, "a string, b string")).first().digest
    assert digest([("a|=b", "c")]) != digest([("a", "b|=c")]) and digest([("a", None)]) != digest([("a", "")]) != digest([("a", "~")])
    parts = [int(x) for x in sinks.fingerprint(spark.range(50)).first().digest.split("-")]
    assert len(parts) == 4 and max(parts) > 2 ** 63


def test_many_document_files(spark, tmp_path):
    for i in range(65):
        (tmp_path / f"d{i:02}.json").write_text(json.dumps({"records": [{"k": i}, {"k": 1000 + i}]}, indent=1))
    got = records.read_json(spark.newSession(), str(tmp_path), T.StructType([T.StructField("k", T.LongType())]))
    rows = got.select("source_file", "source_seq", "k").collect()
    assert sorted(r.k for r in rows) == sorted([*range(65), *range(1000, 1065)]) and len({(r.source_file, r.source_seq) for r in rows}) == 130
    first = {r.source_file: r.source_seq for r in rows if r.k < 65}
    assert all(first[r.source_file] < r.source_seq for r in rows if r.k >= 1000)


def test_batch_numbers_past_999(spark, tmp_path):
    for name, v in (("batch_002.json", 2), ("batch_999.json", 999), ("batch_1000.json", 1000), ("other.json", 5)):
        (tmp_path / name).write_text(json.dumps([{"id": 1, "v": v}]))
    rows = runs.read_batches(spark, str(tmp_path), "id int, v int")
    assert sorted(r.v for r in rows.collect()) == [2, 999, 1000]
    kept, old = runs.latest_batches(rows, "id")
    assert [r.v for r in kept.collect()] == [1000] and sorted(r.v for r in old.collect()) == [2, 999]
    assert kept.columns == rows.columns


def test_hot_keys_are_dealt_by_their_count(spark):
    rows = spark.range(3000).select(F.when(c("id") < 2000, 0).when(c("id") < 2500, 1).otherwise(c("id")).alias("k"), "id")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = attach_per_key(rows, per, ["k"], "n", limit=100)
    assert sorted(map(tuple, got.select("k", "id", "n").collect())) == sorted(map(tuple, rows.join(per, "k").select("k", "id", "n").collect()))
    assert sorted(map(tuple, attach_per_key(rows, per.where("k = 0"), ["k"], "n", limit=100, how="left").groupBy("k").count().where("k < 2").collect())) == [(0, 2000), (1, 500)]


def test_back_matter_keeps_blank_lines(spark):
    texts = [("Body\n\n\nFunding: x\n\n[[page 2]]",), ("Body\n\nFunding: x\n\n\nResults\nmore",)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(rd.drop_back_matter(c("t"))).collect()]
    assert got[0] == "Body\n\n\n[[page 2]]" and got[1] == "Body\n\nResults\nmore"


def test_repeated_lines_inside_a_row(spark):
    text = "\n".join(["Head", " running head ", "a", "running head", "b", "running head", "running head", "running head", "running head", "Head", "", "", "", "", "", "", ""])
    df = spark.createDataFrame([(1, text), (2, "x\n" * 6 + "x"), (3, ""), (4, None), (1, text)], "k int, t string")
    got = {r.k: (r.t, r.dropped_lines) for r in rd.drop_repeated_lines(df, "k", "t", times=6).collect()}
    assert got[1] == ("Head\na\nb\nHead\n\n\n\n\n\n\n", 6) and got[2] == ("", 7) and got[3] == ("", 0)


def test_a_common_head_proposes_nothing(spark):
    """Titles from one template: the rows on which titles meet grow with their number, not with its square."""
    head = "assessment of long term outcomes after the standard intervention in "
    met = {}
    for n in (400, 3200):
        rng = random.Random(n)
        rows = [(i, "b", head + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))) for i in range(n)]
        t = spark.createDataFrame(rows, "title_id long, block string, title string").withColumn("len", F.length("title"))
        grams = fz.rare_grams(t, "levenshtein", 0.95).groupBy("block", "gram").count()
        met[n] = grams.agg(F.sum(c("count") * (c("count") - 1) / 2)).first()[0] or 0
        assert met[n] < 12 * n
        assert fz.similar_titles(t.drop("len"), "levenshtein", 0.95).count() == 0


def test_long_titles_have_few_rows(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(1000))
    rows = [(1, "b", text), (2, "b", text[:500] + "x" + text[501:]), (3, "b", text[::-1])]
    t = spark.createDataFrame(rows, "title_id long, block string, title string")
    per = fz.rare_grams(t.withColumn("len", F.length("title")), "indel", 0.95).groupBy("title_id").count().agg(F.max("count")).first()[0]
    assert per <= 4 * 105 + 1
    assert [(r.id_a, r.id_b) for r in fz.similar_titles(t, "indel", 0.95).collect()] == [(1, 2)]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_join_sends_no_side_through_the_driver(spark):
    pts = spark.range(50).select(F.lit("a").alias("g"), F.col("id").alias("at"))
    wins = spark.range(20).select(F.lit("a").alias("g"), F.col("id").alias("s"), (F.col("id") + 3).alias("e"))
    out = jn.interval_join(pts, wins, ["g"], "at", "s", "e")
    assert "Broadcast" not in planned(out) and out.count() == 80


def test_paired_quality_joins_nothing(spark):
    old = [(1, "x", None), (1, "x", 1), (1, "y", 2), (2, "x", None), (None, "x", 1), (4, "z", None)]
    new = [(1, "x", 5), (1, "w", None), (3, "x", None), (None, "x", None), (4, "x", None)]
    frames = [spark.createDataFrame(r, "p int, g string, v int") for r in (old, new)]
    out = wf.paired_quality(*frames, "p", ["g"], "v")
    assert {tuple(r) for r in out.collect()} == {("x", 2, 50.0, 50.0), ("y", 0, 0.0, None), ("w", 1, None, 100.0), ("z", 0, 100.0, None)}
    assert "Join" not in planned(out)


def test_content_alignment_shuffles_once_and_large_parents_in_buckets(spark, monkeypatch):
    rng = random.Random(6)
    sides = [[(rng.choice(["p", "q", None]), rng.choice("xyz"), i % 7, f"{s}{i}") for i in range(60)] for s in "ab"]
    a, b = (spark.createDataFrame(r, "parent string, k string, o int, id string") for r in sides)
    run = lambda: df_.align_by_content(a, b, "parent", ["k"], ["o", "id"], c("o"))
    got = lambda d: sorted((r.how, r.a and r.a.id or "", r.b and r.b.id or "") for r in d.collect())
    small = run()
    assert planned(small).count("Exchange") == 1
    rows = got(small)
    assert {r[0] for r in rows} >= {"content", "ordinal"} and sorted(x for r in rows for x in r[1:] if x) == sorted(r[3] for s in sides for r in s)
    for most in (0, 41):
        monkeypatch.setattr(df_, "HOT_PARENT", most)
        assert got(run()) == rows


def test_keys_are_dealt_by_the_rows_of_a_table(spark, monkeypatch):
    """No task counts more keys as a table grows: the tasks follow its rows, and the results stay."""
    child = spark.range(900).select((c("id") % 300).alias("fk"), F.when(c("id") % 9 > 0, c("id") % 450).alias("pk"))
    parent = spark.range(7, 280).select(c("id").alias("k"))

    def run():
        gaps, twice = va.foreign_key_gaps(child, ["fk"], parent, ["k"], "g"), va.duplicate_keys(child, ["pk"], "d")
        return planned(gaps), planned(twice), [sorted(map(tuple, d.collect())) for d in (gaps, twice)]

    *_, whole = run()
    monkeypatch.setattr(va, "ROWS_A_TASK", 50)
    gaps, twice, dealt = run()
    assert dealt == whole and whole[0] == sorted(("g", str(i), 3) for i in [*range(7), *range(280, 300)])
    for plan in (gaps, twice):
        assert ", 18), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("short", [255, 30])
def test_titles_rank_their_grams_by_sorting(spark, monkeypatch, short):
    monkeypatch.setattr(fz, "SHORT", short)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    rows = [(i, "the", "the " + " ".join(rng.choice(words) for _ in range(7))) for i in range(300)]
    rows += [(300 + i, "the", t[:9] + "zz" + t[11:]) for i, (_, _, t) in enumerate(rows[:20])] + [(900, None, rows[0][2]), (901, None, rows[0][2] + "s")]
    t = spark.createDataFrame(rows, "title_id long, block string, title string")
    grams = fz.rare_grams(t.withColumn("len", F.length("title")), "levenshtein", 0.8)
    assert "ObjectHashAggregate" not in planned(grams) and dict(grams.dtypes)["gram"] == "bigint"
    found = {(r.id_a, r.id_b) for r in fz.similar_titles(t, "levenshtein", 0.8).collect()}
    a, b = t.where("block IS NOT NULL").toDF("i", "x", "p"), t.where("block IS NOT NULL").toDF("j", "y", "q")
    near = F.lit(1) - F.levenshtein("p", "q") / F.greatest(F.length("p"), F.length("q")) >= 0.8 - 1e-12
    want = {(r.i, r.j) for r in a.join(b, (c("i") < c("j")) & near).select("i", "j").collect()}
    assert found == want and {(i, 300 + i) for i in range(20)} <= want
