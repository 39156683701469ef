"""Ordered operators, sampling, reconciliation, containment, diff, patch and workflow rules."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.operators import agreement as ag
from veriframe.operators import containment as ct
from veriframe.operators import diff as df_
from veriframe.operators import joins as jn
from veriframe.operators import ordered as od
from veriframe.operators import patch as pt
from veriframe.operators import reconcile as rc
from veriframe.operators import redact as rd
from veriframe.operators import sampling as sp
from veriframe.operators import setops as so
from veriframe.operators import tables as tb
from veriframe.operators import validate as va
from veriframe.operators import workflow as wf

c = F.col


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group, one group key is NULL, and values repeat."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 3 + ["a", "b", None]), rng.randrange(1000), float(rng.randrange(50))) for i in range(2000)]
    return spark.createDataFrame(rows, "id bigint, g string, x int, v double").cache()


def test_row_numbers_equal_one_window(skewed):
    got = od.row_numbers(skewed, ["x", "id"], F.floor(c("x") / 10), ["g"]).withColumn("w", F.row_number().over(W.partitionBy("g").orderBy("x", "id")))
    assert got.count() == 2000 and got.where("rn <> w").count() == 0
    whole = od.row_numbers(skewed, ["id"], od.id_bucket("id", 64)).withColumn("w", F.row_number().over(W.orderBy("id")))
    assert whole.where("rn <> w").count() == 0


def test_previous_crosses_buckets(skewed):
    p = od.previous(skewed, "v", ["x", "id"], F.floor(c("x") / 7), ["g"])
    assert p.withColumn("w", F.lag("v").over(W.partitionBy("g").orderBy("x", "id"))).where("NOT (prev <=> w)").count() == 0


def test_latest_and_superseded_split_the_log(skewed):
    last, old = od.latest(skewed, ["g"], ["x", "id"]), od.superseded(skewed.where("g IS NOT NULL"), ["g"], ["x", "id"])
    assert last.count() == 4 and old.count() == skewed.where("g IS NOT NULL").count() - 3


def test_sample_is_an_exact_seeded_fraction_of_a_hot_stratum(skewed):
    s = sp.sample_strata(skewed.where("g IS NOT NULL"), ["g"], "id", 0.1, 7)
    n = {r.g: r["count"] for r in skewed.where("g IS NOT NULL").groupBy("g").count().collect()}
    k = {r.g: r["count"] for r in s.groupBy("g").count().collect()}
    assert k == {g: round(v * 0.1) for g, v in n.items()}
    again = sp.sample_strata(skewed.where("g IS NOT NULL").repartition(7), ["g"], "id", 0.1, 7)
    assert {r.id for r in s.collect()} == {r.id for r in again.collect()}
    two = sp.sample_round(skewed.where("g IS NOT NULL"), s, ["g"], "id", 0.1, 7, 2)
    assert not {r.id for r in s.collect()} & {r.id for r in two.collect()}


def test_batches_and_continued_ids(spark):
    df = spark.range(450).select(c("id"))
    n = {r.batch: r["count"] for r in sp.batches(df, "id", 200, 3).groupBy("batch").count().collect()}
    assert n == {3: 200, 4: 200, 5: 50}
    old = spark.createDataFrame([("FTR-009",), ("FTR-012",), ("other",)], "rid string")
    new = sp.continue_ids(old, "rid", spark.range(3).withColumnRenamed("id", "k"), "k", "FTR-")
    assert [r.rid for r in new.orderBy("k").collect()] == ["FTR-013", "FTR-014", "FTR-015"]


def pairs(spark, table):
    return spark.createDataFrame([(a, b) for a, b, n in table for _ in range(n)], "a string, b string")


def test_kappa_textbook_table(spark):
    r = ag.kappa_table(pairs(spark, [("y", "y", 20), ("y", "n", 5), ("n", "y", 10), ("n", "n", 15)]), "a", "b").first()
    assert (r.n, r.p_o) == (50, 0.7) and r.kappa == pytest.approx(0.4)


def test_kappa_degenerate_and_blank(spark):
    same = pairs(spark, [("y", "y", 5)])
    assert ag.kappa_table(same, "a", "b").first().kappa is None
    assert ag.kappa_table(same, "a", "b", degenerate="one_zero").first().kappa == 1.0
    some = spark.createDataFrame([("y", None), ("", "n"), ("y", "y")], "a string, b string")
    assert ag.kappa_table(some, "a", "b").first().n == 2
    assert ag.kappa_table(some, "a", "b", blank="BLANK").first().n == 3


def test_kappa_stays_in_bounds(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(g, rng.choice("xyz"), rng.choice("xyz")) for g in "abcdefgh" for _ in range(30)], "g string, a string, b string")
    assert all(-1 <= r.kappa <= 1 for r in ag.kappa_table(df, "a", "b", ["g"]).collect())


def test_calibration_verdicts(spark):
    df = pairs(spark, [("y", "y", 9), ("y", "n", 1)])
    assert ag.calibration(df, "a", "b", 50, 0.8).first().status == "INCOMPLETE: 10/50 jointly assessed"
    assert ag.calibration(df, "a", "b", 10, 0.8).first().status == "PASS"
    assert ag.calibration(df, "a", "b", 10, 0.95).first().status == "NOT_PASSED"


def test_strict_pairing_rejects_unequal_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, d string")
    assert rc.pair_raters_strict(a, a, "id").count() == 2
    with pytest.raises(ValueError, match="ids only in a"):
        rc.pair_raters_strict(a, a.where("id = 1"), "id")
    with pytest.raises(ValueError, match="repeated id"):
        rc.pair_raters_strict(a.union(a), a, "id")


def paired(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, decision_a string, decision_b string, code_a string, code_b string")


def test_dual_merge_sources(spark):
    df = paired(spark, [("IN", "IN", None, None), ("EX", "EX", "C1", "C2"), ("IN", "EX", None, "C1"), ("IN", None, None, None), (None, None, None, None), ("EX", "EX", "C1", "C1")])
    res = spark.createDataFrame([(2, "EX", "C1")], "id int, final string, final_code string")
    got = {r.id: (r.conflict, r.final, r.final_code, r.final_source) for r in rc.dual_merge(df, {"IN": "on", "EX": "off"}, ["EX"], res).collect()}
    assert got == {0: (False, "IN", None, "agreement"), 1: (True, None, None, "unresolved_conflict"), 2: (True, "EX", "C1", "reconciled"),
                   3: (False, None, None, "awaiting_second_decision"), 4: (False, None, None, "not_decided"), 5: (False, "EX", "C1", "agreement")}


def test_advance_wins(spark):
    df = paired(spark, [("EX", "EX", "C2", "C1"), ("EX", "GO", "C1", None), ("EX", "WAIT", "C1", None), ("EX", None, "C1", None), ("EX", "EX", "C9", None)])
    f, k = rc.advance_wins(c("decision_a"), c("decision_b"), c("code_a"), c("code_b"), "GO", "EX", "WAIT", ["C1", "C2"])
    assert [tuple(r) for r in df.select(f, k).collect()] == [("EX", "C1"), ("GO", None), ("WAIT", None), (None, None), ("EX", None)]


def test_funnel_shows_no_number_for_an_open_stage(spark):
    done = spark.createDataFrame([(1, "IN"), (2, "EX")], "id int, final string")
    item = {"in": c("final") == "IN", "never": c("final") == "ZZ"}
    assert [(r.value, r.status) for r in rc.stage_metrics(done, "s", "final", item).orderBy("item").collect()] == [(1, "COMPLETE"), (0, "COMPLETE")]
    part = done.union(spark.createDataFrame([(3, None)], "id int, final string"))
    assert {(r.value, r.status) for r in rc.stage_metrics(part, "s", "final", item).collect()} == {(None, "INCOMPLETE")}
    assert {(r.value, r.status) for r in rc.stage_metrics(done.limit(0), "s", "final", item).collect()} == {(None, "NOT_YET_PERFORMED")}


def test_layers(spark):
    df = spark.createDataFrame([("present", "present", False, False), ("absent", "absent", False, False), ("absent", "absent", True, True), ("present", "absent", False, False),
                                ("unclear", "unclear", False, False), ("present", "present", True, False)], "ka string, kb string, fa boolean, fb boolean")
    assert [r[0] for r in df.select(rc.two_model_layer({"x": c("fa")}, {"x": c("fb")}, c("ka"), c("kb"))).collect()] == ["V", "M", "X", "D", "D", "D"]
    assert [r[0] for r in df.select(rc.final_layer([c("fa")], c("ka"), F.lit(True))).collect()] == ["V", "M", "X", "V", "U", "X"]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "cell", "of", "run", "acute", "and", "blood", "in", "count"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(n)]


def test_containment_equals_scan(spark):
    docs = texts(1, 60)
    quotes = [" ".join(d.split()[i:i + 5]) for i, d in enumerate(docs[:20])] + ["ell of run acu", "the the the the the the", "too short quote"] + texts(2, 10)
    quotes += [docs[3][2:-2], docs[4][1:25]]
    dd = spark.createDataFrame(list(enumerate(docs)), "d int, t string")
    qq = spark.createDataFrame(list(enumerate(quotes)), "q int, s string")
    got = {(r.q, r.d) for r in ct.locate_verbatim(qq, "q", "s", dd, "d", "t").collect()}
    want = {(i, j) for i, q in enumerate(quotes) for j, d in enumerate(docs) if q.split() and " ".join(q.lower().split()) in d}
    assert want and got == want

    def big(s):
        w = s.split()
        return {(w[i], w[i + 1]) for i in range(len(w) - 1)}
    share = {(r.q, r.d): round(r.share, 9) for r in ct.bigram_share(qq, "q", "s", dd, "d", "t").collect()}
    want = {(i, j): round(len(big(q) & big(d)) / len(big(q)), 9) for i, q in enumerate(quotes) for j, d in enumerate(docs) if big(q) and len(big(q) & big(d)) / len(big(q)) >= 0.75}
    assert want and share == want


def test_quote_on_its_page_near_it_or_elsewhere(spark):
    pages = spark.createDataFrame([(1, 1, "alpha beta gamma delta epsilon"), (1, 2, "one two three four five six"), (1, 3, "filler"), (1, 5, "cell count rose after the acute bout-\n ing")],
                                  "doc int, page int, text string")
    quotes = spark.createDataFrame([("a", 1, 1, "Beta  gamma"), ("b", 1, 1, "two three four"), ("c", 1, 1, "count rose after the"), ("d", 1, 2, "one two three four five seven"), ("e", 1, 2, "nothing like it here")],
                                   "q string, doc int, page int, quote string")
    got = {r.q: r.found for r in ct.locate_on_page(quotes, pages, "q", "doc", "page", "quote", "text").collect()}
    assert got == {"a": "exact", "b": "exact", "c": "wrong_page", "d": "fuzzy", "e": "not_found"}


def test_misses_do_not_collect_the_pages_of_their_document(spark):
    lines = [f"line {i} of a long text with word{i} word{i + 1} in it" for i in range(40)] + ["", None, "once"]
    pages = spark.createDataFrame([(d, i + 1, x) for d in (1, 2) for i, x in enumerate(lines)], "doc int, page int, text string")
    quotes = spark.createDataFrame([("far", 1, 30, "with word3 word4 in"), ("pairs", 1, 30, "of a long text with word3 word4 wordx"), ("one", 2, 1, "once"), ("no", 2, 1, "twice"), ("lost", 3, 1, "once"), ("null", 1, 1, None)],
                                   "q string, doc int, page int, quote string")
    out = ct.locate_on_page(quotes, pages, "q", "doc", "page", "quote", "text")
    assert {r.q: r.found for r in out.collect()} == {"far": "wrong_page", "pairs": "wrong_page", "one": "wrong_page", "no": "not_found", "lost": "not_found", "null": "exact"}
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_slots_and_column_plan():
    names = ["id", "rater_A", "rater_B", "x.A.y", "x.B.y", "page_locator", "other_notes"]
    assert df_.slot_pairs(names) == {"rater_A": "rater_B", "x.A.y": "x.B.y"}
    plan = df_.compared_columns({n: "free_text" for n in names}, skip={"id"})
    assert [(m["a"], m["b"]) for m in plan] == [("rater_A", "rater_B"), ("x.A.y", "x.B.y")]


def test_align_content_then_ordinal(spark):
    cols = "report string, n int, kind string, val string"
    a = spark.createDataFrame([("R", 1, "Saliva ", "1"), ("R", 2, "serum", "2"), ("R", 3, "serum", "3"), ("R", 4, "urine", "4"), ("S", 5, "x", "5")], cols)
    b = spark.createDataFrame([("R", 1, "serum", "2"), ("R", 2, "SALIVA", "1"), ("R", 3, "tears", "4"), ("S", 4, "x", "6")], cols)
    al = df_.align(a, b, ["n"], "report", ["n"], F.lit(0), ["kind"])
    got = {(r.how, r.a.n if r.a else None, r.b.n if r.b else None) for r in al.collect()}
    assert got == {("content", 1, 2), ("content", 2, 1), ("content", 5, 4), ("ordinal", 3, 3), ("only_a", 4, None)}
    cells = df_.cells(al, [{"name": "val", "a": "val", "b": "val", "kind": "count", "family": "f", "is_list": False}], "t")
    roll = {(r.table, r.field): r for r in df_.diff_rollup(cells).collect()}
    assert (roll[("ALL", "ALL")].agree, roll[("ALL", "ALL")].disagree, roll[("ALL", "ALL")].both_filled) == (2, 2, 0.5)


def test_align_falls_back_to_ordinals(spark):
    a = spark.createDataFrame([(i, "p") for i in range(10)], "k int, parent string")
    few = a.withColumn("k", c("k") + 8)
    assert {r.how for r in df_.align(a, few, ["k"], "parent", ["k"], F.lit(0)).collect()} == {"ordinal"}
    assert {r.how for r in df_.align(a, a.where("k < 9"), ["k"], "parent", ["k"], F.lit(0)).collect()} == {"key", "only_a"}


def test_rounding_agreement(spark):
    df = spark.createDataFrame([("1.20", "1.2"), ("1.24", "1.2"), ("1.26", "1.2"), ("1,000", "1000"), ("x", "1"), ("5%", "5")], "a string, b string")
    assert [r[0] for r in df.select(df_.within_rounding(c("a"), c("b"))).collect()] == [True, True, False, True, None, True]


def test_patch_is_all_or_nothing_and_loses_no_row(spark):
    base = spark.createDataFrame([("R", "M-1", 1, "a", 5), ("R", "M-2", 2, "b", 6), ("S", "M-9", 9, "c", 7)], "rec string, row string, num int, label string, size int")
    none = (None, None, None, False)
    ups = spark.createDataFrame([("R", "M-1", "label", "A", *none[1:], True), ("R", "M-2", "size", None, 8, None, False, True), ("S", "M-9", "label", "C", *none[1:], False)],
                                "rec string, row string, field string, value_text string, value_integer bigint, value_list array<string>, set_null boolean, supported boolean")
    adds = spark.createDataFrame([("R", "M-3", 3, "new", 1, True), ("S", "M-8", 8, "c", 7, True)], "rec string, row string, num int, label string, size int, supported boolean")
    bad = pt.rejects([pt.update_errors(ups, base, "rec", "row"), pt.addition_errors(adds, base, "rec", "row", "num", ["label", "size"])], "rec")
    assert {r.rec: r.errors for r in bad.collect()} == {"S": "exact duplicate values: M-8; id does not continue: M-8; quote not found: M-9/label"}
    out = pt.apply_patch(base, ups, adds.drop("supported"), bad, "rec", "row", ["label", "size"])
    assert sorted(tuple(r) for r in out.collect()) == [("R", "M-1", 1, "A", 5), ("R", "M-2", 2, "b", 8), ("R", "M-3", 3, "new", 1), ("S", "M-9", 9, "c", 7)]
    null = ups.limit(0).union(spark.createDataFrame([("R", "M-1", "label", None, None, None, True, True)], ups.schema))
    got = pt.apply_patch(base, null, None, bad.limit(0), "rec", "row", ["label", "size"]).where("row = 'M-1'").first()
    assert got.label is None


def test_guarded_load_and_overwrite(spark):
    cur = spark.createDataFrame([(1, "Title", "", "keep")], "k int, title string, design string, state string")
    inc = spark.createDataFrame([(1, "Other", "rct; odd", "new", "z")], "k int, title string, design string, state string, extra string")
    act = pt.load_actions(cur, inc, "k", ["title", "design", "state"], ["title"], ["state"], {"design": ["rct"]})
    assert {r.field: r.action for r in act.collect()} == {"title": "locked_mismatch", "design": "write_out_of_vocabulary", "state": "refused", "extra": "unknown_field"}
    assert tuple(pt.apply_load(cur, act, "k", ["title", "design", "state"]).first()) == (1, "Title", "rct; odd", "keep")
    prop = spark.createDataFrame([("a", "m"), ("b", "human"), ("c", "")], "k string, current string")
    audit = spark.createDataFrame([("a", "old", 1), ("a", "m", 2), ("b", "m", 1)], "k string, value string, at int")
    assert {r.k: r.allowed for r in pt.overwrite_guard(prop, audit, ["k"], ["at"]).collect()} == {"a": True, "b": False, "c": True}


def test_fill_only_blank(spark):
    rows = spark.createDataFrame([(1, "has", "", "9", ""), (2, "", "", "1", ""), (3, " ", "", "", "d3"), (4, "", "", "", "d4"), (5, "", "", "", ""), (6, None, "", "7", "")],
                                 "k int, abstract string, src string, pmid string, doi string")
    val = spark.createDataFrame([("1", "text1"), ("33", "text3")], "id string, value string")
    m = spark.createDataFrame([("d3", "33")], "alt string, id string")
    got = {r.k: (r.abstract, r.pmid, r.route, r.reason) for r in wf.fill_blank(rows, "abstract", "src", "pmid", "doi", val, m).collect()}
    assert got == {1: ("has", "9", "already_filled", ""), 2: ("text1", "1", "filled_by_id", ""), 3: ("text3", "33", "filled_by_alt", ""),
                   4: ("", "", "", "alternative_id_not_mapped"), 5: ("", "", "", "no_identifier"), 6: (None, "7", "", "id_without_value")}


def test_unknown_usage_is_not_zero(spark):
    from veriframe.operators import ledger as lg
    log = spark.createDataFrame([("s", "5"), ("s", "x"), ("t", None)], "stage string, n string")
    got = {r.stage: (r.known, r.unknown) for r in lg.usage_totals(log, c("n").try_cast("bigint"), [["stage"], []], ["stage"]).collect()}
    assert got == {"s": (5, 1), "t": (None, 1), "ALL": (5, 2)}


def test_waterfall_takes_the_first_rule(spark):
    pool = spark.createDataFrame([(1, "p1", "d1", "t1"), (2, "p2", "d1", "t2")], "k int, p string, d string, t string")
    inc = spark.createDataFrame([(10, "p2", "d1", "t1"), (11, "", "d1", "t2"), (12, "", "", "t2"), (13, "", "", "")], "k int, p string, d string, t string")
    got = {r.k: (r.matched, r.rule) for r in jn.match_waterfall(inc, pool, "k", "k", [("id", "p", "p"), ("doi", "d", "d"), ("title", "t", "t")]).collect()}
    assert got == {10: (2, "id"), 11: (1, "doi"), 12: (2, "title"), 13: (None, "none")}


def test_partition_proofs(spark):
    whole = spark.range(10)
    ok = {r.check_name: r.holds for r in so.partition_proof([whole.where("id < 4"), whole.where("id >= 4")], whole, "id").collect()}
    bad = {r.check_name: r.holds for r in so.partition_proof([whole.where("id < 5"), whole.where("id BETWEEN 4 AND 8"), spark.range(20, 21)], whole, "id").collect()}
    assert ok == {"disjoint": True, "covering": True, "no_extra": True} and bad == {"disjoint": False, "covering": False, "no_extra": False}


def test_redaction(spark):
    text = ("[[page 1]]\nTitle by Roe\nabstract\nBody Smith et al. found. mail a.b@x.org doi:10.1234/zz end\n[[page 2]]\nDoe et al.: header\nmore text\nAcknowledgements\nthanks to Ann\n"
            "Discussion\nkept Lee (2019) text\nline\nline\nline\nreferences\n1. a\n2. b\n")
    out = spark.createDataFrame([(text,)], "t string").select(rd.redact(c("t"))).first()[0]
    for gone in ("Roe", "a.b@x.org", "10.1234", "Smith", "Doe et al", "Ann", "Lee (2019)", "1. a"):
        assert gone not in out, gone
    for kept in ("Body", "more text", "Discussion", "kept", "[[page 2]]", "[reference list redacted]"):
        assert kept in out, kept


def test_trim_keeps_whole_texts(spark):
    t = "\n".join(["header"] * 5 + [f"line {i}" for i in range(20)] + ["Funding", "by x", "Results", "tail"] + ["References", "a ref"])
    got = rd.trim_boilerplate(spark.createDataFrame([(1, t), (2, "x\n" * 6 + "x")], "k int, t string"), "k", "t")
    r = {x.k: (x.t, x.dropped_lines) for x in got.collect()}
    assert r[1] == ("\n".join([*[f"line {i}" for i in range(20)], "Results", "tail"]), 5)
    assert r[2] == ("", 7)


def test_scrub_walks_nested_values_but_keeps_listed_fields(spark):
    df = spark.createDataFrame([("a@b.org", {"title": "a@b.org", "n": "a@b.org"}, [("k", ["secret: abc"])])],
                               "s string, m map<string,string>, x array<struct<title:string,ys:array<string>>>")
    r = rd.scrub_all(df).first()
    assert r.s == "[contact withheld]" and r.m == {"title": "a@b.org", "n": "[contact withheld]"} and r.x[0].ys == ["[credential withheld]"]


def test_validation_lists_every_problem(spark):
    df = spark.createDataFrame([("", "z", "abcdef"), ("1", "a", "abc")], "id string, k string, t string")
    v = va.validate(df, va.schema_checks(["id"], {"k": ["a"]}, {"t": 4}, {"id": "int"})).collect()
    assert v[0].errors == ["id: missing", "k: not in list", "t: longer than 4", "id: not int"] and v[1].valid


def test_coverage_keeps_zero_cells_and_totals(spark):
    df = spark.createDataFrame([("f1", "b1", 1), ("f1", "b1", 1), ("f2", "b1", 1), ("f2", "b2", 2)], "fam string, bin string, u int")
    got = {r.fam: (r.b1, r.b2, r.b3) for r in tb.coverage_matrix(df, "fam", "bin", ["f1", "f2", "f3", "ALL"], ["b1", "b2", "b3"], "u").collect()}
    assert got == {"f1": (1, 0, 0), "f2": (1, 1, 0), "f3": (0, 0, 0), "ALL": (1, 1, 0)}
