"""Normalisers, rules and statistics on small inline frames."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from veriframe.functions import rules as ru
from veriframe.functions import similarity as sim
from veriframe.functions import stats as st
from veriframe.functions import text as tx


def values(spark, expr, rows, name="s"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col(name))).collect()]


TITLES = ["Évaluation  of IL‑6: a “pilot” study", "ﬁne ½ dose №5", "Ångström naïve CAFÉ", "", None, "ⅷ x² ㎏ Ⓐ", "İstanbul straße", "日本 test 한글"]


def python_normal(t):
    t = unicodedata.normalize("NFKD", t or "")
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isascii() and (c.isalnum()) else " " for c in t).split())


def test_title_equals_full_decomposition(spark):
    assert values(spark, tx.normalize_title, TITLES) == [python_normal(t) for t in TITLES]


def test_identifiers(spark):
    assert values(spark, tx.normalize_doi, ["https://doi.org/10.1/AbC.", "DOI: 10.2/x ", "http://dx.doi.org/10.3/y", " 10.4/z. ", None, ""]) == \
        ["10.1/abc", "10.2/x", "10.3/y", "10.4/z", "", ""]
    assert values(spark, tx.strict_numeric_id, ["PMID: 1234", "WOS:000123", "123", "1234567890", " 42727861 ", "medline 55555"]) == \
        ["1234", "", "", "", "42727861", "55555"]
    assert values(spark, tx.lenient_numeric_id, ["x 12345 y", "12", None]) == ["12345", "", ""]
    assert values(spark, tx.year_of, ["Spring 2020 Mar", "1599", "2100", "c1987"]) == [2020, None, None, 1987]


def test_surnames(spark):
    df = spark.createDataFrame([(["Müller, A.", "Ana Li", "", "müller, B"],)], "a array<string>")
    assert df.select(tx.surname_tokens(F.col("a"))).first()[0] == ["ana", "muller"]


def test_cells_and_numbers(spark):
    assert values(spark, tx.set_cell, ["b; a ;b;", "", None]) == ["a; b", "", ""]
    assert values(spark, tx.count_cell, ["12.0", "3.5", "n/a"]) == ["12", "3.5", "n/a"]
    assert values(spark, tx.parse_number, ["1,234", "-2.5e3", "7%", "about 7", "NR"]) == [1234.0, -2500.0, 7.0, None, None]


def test_time_bins_are_half_open_and_closed_at_72(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 3.0, 24.0, 72.0, 72.1)], "h double")
    assert [r[0] for r in df.select(tx.time_bin(F.col("h"))).collect()] == [
        "pre/negative", "0_to_lt30min", "30min_to_lt3h", "3h_to_lt24h", "24h_to_72h_inclusive", "24h_to_72h_inclusive", "gt72h"]


def test_rules(spark):
    assert values(spark, lambda c: ru.classify(c, [("a", "cat"), ("b", "cat|dog")]), ["dog", "CAT dog", "x"]) == ["b", "a", "other"]
    assert values(spark, lambda c: ru.matches_all_groups(c, [["immun*", "white cell"], ["run"]]),
                  ["Immunity in a run", "white-cell run", "immune running", "run"]) == [True, True, False, False]
    df = spark.createDataFrame([("digitised", ""), ("table", ""), ("", ""), ("table", "x")], "src string, tool string")
    fills = ru.fill_not_applicable({"tool": ("src", ["table"])})
    assert [r.tool for r in df.withColumns(fills).collect()] == ["", "NA", "", "x"]


def test_entity_names(spark):
    got = values(spark, lambda c: tx.normalize_entity(c, [("crp", "CRP")], ["hs-"], ["serum", "level"]), ["hs-CRP", "serum  IL-6 level", "NR", "", "serum"])
    assert got == ["CRP", "IL-6", "NR", "NR", "NR"]


@pytest.mark.parametrize("a,b", [("abcd", "abed"), ("kitten", "sitting"), ("", "x"), ("same", "same"), ("é1", "e1")])
def test_indel_ratio_is_lcs(spark, a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for ch in x:
            prev = 0
            for j, d in enumerate(y, 1):
                prev, row[j] = row[j], prev + 1 if ch == d else max(row[j], row[j - 1])
        return row[-1]
    want = 0.0 if not a or not b else 2 * lcs(a, b) / (len(a) + len(b))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(sim.indel_ratio(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_wilson_and_kappa_closed_forms(spark):
    df = spark.createDataFrame([(102, 377), (0, 0), (3, 401)], "x int, n int")
    lo, hi = st.wilson(F.col("x"), F.col("n"))
    r = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (round(r[0].lo, 3), round(r[0].hi, 3)) == (0.228, 0.318)
    assert r[1].lo is None and r[1].hi is None
    assert (round(r[2].lo, 3), round(r[2].hi, 3)) == (0.003, 0.022)
    k = spark.createDataFrame([(1.0, 1.0), (0.5, 1.0), (0.7, 0.5)], "o double, e double")
    assert [x[0] for x in k.select(st.kappa(F.col("o"), F.col("e"), "one_zero")).collect()] == [1.0, 0.0, pytest.approx(0.4)]
    assert [x[0] for x in k.select(st.kappa(F.col("o"), F.col("e"))).collect()] == [None, None, pytest.approx(0.4)]
