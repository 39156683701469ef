import pytest
from pyspark.sql import functions as F

from veriframe.operators import withhold as wh

LOC = "_locators:array<struct<field:string,quote:string>>"
SCHEMA = f"id int, who string, doc struct<tables:struct<reports:array<struct<authors:string,year:int,{LOC}>>>,by:map<string,array<struct<tool:string,keep:string,{LOC}>>>>"


def frame(spark):
    loc = [("authors", "q1"), ("year", "q2"), ("authors", "q3"), (None, "q4")]
    reports = [("A B", 2020, loc), (None, None, None), None, ("WITHHELD", 1, [])]
    tools = {"x": [("t 1.2", "k", [("tool", "q"), ("keep", "q")]), None], "y": None}
    return spark.createDataFrame([(1, "me", ((reports,), tools)), (2, None, None), (3, "WITHHELD", ((None,), {}))], SCHEMA)


def test_rewrite_at_any_depth(spark):
    rules = {"who": "WITHHELD", "doc.tables.reports[].authors": "WITHHELD", "doc.tables.reports[].year": None, "doc.by{}[].tool": "NR"}
    out = wh.withhold_fields(frame(spark), rules)
    assert out.drop("withheld_values", "withheld_locators").schema.simpleString() == frame(spark).schema.simpleString()
    rows = {r.id: r.asDict(True) for r in out.collect()}
    left = [{"field": None, "quote": "q4"}]
    assert rows[1]["who"] == rows[2]["who"] == "WITHHELD"
    assert rows[1]["doc"]["tables"]["reports"] == [{"authors": "WITHHELD", "year": None, "_locators": left}, {"authors": "WITHHELD", "year": None, "_locators": None}, None,
                                                  {"authors": "WITHHELD", "year": None, "_locators": []}]
    assert rows[1]["doc"]["by"] == {"x": [{"tool": "NR", "keep": "k", "_locators": [{"field": "keep", "quote": "q"}]}, None], "y": None}
    assert rows[2]["doc"] is None and rows[3]["doc"] == {"tables": {"reports": None}, "by": {}}
    # who; two authors; two years; one tool.
    assert {i: (r["withheld_values"], r["withheld_locators"]) for i, r in rows.items()} == {1: (6, 4), 2: (1, 0), 3: (0, 0)}


@pytest.mark.parametrize("rules", [{"": "x"}, {"doc.tables[]": "x"}, {"doc.no": "x"}, {"nothing": "x"}, {"doc.tables.reports.authors": "x"}, {"doc.by[].tool": "x"},
                                   {"doc.tables": "x", "doc.tables.reports[].authors": "y"}, {"doc.tables.reports[].authors": "y", "doc.tables": "x"}])
def test_wrong_paths(spark, rules):
    with pytest.raises(ValueError):
        wh.withhold_fields(frame(spark), rules)


def test_notes(spark):
    df = spark.createDataFrame([(n,) for n in (None, "", "NR", "some", "gone. Details.", "Details.")], "n string")
    assert [r.x for r in df.select(wh.note_once(F.col("n"), "Details.").alias("x")).collect()] == ["Details.", "Details.", "Details.", "some; Details.", "gone. Details.", "Details."]
