import random
import re
import time

from pyspark.sql import functions as F

from veriframe.operators import routes


def term_pattern(term):
    bare = term.strip().strip('"')
    words = re.findall("[A-Za-z0-9]+", bare)
    return r"\b" + r"[\s-]?".join(words) + (r"\w*" if bare.endswith("*") else r"\b")


def plain(texts, table):
    groups = {r: [re.compile("|".join(f"(?:{term_pattern(t)})" for t in g), re.I) for g in gs] for r, gs in table.items()}
    return {(i, r) for i, t in enumerate(texts) for r, gs in groups.items() if all(g.search(t or "") for g in gs)}


WORDS = ["river", "rivers", "bed", "stone", "Cold", "cold-bed", "riverbed", "il", "6", "il6", "x_y", "über", "stones"]


def some_texts(rng, n):
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "-", "  ", ", ", "\n", "", "--", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_equals_one_pattern_a_group(spark):
    rng = random.Random(2)
    terms = ["river", "river bed", "stone*", '"il 6"', "cold-bed stone", "river*", "co*", "x", "IL-6", "river bed st*"]
    texts = [*some_texts(rng, 300), None, "", "riverBED", "il-6", "x y"]
    table = {f"r{i}": [[rng.choice(terms) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))] for i in range(200)}
    got = [(r.text, r.route) for r in routes.records_on_routes(spark.createDataFrame(list(enumerate(texts)), "text int, form string"), "text", "form", table).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(texts, table)


def test_equal_groups_are_one(spark):
    forms, needs = routes.route_tables(spark, {"a": [["x"], ["y", "z"]], "b": [["z", "y"], ["X"]], "c": [["x"], ["x"]]})
    assert forms.select("group").distinct().count() == 2
    assert needs == {"a": [0, 1], "b": [0, 1], "c": [0]}


def test_no_groups_and_no_records(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    assert {tuple(r) for r in routes.records_on_routes(df, "id", "t", {"every": [], "x": [["x"]]}).collect()} == {(1, "every"), (2, "every"), (1, "x")}
    assert routes.records_on_routes(df.limit(0), "id", "t", {"x": [["x"]]}).collect() == []


def test_one_long_run_of_words(spark):
    """The work on a text grows with its words, however long its sentences are; only sequences that begin like a form make rows."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["stone", "cold", "rivers"]) for _ in range(60_000)) + " river bed old"
    df = spark.createDataFrame([(1, text), (2, text[:-4]), (3, "river")], "id int, t string")
    table = {"a": [["river bed old"], ["cold stone*"]], "b": [["bed old*"]], "c": [["riv*"]]}
    begin = time.time()
    got = {tuple(r) for r in routes.records_on_routes(df, "id", "t", table).collect()}
    assert time.time() - begin < 60
    assert got == {(1, "a"), (1, "b"), (1, "c"), (2, "c"), (3, "c")}
    heads = routes.Heads(routes.route_tables(spark, table)[0])
    assert df.select(F.explode(routes.word_sequences(F.col("t"), heads))).count() < 20
