import json
import random

from pyspark.sql import functions as F

from veriframe.functions import fixed_values as fv
from veriframe.operators.json_totals import json_class_totals, json_leaves


def plain(doc):
    """The sums by recursion over the parsed document."""
    try:
        data = json.loads(doc)
    except (ValueError, TypeError):
        return (0, 0, 0, 0, None)

    def label(k):
        return next((c for c, names in fv.TOKEN_CLASSES.items() if any(k == n or k.endswith("_" + n) for n in names)), None)

    def walk(x, out):
        if isinstance(x, dict):
            for k, v in x.items():
                if isinstance(v, (int, float)) and not isinstance(v, bool) and label(k):
                    out[label(k)] += int(v)
                else:
                    walk(v, out)
        elif isinstance(x, list):
            for v in x:
                walk(v, out)
        return out

    zero = lambda: dict.fromkeys(fv.TOKEN_CLASSES, 0)
    own = zero()
    for k in fv.TOTALS_BLOCKS:
        if isinstance(data, dict) and isinstance(data.get(k), dict):
            walk(data[k], own)
    every = walk(data, zero())
    out, method = (own, "totals block") if sum(own.values()) else (every, "summed per-record" if sum(every.values()) else None)
    return (out["input"], out["reasoning"], out["output"], out["input"] + out["output"], method)


def some_json(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([1, 2.9, -3, 0, True, None, "7", "}{", 'q"]', 10**12])
    if kind < 0.5:
        return [some_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    names = ["input_tokens", "my_input", "inputs", "output", "reasoning_tokens", "x", "totals", "usage", "tokens", "tokens_out", "key", "value"]
    return {k: some_json(rng, depth - 1) for k in rng.sample(names, rng.randrange(5))}


def test_totals_equal_recursion(spark):
    rng = random.Random(3)
    docs = [json.dumps(some_json(rng, rng.randrange(1, 7))) for _ in range(400)]
    docs += [None, "", "{bad", "5", "[]", "{}", '{"totals":{"input":5},"rows":[{"input":2},{"input":3}]}', '{"totals":{"input":0},"rows":[{"input":2}]}', "[" * 60 + "]" * 60]
    got = json_class_totals(spark.createDataFrame(list(enumerate(docs)), "id int, value string"), ["id"], "value").collect()
    assert {r.id: tuple(r)[1:] for r in got} == {i: plain(d) for i, d in enumerate(docs)}


def test_leaves_of_other_columns(spark):
    df = spark.createDataFrame([("a", "b", '{"k":[1,{"m":"x"}]}'), ("a", None, "nope")], "key string, pos string, j string")
    got = {(r.key, r.pos, r.top, r["name"], str(r.leaf)) for r in json_leaves(df, ["key", "pos"], "j").selectExpr("key", "pos", "top", "name", "to_json(leaf) AS leaf").collect()}
    assert got == {("a", "b", "k", None, "1"), ("a", "b", "k", "m", '"x"'), ("a", None, None, None, "None")}
    assert json_class_totals(df.limit(0), ["key"], "j").collect() == []


def test_documents_are_made_once(spark):
    """The text of a document is worked out once, however often its leaves are read; long strings and many flat members do not deepen it."""
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return json.dumps({"totals": {"input": i}, "rows": [{"output": 1}] * 50, "s": '\\"[{' * 20_000})

    df = spark.range(40).select("id", F.udf(text, "string")("id").alias("value")).repartition(2)
    got = {tuple(r)[:2] + (r.method,) for r in json_class_totals(df, ["id"], "value").collect()}
    assert got == {(i, i, "totals block" if i else "summed per-record") for i in range(40)}
    assert made.value == 40
