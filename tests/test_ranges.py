import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.operators import joins as jn
from veriframe.operators import ranges as rg

c = F.col


@pytest.fixture(scope="module")
def frames(spark):
    """Ids as hashes over the whole 64-bit range, one value in nine of ten rows, a hot and a NULL group, text ids; values with NULLs."""
    rng = random.Random(9)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.choice(["hot"] * 8 + ["a", None]), 7 if rng.random() < 0.9 else rng.randrange(-50, 50), None if rng.random() < 0.1 else rng.random(), f"k{rng.randrange(10**9)}")
            for _ in range(3000)]
    return spark.createDataFrame(rows, "id bigint, g string, x int, v double, name string").repartition(6).cache()


ORDERS = [(["id"], []), (["x", "id"], []), (["x", "id"], ["g"]), (["name"], ["g"]), (["name"], ["g", "x"])]


def spec(order, group):
    return (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(*order)


@pytest.mark.parametrize("order,group", ORDERS)
def test_equal_to_one_window(frames, order, group):
    w = spec(order, group)
    n = rg.number_rows(frames, order, group)
    assert n.columns == [*frames.columns, "rn"] and n.count() == 3000 and n.withColumn("w", F.row_number().over(w)).where("rn <> w").count() == 0
    r = rg.running_total(frames, c("v"), order, group).withColumn("w", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    assert r.count() == 3000 and r.where("abs(running - w) > 1e-9").count() == 0
    p = rg.value_before(frames, "v", order, group).withColumn("w", F.lag("v").over(w))
    assert p.count() == 3000 and p.where("NOT (prev <=> w)").count() == 0


def test_a_value_of_most_rows_is_cut_into_ranges(spark):
    df = spark.range(20_000).select(F.when(c("id") % 10 > 0, 1).otherwise(c("id")).alias("x"), "id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["count"] for r in rg.in_ranges(df, ["x"]).groupBy(rg.RANGE).count().collect()]
        got = rg.number_rows(df, [F.desc("x")]).agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) >= 14 and max(sizes) < 3 * 20_000 / 16
    assert tuple(got) == (1, 20_000, 20_000)


def test_no_rows_and_equal_rows(spark, frames):
    assert rg.number_rows(frames.limit(0), ["id"]).count() == 0
    same = spark.createDataFrame([(1, "x")] * 50, "id int, g string")
    assert sorted(r.rn for r in rg.number_rows(same, ["id"], ["g"]).collect()) == list(range(1, 51))


def test_sort_key_keeps_the_order(spark):
    rng = random.Random(1)
    vals = [0.0, -0.0, 1.0, 2.0, 0.5, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 3.0000000000000004, 3.0]
    vals += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(3000)] + [math.nextafter(2.0 ** k, d) for k in range(-40, 40) for d in (0, math.inf)] + [2.0 ** k for k in range(-1074, 1023)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [(r.v, r.k) for r in df.select("v", rg.sort_key(c("v"), df.schema["v"].dataType).alias("k")).collect()]
    want = sorted(got, key=lambda p: (math.isnan(p[0]), p[0]))
    assert all((a[1] < b[1]) if a[0] < b[0] or (math.isnan(b[0]) and not math.isnan(a[0])) else a[1] == b[1] for a, b in zip(want, want[1:], strict=False))
    typed = spark.sql("SELECT CAST(-1.25 AS DECIMAL(10,2)) a, DATE'1960-01-01' b, TIMESTAMP'2020-01-01 00:00:00' c, -5L d, CAST(0.1 AS FLOAT) e")
    got = typed.select(*[rg.sort_key(c(x), typed.schema[x].dataType).alias(x) for x in "abcde"]).first()
    assert got.a == -125 and got.b < 0 < got.c and got.d == -5 and got.e > 0
    with pytest.raises(ValueError):
        rg.sort_key(c("name"), __import__("pyspark.sql.types", fromlist=["StringType"]).StringType())


@pytest.mark.parametrize("value,by", [("v", ["g"]), ("x", ["g"]), ("id", []), ("x", ["g", "name"])])
def test_quantiles_equal_exact_percentiles(frames, value, by):
    qs = {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0, "e": 0.333}
    df = frames.withColumn("name", F.substring("name", 1, 2))
    got = {tuple(r[b] for b in by): r for r in rg.quantiles(df, value, by, qs).collect()}
    want = df.where(c(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), *[F.percentile(value, q).alias(k) for k, q in qs.items()]).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[tuple(r[b] for b in by)]
        assert (g.n, g["min"], g["max"]) == (r.n, r.lo, r.hi) and all(g[k] == pytest.approx(r[k]) for k in qs)


@pytest.mark.parametrize("kind", ["bigint", "double", "date", "timestamp", "int"])
def test_interval_join_equals_all_comparisons(spark, kind):
    rng = random.Random(3)
    value = {"bigint": lambda: rng.choice([rng.randrange(-100, 100), rng.getrandbits(64) - (1 << 63)]), "double": lambda: rng.choice([rng.random(), -1e300, 1e300, 0.0, rng.gauss(0, 1e9)]),
             "int": lambda: rng.randrange(40), "date": lambda: rng.randrange(-9000, 9000), "timestamp": lambda: rng.randrange(-10**9, 10**9)}[kind]
    turn = {"date": lambda c: F.date_from_unix_date(c), "timestamp": lambda c: F.timestamp_seconds(c)}.get(kind, lambda c: c)
    raw = "double" if kind == "double" else "int" if kind == "date" else "bigint"
    pts = spark.createDataFrame([(rng.choice("ab"), value() if rng.random() < 0.95 else None, i) for i in range(200)], f"g string, at {raw}, i int").withColumn("at", turn(c("at")).cast(kind))
    wins = [(rng.choice("abc"), value(), value()) for _ in range(80)] + [("a", 5, 5), ("a", None, 5), ("b", 5, None)]
    wins = spark.createDataFrame([(g, *[None if v is None else float(v) if raw == "double" else v for v in (x, y)]) for g, x, y in wins], f"g string, s {raw}, e {raw}").withColumns({"s": turn(c("s")).cast(kind), "e": turn(c("e")).cast(kind)}).withColumn("w", F.monotonically_increasing_id())
    got = jn.interval_join(pts, wins, ["g"], "at", "s", "e")
    assert set(got.columns) == {*pts.columns, *wins.columns}
    want = pts.join(wins, "g").where("at BETWEEN s AND e")
    pairs = lambda d: sorted((r.i, r.w) for r in d.select("i", "w").collect())
    assert pairs(got) == pairs(want) and pairs(want)
