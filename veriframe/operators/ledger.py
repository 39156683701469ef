"""Append-only logs: latest state, attempts, usage totals, readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .ordered import previous


def attempt_rollup(log: DataFrame, key: str, order: list[str], route: str, outcome: str, ok: list[str]) -> DataFrame:
    """Per item: the attempts in order as ``route->outcome``, how many, the last outcome and a verdict.

    The attempts of an item are sorted in 64 salted parts before the parts are merged into its one
    line of text.
    """
    step = F.concat_ws("->", route, outcome)
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    salted = log.groupBy(key, part.alias("_s")).agg(
        F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), step.alias("t")))).alias("ts"),
        F.count(F.lit(1)).alias("n"), F.max(F.struct(F.struct(*order).alias("o"), F.col(outcome).alias("v"))).alias("last"),
        F.bool_or(F.col(outcome).isin(ok)).alias("got"))
    whole = salted.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("ts"))).alias("ts"), F.sum("n").alias("n_attempts"),
                                    F.max("last").alias("last"), F.bool_or("got").alias("got"))
    return whole.select(key, "n_attempts", F.array_join(F.transform("ts", lambda s: s["t"]), "; ").alias("attempts"),
                        F.col("last.v").alias("last_outcome"),
                        F.when(F.col("got"), "obtained").otherwise("not_obtained").alias("verdict"))


def usage_totals(log: DataFrame, amount: Column, sets: list[list[str]], dims: list[str], total: str = "ALL") -> DataFrame:
    """Totals by several groupings where an unreadable amount is unknown, not zero.

    ``known`` is a lower bound; ``unknown`` says how many rows it leaves out.
    """
    df = log.select(*dims, amount.alias("_a"))
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        F.sum("_a").alias("known"), F.count_if(F.col("_a").isNull()).alias("unknown"), F.count(F.lit(1)).alias("rows"),
        *[F.grouping(c).alias(f"_g_{c}") for c in dims])
    labels = [F.when(F.col(f"_g_{c}") == 1, total).otherwise(F.col(c).cast("string")).alias(c) for c in dims]
    return g.select(*labels, "known", "unknown", "rows")


def json_number_totals(df: DataFrame, json: str, key_pattern: str, by: list[str] = ()) -> DataFrame:
    """Sum of the numeric leaves of a JSON column whose key matches, per group and leaf name."""
    leaves = df.select(*by, F.explode(F.from_json(json, "map<string,string>")).alias("name", "raw"))
    return (leaves.where(F.col("name").rlike(key_pattern)).withColumn("num", F.col("raw").try_cast("double"))
            .groupBy(*by, "name").agg(F.sum("num").alias("total"), F.count_if(F.col("num").isNull()).alias("not_numeric"),
                                      F.count(F.lit(1)).alias("n")))


def reading_deltas(readings: DataFrame, by: list[str], at: str, value: str, tie: str, unit: str = "day") -> DataFrame:
    """Change since the previous reading of the same series, across day borders."""
    prev = previous(readings, value, [at, tie], F.date_trunc(unit, at), by, "previous")
    return prev.withColumn("delta", F.col(value) - F.col("previous"))


def units_per_point(used: DataFrame, start: str, end: str, amount: str) -> DataFrame:
    """Usage per unit of meter change; NULL where the meter did not move."""
    return used.withColumn("per_point", ratio(F.col(amount), F.col(end) - F.col(start)))
