"""Set algebra, partition proofs, provenance unions, orders and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name; a column one part lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def set_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of union, intersection and both differences of two id sets, from one aggregate over both."""
    both = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s")))
    g = both.groupBy(key).agg(F.bit_or("s").alias("s"))
    wide = g.agg(F.count(F.lit(1)).alias("union"), F.count_if(F.col("s") == 3).alias("both"),
                 F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b"))
    return wide.unpivot([], wide.columns, "part", "n")


def partition_proof(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """Do the parts form a partition of the whole: disjoint, covering, nothing extra."""
    tagged = union_all([p.select(key).distinct().withColumn("_p", F.lit(1)).withColumn("_w", F.lit(0)) for p in parts]
                       + [whole.select(key).distinct().withColumn("_p", F.lit(0)).withColumn("_w", F.lit(1))])
    g = tagged.groupBy(key).agg(F.sum("_p").alias("p"), F.sum("_w").alias("w"))
    wide = g.agg((F.count_if(F.col("p") > 1) == 0).alias("disjoint"), (F.count_if(F.col("p") == 0) == 0).alias("covering"),
                 (F.count_if(F.col("w") == 0) == 0).alias("no_extra"))
    return wide.unpivot([], wide.columns, "check_name", "holds")


def partition_completeness(rows: DataFrame, part: str, key: str, whole: DataFrame) -> DataFrame:
    """Sum of the parts, unique ids, overlap, and whether the unique ids are all of the whole."""
    g = rows.groupBy(key).agg(F.count_distinct(part).alias("_parts"))
    w = whole.select(key).distinct().withColumn("_w", F.lit(1))
    j = g.join(w, key, "full_outer")
    total, unique = F.coalesce(F.sum("_parts"), F.lit(0)), F.count("_parts")
    return j.agg(total.alias("part_total"), unique.alias("unique_total"), (total - unique).alias("overlap"),
                 (unique == F.count("_w")).alias("complete"))


def union_provenance(parts: list[DataFrame], key: Column, name: str, lists: list[str], sep: str = ";") -> DataFrame:
    """Union with duplicates collapsed; the distinct values of each provenance column are kept.

    Values are reduced to one row per key and value before they are collected.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in lists])
    long = union_all(parts).select(key.alias(name), F.explode(cells).alias("c"))
    g = long.groupBy(name, "c.f", "c.v").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(name).agg(
        F.sum(F.when(F.col("f") == lists[0], F.col("n"))).alias("rows"),
        *[F.array_join(F.array_sort(F.collect_list(F.when(F.col("f") == c, F.col("v")))), sep).alias(c) for c in lists])


def route_overlap(rows: DataFrame, route: str, key: str) -> DataFrame:
    """How many ids came by each combination of routes."""
    g = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(route)), "+").alias("routes"))
    return g.groupBy("routes").agg(F.count(F.lit(1)).alias("n"))


def sort_by_list(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Order by position in an external list; values outside it come last."""
    rank = F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col)), F.lit(0).cast("bigint"))
    return df.withColumn("rank", rank).orderBy(F.asc_nulls_last("rank"), *[c for c in df.columns])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group. Spark limits each partial group before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
