"""Ordered operators that never put a whole group into one task, for orders with a natural coarse form.

A group (or the whole table) may be far larger than one task can hold. Each operator here takes a
``bucket`` expression: any coarse, order-preserving function of the ordering column, e.g.
``floor(id / 65536)``, ``date_trunc('hour', ts)`` or the leading digits of a hash. Rows are ranked
inside ``(group, bucket)``; per-bucket summaries, which are small, carry the rest across buckets. Where no such form is known, ``ranges``
takes the ranges from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import attach_per_key

BUCKET = "_bucket"
KEY = "_key"


def id_bucket(c: str, width: int = 65536) -> Column:
    """Bucket of a dense integer id."""
    return F.floor(F.col(c) / width)


def _keyed(df: DataFrame, group: list[str], bucket: Column) -> DataFrame:
    """Add the group and bucket as one struct. A struct with NULL fields equals its like, so that grouping,
    window and join share one partitioning and NULL keys are kept."""
    return df.withColumn(KEY, F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], bucket.alias("b")))


def _carry(df: DataFrame, aggs: list[Column], n_group: int, name: str, carried: Column) -> DataFrame:
    """Join per-bucket summaries, combined over the earlier buckets of the group, back to the rows."""
    groups = [F.col(f"{KEY}.g{i}") for i in range(n_group)] or [F.lit(0)]
    before = W.partitionBy(*groups).orderBy(f"{KEY}.b").rowsBetween(W.unboundedPreceding, -1)
    summary = df.groupBy(KEY).agg(*aggs).select(KEY, carried.over(before).alias(name))
    # The first bucket of a group carries nothing, so groups of one bucket do not enter the join.
    return df.join(summary.where(F.col(name).isNotNull()), KEY, "left")


def row_numbers(df: DataFrame, order_by: list, bucket: Column, group: list[str] | None = None,
                name: str = "rn") -> DataFrame:
    """``row_number() over (partition by group order by order_by)`` without one task per group."""
    group = group or []
    out = _carry(_keyed(df, group, bucket), [F.count(F.lit(1)).alias("_n")], len(group), "_offset", F.sum("_n"))
    local = F.row_number().over(W.partitionBy(KEY).orderBy(*order_by))
    return out.withColumn(name, F.coalesce(F.col("_offset"), F.lit(0)) + local).drop(KEY, "_offset")


def previous(df: DataFrame, value: str, order_by: list[str], bucket: Column, group: list[str] | None = None,
             name: str = "prev") -> DataFrame:
    """``lag(value)`` in order, across bucket borders. ``value`` itself must not be NULL."""
    group = group or []
    last = F.max_by(F.col(value), F.struct(*order_by)).alias("_last")
    out = _carry(_keyed(df, group, bucket), [last], len(group), "_before", F.last("_last", ignorenulls=True))
    local = F.lag(value).over(W.partitionBy(KEY).orderBy(*order_by))
    return out.withColumn(name, F.coalesce(local, F.col("_before"))).drop(KEY, "_before")


def take_smallest(df: DataFrame, quota: DataFrame, group: list[str], order_by: list[str], bucket: Column,
                  ) -> DataFrame:
    """Per group, the first ``quota.k`` rows in order.

    Only the one bucket per group that crosses the quota is ranked; earlier buckets are kept whole
    and later ones are dropped by the join, so no group is sorted as a whole.
    """
    keys = [*group, BUCKET]
    base = df.withColumn(BUCKET, bucket)
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*group).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    marks = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
             .join(quota.select(*group, "k"), group)
             .where(F.col("_before") < F.col("k"))
             .withColumn("_left", F.col("k") - F.col("_before"))
             .select(*keys, "_left", (F.col("_n") <= F.col("_left")).alias("_whole")))
    marked = base.join(marks, keys)
    cols = df.columns
    whole = marked.where("_whole").select(*cols)
    cut = (marked.where("NOT _whole")
           .withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order_by)))
           .where(F.col("_rn") <= F.col("_left")).select(*cols))
    return whole.unionByName(cut)


def latest(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Last write wins per key: one partial aggregate, no sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_row"))
            .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
            .select(*df.columns))


def superseded(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Every row that is not the last write of its key, with the position that replaced it."""
    top = df.groupBy(*keys).agg(F.max(F.struct(*order_by)).alias("superseded_by"), F.count(F.lit(1)).alias("_n"))
    return attach_per_key(df, top, keys, "_n").drop("_n").where(F.struct(*order_by) < F.col("superseded_by"))
