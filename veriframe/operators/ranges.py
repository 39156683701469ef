"""Ordered operators for any shape of ids and values: range partitions from sampled bounds, and carries between neighbours.

The rows are dealt into ranges of their order (groups first), whose bounds Spark samples from the data, so hashed, sparse or clustered ids
give even ranges. A range is sorted in its task and written with its rows numbered. What has to be carried from one range to the next is one
or two rows a range: the groups at its ends. No window sees more rows than a range holds, or than two for every range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

RANGE, PLACE, GROUP = "_range", "_place", "_group"


def in_ranges(df: DataFrame, order_by: list, group: list[str] = ()) -> DataFrame:
    """``df`` with ``_range`` and ``_place`` (from 0) of each row and its ``_group``, written once.

    Rows that tie in ``order_by`` are ordered by a hash of all columns, so that a value which most rows share is cut into ranges too. Bounds are
    sampled per plan, which is why the result is a table and not a plan."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    order = [*[F.col(g) for g in group], *map(as_column, order_by), F.xxhash64(*df.columns)]
    at = F.monotonically_increasing_id()
    key = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)]) if group else F.struct(F.lit(0).alias("g0"))
    laid = df.withColumn(GROUP, key).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return cut_lineage(laid.select(*df.columns, GROUP, F.shiftright("_at", 33).cast("int").alias(RANGE), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE)))


def _carried(laid: DataFrame, summary: Column, combine, name: str) -> DataFrame:
    """``laid`` with ``name``: ``summary`` of the group's rows in each earlier range, put together by ``combine``; NULL if there are none.

    Only the first group of a range continues from an earlier one, so summaries are of the first and last group of every range."""
    ends = laid.groupBy(RANGE).agg(F.min_by(GROUP, PLACE).alias("_first"), F.max_by(GROUP, PLACE).alias("_last"))
    at_ends = laid.join(ends, RANGE).where((F.col(GROUP) == F.col("_first")) | (F.col(GROUP) == F.col("_last")))
    per = at_ends.groupBy(RANGE, GROUP, "_first").agg(summary.alias("_s"))
    before = W.partitionBy(GROUP).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carry = per.withColumn(name, combine("_s").over(before)).where((F.col(GROUP) == F.col("_first")) & F.col(name).isNotNull()).select(RANGE, GROUP, name)
    return laid.join(carry, [RANGE, GROUP], "left")


def _local() -> W:
    return W.partitionBy(RANGE, GROUP).orderBy(PLACE)


def number_rows(df: DataFrame, order_by: list, group: list[str] = (), name: str = "rn") -> DataFrame:
    """``row_number() over (partition by group order by order_by)``."""
    out = _carried(in_ranges(df, order_by, group), F.count(F.lit(1)), F.sum, "_before")
    rn = F.row_number().over(_local()) + F.coalesce("_before", F.lit(0))
    return out.withColumn(name, rn.cast("bigint")).select(*df.columns, name)


def running_total(df: DataFrame, value: Column, order_by: list, group: list[str] = (), name: str = "running") -> DataFrame:
    """Sum of ``value`` up to and including the row; a NULL value adds nothing."""
    laid = in_ranges(df.withColumn("_v", value), order_by, group)
    out = _carried(laid, F.sum("_v"), F.sum, "_before")
    local = F.sum("_v").over(_local().rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce(local, F.lit(0))).select(*df.columns, name)


def value_before(df: DataFrame, value: str, order_by: list, group: list[str] = (), name: str = "prev") -> DataFrame:
    """``lag(value)``; ``value`` may be NULL."""
    laid = in_ranges(df.withColumn("_v", F.struct(F.col(value).alias("v"))), order_by, group)
    out = _carried(laid, F.max_by("_v", PLACE), lambda c: F.last(c, ignorenulls=True), "_before")
    return out.withColumn(name, F.coalesce(F.lag("_v").over(_local()), F.col("_before"))["v"]).select(*df.columns, name)


# --- exact quantiles without sorting ---------------------------------------------------------------

def sort_key(value: Column, dtype: T.DataType) -> Column:
    """A 64-bit integer in the order of a numeric, date or time value, different for different values."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        v = value.cast("double")
        size = F.abs(v)
        # The hexadecimal form has the exponent and the 52 bits of the fraction as they are: 0x1.8p3, and 0x0.8p-1022 for the smallest.
        form = F.format_string("%a", size)
        fraction = F.conv(F.rpad(F.regexp_extract(form, r"\.([0-9a-f]+)p", 1), 13, "0"), 16, 10).cast("bigint")
        power = F.regexp_extract(form, r"p(-?\d+)$", 1).try_cast("bigint")
        key = F.when(form.startswith("0x1"), (power + 1023) * F.lit(1 << 52)).otherwise(F.lit(0)) + fraction
        whole = F.when(v.isNull(), None).when(F.isnan(v), F.lit((2047 << 52) + 1)).when(size == float("inf"), F.lit(2047 << 52)).otherwise(key)
        return F.when((v < 0) & ~F.isnan(v), -whole).otherwise(whole)
    if isinstance(dtype, T.DecimalType):
        if dtype.precision > 18:
            raise ValueError("decimals of up to 18 digits have a 64-bit order")
        return (value * F.lit(10 ** dtype.scale)).cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(dtype, T.IntegralType):
        return value.cast("bigint")
    raise ValueError(f"no 64-bit order for {dtype.simpleString()}")


def quantiles(df: DataFrame, value: str, by: list[str], qs: dict[str, float], bits: int = 16) -> DataFrame:
    """Exact interpolated quantiles per group, with count ``n``, ``min`` and ``max``; NULL values are left out.

    Radix selection: values are counted by the leading bits of their order, then only those under a wanted prefix by the next bits, and so on,
    64 / ``bits`` passes at any size. A pass is a partial aggregate; nothing is sorted and a value that most rows share is one count.
    """
    groups = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    keys = [F.col(b).alias(g) for b, g in zip(by, groups, strict=False)] or [F.lit(0).alias("_g0")]
    # Every pass reads the keys, so they are computed and written once.
    rows = cut_lineage(df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias(GROUP), F.col(value).alias("_v"), sort_key(F.col(value), df.schema[value].dataType).alias("_k")))
    facts = rows.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    at = {q: (F.col("n") - 1) * F.lit(q) for q in qs.values()}
    ranks = F.array_distinct(F.array(*[r.cast("bigint") for p in at.values() for r in (F.floor(p) + 1, F.ceil(p) + 1)]))
    # What is wanted: a rank, the prefix it is known to have, and how many values stand before that prefix.
    want = cut_lineage(facts.select(GROUP, F.explode(ranks).alias("rank")).select(GROUP, "rank", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before")))
    for left in range(64 - bits, -1, -bits):
        prefix = F.shiftright("_k", left)
        known = F.shiftright("_k", left + bits) if left + bits < 64 else F.lit(0).cast("bigint")
        some = rows.withColumn("prefix", known).join(want.select(GROUP, "prefix").distinct(), [GROUP, "prefix"], "left_semi")
        counts = some.groupBy(GROUP, F.col("prefix").alias("under"), prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("v"))
        # At most 2**bits counts under one prefix.
        upto = F.sum("c").over(W.partitionBy(GROUP, "under").orderBy("prefix"))
        counts = counts.withColumn("upto", upto)
        old = want.select(GROUP, "rank", F.col("prefix").alias("under"), "before")
        want = cut_lineage(old.join(counts, [GROUP, "under"]).where("rank > before + upto - c AND rank <= before + upto")
                           .select(GROUP, "rank", "prefix", (F.col("before") + F.col("upto") - F.col("c")).alias("before"), *(["v"] if left == 0 else [])))

    j = facts.join(want, GROUP)
    def one(q: float) -> Column:
        lo = F.max(F.when(F.col("rank") == F.floor(at[q]) + 1, F.col("v")))
        hi = F.max(F.when(F.col("rank") == F.ceil(at[q]) + 1, F.col("v")))
        return lo + (hi - lo) * F.max(at[q] - F.floor(at[q]))
    out = j.groupBy(GROUP).agg(F.max("n").alias("n"), F.max("min").alias("min"), F.max("max").alias("max"), *[one(q).alias(name) for name, q in qs.items()])
    return out.select(*[F.col(f"{GROUP}.{g}").alias(b) for b, g in zip(by, groups, strict=False)], "n", "min", "max", *qs)
