"""Seeded samples, batches and id sequences that need no single-task sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import round_half_even
from .ordered import take_smallest
from .ranges import number_rows


def draw_key(seed: int, key: str) -> Column:
    """The order of a seeded draw: a hash of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample_strata(df: DataFrame, strata: list[str], key: str, fraction: float, seed: int) -> DataFrame:
    """An exact fraction of each stratum: the ``round(fraction * N)`` rows least in draw order.

    The leading hex digits of the draw key cut a stratum into even buckets, about as many as a bucket
    of the largest stratum has rows; only the bucket that crosses the quota is sorted.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 1
    digits = max(1, math.ceil(math.log(largest, 16) / 2))
    quota = sizes.select(*strata, round_half_even(F.col("n") * F.lit(fraction)).alias("k"))
    keyed = df.withColumn("_draw", draw_key(seed, key))
    return take_smallest(keyed, quota, strata, ["_draw", key], F.substring("_draw", 1, digits)).drop("_draw")


def sample_round(df: DataFrame, seen: DataFrame, strata: list[str], key: str, fraction: float, seed: int,
                 round_no: int) -> DataFrame:
    """A fresh round over ids no earlier round has shown; the seed advances with the round."""
    return sample_strata(df.join(seen.select(key), key, "left_anti"), strata, key, fraction, seed + round_no - 1)


def batches(df: DataFrame, key: str, size: int, start: int = 1, name: str = "batch") -> DataFrame:
    """Fixed-size batch numbers in key order."""
    numbered = number_rows(df, [key], name="_rn")
    return numbered.withColumn(name, (F.floor((F.col("_rn") - 1) / size) + start).cast("bigint")).drop("_rn")


def continue_ids(existing: DataFrame, id_col: str, new: DataFrame, order: str, prefix: str, width: int = 3) -> DataFrame:
    """Give new rows ids that continue after the largest existing ``prefix``-number."""
    number = F.regexp_extract(id_col, rf"^{prefix}(\d+)$", 1).try_cast("bigint")
    top = existing.agg(F.max(number)).first()[0] or 0
    numbered = number_rows(new, [order], name="_rn")
    return numbered.withColumn(id_col, F.format_string(f"{prefix}%0{width}d", F.col("_rn") + F.lit(top))).drop("_rn")
