"""Joins that hold when one key owns a large share of the rows, or that need few of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A key is hot if it has over this many rows and over one part in ``SHARE`` of all; so there are fewer than ``SHARE`` hot keys.
SHARE = 5_000
#: Slots of keys, a bit each, by which rows are left out before a join.
SLOTS = 1 << 26


def attach_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n_col: str, limit: int = 100_000,
                   how: str = "inner", total: int | None = None) -> DataFrame:
    """Join a few rows per key (``per_key``, with the key's row count ``n_col`` in ``rows``) back to ``rows``.

    A hot key is dealt over as many tasks as its count holds ``limit`` rows. The list of hot keys is broadcast as 64-bit hashes: fewer
    than ``SHARE`` keys can each have more than one part in ``SHARE`` of the rows, whatever the size, and two keys of one hash are
    dealt alike on both sides. Where ``total`` rows are known to be within ``limit`` no key can be hot and a plain join is planned.
    """
    if total is not None and total <= limit:
        return rows.join(per_key, keys, how)
    per_key = cut_lineage(per_key)  # read for the total, the hot keys and the join
    if total is None:
        total = per_key.select(*keys, n_col).distinct().agg(F.coalesce(F.sum(n_col), F.lit(0)).cast("double")).first()[0]
    least = max(limit, total / SHARE)
    key_hash = F.xxhash64(*keys)
    hot = F.broadcast(per_key.where(F.col(n_col) > least).groupBy(key_hash.alias("_hash"))
                      .agg(F.ceil(F.max(n_col) / least).cast("int").alias("_salts")))
    left = (rows.withColumn("_hash", key_hash).join(hot, "_hash", "left")
            .withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"))
                        .otherwise(F.lit(-1)))
            .drop("_hash", "_salts"))
    right = (per_key.withColumn("_hash", key_hash).join(hot, "_hash", "left")
             .withColumn("_salt", F.explode(F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1))
                                            .otherwise(F.array(F.lit(-1)))))
             .drop("_hash", "_salts"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def that_may_be_in(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` has the slot of one in ``few``: all that a join on it keeps, and some others. A join of what is left shuffles no more.

    The slots are bitmaps of at most ``SLOTS`` bits (8 MB) that are broadcast."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1
    bit = F.bitmap_bit_position(slot)
    maps = (few.where(F.col(key).isNotNull()).select(bit.alias("_bit"), F.bitmap_bucket_number(slot).alias("_map")).repartition("_map")
            .groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col("_map"))
            .where(F.col(key).isNotNull() & (F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1)).select(*rows.columns))
