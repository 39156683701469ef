"""Exact blocked similarity self-join without enumerating the pairs of a block.

Pairs share a block key and a year band and reach a similarity threshold. Identical titles are
collapsed first, so copies cost one title. Candidate title pairs then come from a prefix filter over
q-grams (Chaudhuri, Ganti, Kaushik, ICDE 2006; Bayardo, Ma, Srikant, WWW 2007): an edit changes at
most q of a title's q-grams, so titles that are at most d edits apart share one of the q * d + 1
rarest q-grams of either. Titles meet only on a rare q-gram of theirs; what a template or a common
head gives to all titles of a block comes last in that order and proposes nothing as long as a title
has q * d + 1 rarer q-grams. Where two meet, bits of their q-grams leave out most that differ in
more of them than the edits can change (never others), before pairs are made. Each candidate is
verified with the real similarity, so the result is exact for every block size: nothing is capped
or skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..session import cut_lineage

#: 64-bit words of the set of q-grams that a title carries to its meetings.
WORDS = 8
BITS = [f"w{w}" for w in range(WORDS)]
#: Titles up to this length travel with their rare q-grams.
SHORT = 255


def _edit_rate(metric: str, threshold: float) -> float:
    """The most edits a match may be away, per character of either title."""
    r = (1 - threshold) / threshold
    return 2 * r if metric == "indel" else r


def _gram_size(rate: float) -> int:
    return max(1, min(4, int(0.5 / rate))) if rate > 0 else 4


def _bits_of_word(w: int) -> Column:
    """Word ``w`` of the bits that the hashes ``gs`` set."""
    bit = lambda g: F.pmod(g, F.lit(64 * WORDS))
    mine = F.filter("gs", lambda g: F.shiftright(bit(g), 6) == w)
    one = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), (bit(g) % 64).cast("int"))
    return F.aggregate(mine, F.lit(0).cast("long"), lambda x, g: x.bitwiseOR(one(g)))


def rare_grams(titles: DataFrame, metric: str, threshold: float) -> DataFrame:
    """``(block, gram, title_id, len, rarer, w0..w7)``: the q-grams on which each title meets others.

    Q-grams are taken with both ends padded and the second, third, ... occurrence of one counts as
    another. They are ordered by the number of the block's titles that have them. A q-gram that no
    other title has takes its place in the order but needs no row. ``gram`` is a hash of block and
    q-gram: any order that all titles share is exact, and titles that meet by a collision are
    compared like others. ``rarer`` lists those of the title that come before (none of titles over
    ``SHORT`` characters); ``w0..w7`` is the set of its q-grams as ``64 * WORDS`` bits.

    Rows per q-gram hold numbers only and are ranked by sorting, so a task's memory is its sort.
    """
    rate = _edit_rate(metric, threshold)
    q = _gram_size(rate)
    padded = F.concat(F.lit("\x01" * (q - 1)), F.col("title"), F.lit("\x02" * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.col("len") + (q - 1)), lambda i: F.substr(padded, i, F.lit(q)))
    numbered = F.transform("gs", lambda g, i: F.concat(g, F.size(F.filter(F.slice("gs", F.lit(1), i), lambda h: h == g)).cast("string")))
    sets = cut_lineage(titles.where("block IS NOT NULL").withColumn("gs", grams).withColumn("gs", numbered)
                       .select("block", "title_id", "len", F.array_distinct(F.transform("gs", lambda g: F.xxhash64("block", g))).alias("gs")))
    rows = sets.select("title_id", "len", F.explode("gs").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = F.floor(F.col("len") * F.lit(rate) + 1e-9).cast("int") * q + 1
    w = Window.partitionBy("title_id").orderBy("n", "gram")
    meets = F.when((F.col("len") <= SHORT) & (F.col("n") > 1), F.col("gram"))
    first = (rows.join(counts, "gram", "left").select("title_id", "len", "gram", F.coalesce("n", F.lit(1)).alias("n"))
             .withColumns({"place": F.row_number().over(w), "rarer": F.collect_list(meets).over(w.rowsBetween(Window.unboundedPreceding, -1))})
             .where((F.col("place") <= few) & (F.col("n") > 1)).select("title_id", "gram", "rarer"))
    words = [_bits_of_word(w).alias(BITS[w]) for w in range(WORDS)]
    return first.join(sets.select("block", "title_id", "len", *words), "title_id").select("block", "gram", "title_id", "len", "rarer", *BITS)


def similar_titles(titles: DataFrame, metric: str, threshold: float) -> DataFrame:
    """``(id_a, id_b, score)`` for distinct titles of one block that reach the threshold.

    ``titles`` has ``title_id`` (unique), ``block`` and ``title`` (distinct within its block).
    """
    if threshold <= 2 / 3:
        raise ValueError("the q-gram argument needs a threshold above 2/3")
    t = cut_lineage(titles.withColumn("len", F.length("title")).where("len > 0"))
    short = t.select("title_id", F.when(F.col("len") <= SHORT, F.col("title")).alias("title"))
    grams = cut_lineage(rare_grams(t, metric, threshold).drop("block").join(short, "title_id"))
    lo, rate = sim.shorter_bound(metric, threshold), _edit_rate(metric, threshold)
    side = lambda x: grams.select("gram", *[F.col(n).alias(f"{n}_{x}") for n in ("len", "rarer", "title", *BITS)], F.col("title_id").alias(f"id_{x}"))
    # No metric's distance is under the edit distance, which stops at its bound.
    most = F.floor(F.least(F.length("title_a"), F.length("title_b")) * F.lit(rate) + 1e-9).cast("int")
    close = F.call_function("levenshtein", F.col("title_a"), F.col("title_b"), most) >= 0
    # An edit takes at most q q-grams from a title, so at most that many bits of either may be missing in the other.
    lost = F.floor(F.least("len_a", "len_b") * F.lit(rate) + 1e-9) * _gram_size(rate)
    missing = lambda x, y: sum((F.bit_count(F.col(f"{w}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{w}_{y}")))) for w in BITS), F.lit(0))
    pairs = (side("a").join(side("b"), "gram")
             .where((F.col("id_a") < F.col("id_b")) & (F.least("len_a", "len_b") >= F.greatest("len_a", "len_b") * F.lit(lo) - 1e-9)
                    & (missing("a", "b") <= lost) & (missing("b", "a") <= lost))
             # Short titles are compared where they first meet; what is left for the step below is matches and long titles.
             .where(~F.arrays_overlap("rarer_a", "rarer_b") & F.coalesce(close, F.lit(True)))
             .select("id_a", "id_b").distinct())
    left = t.select(F.col("title_id").alias("id_a"), F.col("title").alias("title_a"))
    right = t.select(F.col("title_id").alias("id_b"), F.col("title").alias("title_b"))
    scored = (pairs.join(left, "id_a").join(right, "id_b")
              .where(sim.length_bound(metric, F.col("title_a"), F.col("title_b"), threshold))
              .where(close)
              .withColumn("score", sim.similarity(metric, F.col("title_a"), F.col("title_b"))))
    return scored.where(F.col("score") >= threshold - 1e-12).select("id_a", "id_b", "title_a", "title_b", "score")


def first_token(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def block_sizes(records: DataFrame, block: list[str], large: int) -> DataFrame:
    """Records per block, with the blocks that an all-pairs comparison could not afford marked."""
    return records.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") > large)
