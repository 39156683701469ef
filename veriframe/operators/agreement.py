"""Rater agreement, error rates and their intervals. All statistics come from counted label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st


def label_pairs(df: DataFrame, a: str, b: str, by: list[str] = (), blank: str | None = None) -> DataFrame:
    """Counts per label pair. Rows with a NULL label are left out, or counted under ``blank``."""
    ca, cb = F.col(a), F.col(b)
    if blank is not None:
        ca, cb = (F.coalesce(F.when(x != "", x), F.lit(blank)) for x in (ca, cb))
    else:
        df = df.where(ca.isNotNull() & cb.isNotNull())
    return df.groupBy(*by, ca.alias("label_a"), cb.alias("label_b")).agg(F.count(F.lit(1)).alias("n"))


def kappa_table(df: DataFrame, a: str, b: str, by: list[str] = (), degenerate: str = "null",
                blank: str | None = None) -> DataFrame:
    """``n, agreements, p_o, p_e, kappa`` per group. Margins are summed from the pair counts."""
    by = list(by)
    pairs = label_pairs(df, a, b, by, blank)
    sides = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("label_a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb"),
                 F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0).alias("same")),
        F.struct(F.col("label_b").alias("label"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb"),
                 F.lit(0).cast("bigint").alias("same")))).alias("s")).select(*by, "s.*")
    margins = sides.groupBy(*by, "label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    tot = margins.groupBy(*by).agg(F.sum("na").alias("n"), F.sum("same").alias("agreements"),
                                   F.sum(F.col("na").cast("double") * F.col("nb")).alias("_e"))
    n = F.col("n").cast("double")
    out = tot.select(*by, "n", "agreements", st.ratio(F.col("agreements"), n).alias("p_o"),
                     st.ratio(F.col("_e"), n * n).alias("p_e"))
    return out.withColumn("kappa", st.kappa(F.col("p_o"), F.col("p_e"), degenerate))


def confusion(df: DataFrame, a: str, b: str, total: str = "TOTAL", blank: str | None = None) -> DataFrame:
    """Long confusion matrix with row, column and grand totals."""
    pairs = label_pairs(df, a, b, blank=blank)
    cube = pairs.cube("label_a", "label_b").agg(F.sum("n").alias("n"), F.grouping("label_a").alias("ga"),
                                                F.grouping("label_b").alias("gb"))
    return cube.select(F.when(F.col("ga") == 1, total).otherwise(F.col("label_a")).alias("label_a"),
                       F.when(F.col("gb") == 1, total).otherwise(F.col("label_b")).alias("label_b"), "n")


def error_rates(df: DataFrame, predicted: str, consensus: str, disagree: str = "DISAGREE") -> DataFrame:
    """Share of settled items whose consensus differs from the predicted class, with a Wilson interval."""
    settled = df.where(F.col(predicted).isNotNull() & (F.col(predicted) != "")
                       & F.col(consensus).isNotNull() & ~F.col(consensus).isin("", disagree))
    out = settled.groupBy(predicted).agg(F.count(F.lit(1)).alias("n"),
                                         F.count_if(F.col(consensus) != F.col(predicted)).alias("mismatches"))
    lo, hi = st.wilson(F.col("mismatches"), F.col("n"))
    return out.select(predicted, "n", "mismatches", st.ratio(F.col("mismatches"), F.col("n")).alias("error_rate"),
                      lo.alias("lo"), hi.alias("hi"))


def trigger_table(df: DataFrame, code: str, consensus: str, advance: str, disagree: str = "DISAGREE") -> DataFrame:
    """Per exclusion code: how many settled items were advanced after all, and whether that triggers a re-screen."""
    settled = df.where((F.col(code) != "") & F.col(consensus).isNotNull() & ~F.col(consensus).isin("", disagree))
    out = settled.groupBy(code).agg(F.count(F.lit(1)).alias("n"),
                                    F.count_if(F.col(consensus) == advance).alias("advanced"))
    lo, hi = st.wilson(F.col("advanced"), F.col("n"))
    return out.select(code, "n", "advanced", st.ratio(F.col("advanced"), F.col("n")).alias("advance_rate"),
                      lo.alias("lo"), hi.alias("hi"), (F.col("advanced") > 0).alias("rescreen"))


def calibration(df: DataFrame, a: str, b: str, planned: int, threshold: float) -> DataFrame:
    """Verdict on a calibration round: incomplete, criterion met, or not passed."""
    k = kappa_table(df, a, b)
    verdict = (F.when(F.col("n") < planned, F.format_string(f"INCOMPLETE: %d/{planned} jointly assessed", "n"))
               .when(F.col("p_o") >= threshold, "PASS").otherwise("NOT_PASSED"))
    return k.withColumn("status", verdict)


def override_rate(prefill: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with a prefill, rows where any field was changed, and changes per field."""
    j = prefill.alias("p").join(current.alias("c"), key)
    diff = {f: ~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}")) for f in fields}
    any_ = F.lit(False)
    for d in diff.values():
        any_ = any_ | d
    n = F.count(F.lit(1))
    wide = j.agg(n.alias("n"), F.count_if(any_).alias("any_field"), *[F.count_if(d).alias(f) for f, d in diff.items()])
    long = wide.unpivot(["n"], ["any_field", *fields], "field", "overridden")
    return long.withColumn("rate", st.ratio(F.col("overridden"), F.col("n")))


def adjudicator_match(adj: Column, b: Column, c: Column) -> Column:
    """Whom the adjudicator sided with."""
    return (F.when((adj == b) & (adj == c), "both").when(adj == b, "B").when(adj == c, "C").otherwise("neither"))


def multilabel_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per label: items where rater A lists it, rater B lists it, and both do."""
    rows = df.select(F.explode(F.array_union(a, b)).alias("label"), a, b)
    return rows.groupBy("label").agg(
        F.count_if(F.array_contains(a, F.col("label"))).alias("n_a"),
        F.count_if(F.array_contains(b, F.col("label"))).alias("n_b"),
        F.count_if(F.array_contains(a, F.col("label")) & F.array_contains(b, F.col("label"))).alias("n_both"))


def extrapolate(rate: DataFrame, numerator: str, denominator: str, universe: int) -> DataFrame:
    """Scale a sampled rate to a universe size, rounded to whole items."""
    return rate.withColumn("expected", st.round_half_even(st.ratio(F.col(numerator), F.col(denominator)) * universe))
