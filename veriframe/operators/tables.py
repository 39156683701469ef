"""Count tables, coverage matrices, profiles and other report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.stats import ratio
from .ranges import quantiles




def grouped_counts(df: DataFrame, by: dict[str, str], with_field: list[str] = ()) -> DataFrame:
    """Counts per label; a blank label is counted under its stand-in. ``with_field`` adds filled counts."""
    cols = [F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit(blank)).alias(c) for c, blank in by.items()]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f"with_{f}") for f in with_field])


def multi_value_counts(df: DataFrame, cell: Column, sep: str = ";", blank: str = "NR") -> DataFrame:
    """A row counts once for every value its cell lists."""
    items = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), sep), F.trim), lambda x: x != ""))
    items = F.when(F.size(items) == 0, F.array(F.lit(blank))).otherwise(items)
    return df.select(F.explode(items).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def two_unit_counts(df: DataFrame, dims: list[str], units: dict[str, str]) -> DataFrame:
    """Rows and distinct units per cell; every unit is counted separately."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(n) for n, c in units.items()])


def _labels(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def coverage_matrix(df: DataFrame, row: str, col: str, rows: list[str], cols: list[str], unit: str,
                    subtotal: Column | None = None, total: str = "ALL") -> DataFrame:
    """Distinct units per row label and column label, with subtotal and total rows and zeros kept.

    ``rows`` and ``cols`` are the fixed label lists of the table; ``subtotal`` names a coarser row.
    """
    names = F.array(F.col(row), F.lit(total)) if subtotal is None else F.array(F.col(row), subtotal, F.lit(total))
    long = df.select(F.explode(names).alias(row), col, unit)
    cells = long.groupBy(row).pivot(col, cols).agg(F.count_distinct(unit))
    return (_labels(df.sparkSession, row, rows).join(cells, row, "left")
            .select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in cols]))


def strata_table(df: DataFrame, strata: dict[str, list[str]], unit: str, conditions: dict[str, Column]) -> DataFrame:
    """Distinct units overall and under conditions, for every combination of fixed strata, empty ones too."""
    values = [()]
    for vs in strata.values():
        values = [(*v, x) for v in values for x in vs]
    combos = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(strata, v)]) for v in values])
    spine = df.sparkSession.range(1).select(F.inline(combos))
    got = df.groupBy(*strata).agg(F.count_distinct(unit).alias("n"), *[
        F.count_distinct(F.when(c, F.col(unit))).alias(n) for n, c in conditions.items()])
    return spine.join(got, list(strata), "left").fillna(0)


def inventory(df: DataFrame, dims: list[str], unit: str, raw: str) -> DataFrame:
    """Per cell: rows, distinct units, distinct raw-name variants and the variants, most units first."""
    variants = df.groupBy(*dims, raw).agg(F.count(F.lit(1)).alias("_n"))
    names = variants.groupBy(*dims).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_variants"),
                                        F.array_join(F.array_sort(F.collect_list(raw)), ";").alias("variants"))
    units = df.groupBy(*dims).agg(F.count_distinct(unit).alias("n_units"))
    return names.join(units, dims).orderBy(F.desc("n_units"), *dims)


def type_tally(df: DataFrame, entity: str, kind: str, example: Column, order: list[str]) -> DataFrame:
    """``kind(n);kind(n)`` per entity and its first example by order."""
    per = df.groupBy(entity, kind).agg(F.count(F.lit(1)).alias("n"), F.min_by(example, F.struct(*order)).alias("_e"),
                                       F.min(F.struct(*order)).alias("_o"))
    return per.groupBy(entity).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind, "n"))),
                                 lambda s: F.concat(s[kind], F.lit("("), s["n"].cast("string"), F.lit(")"))), ";").alias("tally"),
        F.sum("n").alias("n_rows"), F.min_by("_e", "_o").alias("example"))


def share_table(spark: SparkSession, label: str, labels: list[str], columns: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Counts and percentages of one label list over several populations, each with its own denominator.

    ``columns`` maps a name to ``(rows, array of labels per row)``. The denominators are the last row.
    """
    out = _labels(spark, label, [*labels, "DENOMINATOR"])
    for name, (df, cell) in columns.items():
        tagged = df.select(F.explode(F.concat(F.array_distinct(cell), F.array(F.lit("DENOMINATOR")))).alias(label))
        n = tagged.groupBy(label).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, label, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    # The table has one row per fixed label, so one window over all of it is small.
    whole = W.partitionBy(F.lit(1))
    for name in columns:
        den = F.max(F.when(F.col(label) == "DENOMINATOR", F.col(name))).over(whole)
        out = out.withColumn(f"{name}_pct", F.when(F.col(label) != "DENOMINATOR", F.round(ratio(100 * F.col(name), den), 1)))
    return out


def field_profile(df: DataFrame, fields: list[str], vocab: dict[str, list[str]] | None = None) -> DataFrame:
    """Quality of each field: cells, distinct values, share of each missing code, bare numbers, values outside the list.

    Array fields are flattened. One pass over the table: the cells are unpivoted and aggregated by field.
    """
    vocab = vocab or {}
    types = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f).cast("array<string>") if types[f].startswith("array")
                                                          else F.array(F.col(f).cast("string"))).alias("vals")) for f in fields])
    long = df.select(F.explode(cells).alias("c")).select("c.field", F.explode_outer("c.vals").alias("value"))
    # Equal cells are counted before the shuffle.
    g = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value")
    outside = F.lit(False)
    for f, allowed in vocab.items():
        outside = outside | ((F.col("field") == f) & ~F.coalesce(v.isin(allowed), F.lit(False)))
    pct = lambda cond: F.round(ratio(100 * F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)), F.sum("n")), 1)
    return g.groupBy("field").agg(
        F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_distinct"),
        *[pct(v == code).alias(f"pct_{code.lower()}") for code in fv.MISSING_CODES],
        pct(F.trim(v).rlike(r"^-?\d+(\.\d+)?$")).alias("pct_numeric"),
        F.when(F.col("field").isin(list(vocab)), pct(outside)).alias("pct_outside"))


def cardinality_histogram(df: DataFrame, group: str, unit: str, bands: list[tuple[int, int | None, str]]) -> DataFrame:
    """How many groups have how many distinct units."""
    sizes = df.groupBy(group).agg(F.count_distinct(unit).alias("k"))
    label = None
    for lo, hi, name in bands:
        cond = (F.col("k") >= lo) & ((F.col("k") <= hi) if hi else F.lit(True))
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return sizes.groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("n_groups"))


def groups_with_several(df: DataFrame, family: str, group: str, category: str, least: int = 2) -> DataFrame:
    """Per family: groups with at least ``least`` distinct categories."""
    per = df.groupBy(family, group).agg(F.count_distinct(category).alias("k"))
    return per.groupBy(family).agg(F.count_if(F.col("k") >= least).alias("n_groups"))


def flag_matrix(df: DataFrame, entity: str, flags: dict[str, Column], least: int = 2) -> DataFrame:
    """Entities by flags, for entities that carry at least ``least`` flags anywhere in their rows."""
    agg = df.groupBy(entity).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f) for f, c in flags.items()])
    total = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return agg.where(total >= least)


def percentiles(df: DataFrame, value: str, by: list[str] = (), qs: dict[str, float] | None = None, exact: bool = True,
                accuracy: int = 10_000) -> DataFrame:
    """Median, p90, minimum and maximum per group: exact by radix selection, or from a sketch of bounded size."""
    qs = qs or {"median": 0.5, "p90": 0.9}
    if exact:
        return quantiles(df, value, list(by), qs)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
                               *[F.percentile_approx(value, q, accuracy).alias(n) for n, q in qs.items()])


def metric_rows(parts: list[tuple[str, DataFrame, Column, Column | None]]) -> DataFrame:
    """Report lines as data: ``(metric, value, denominator, status)``; the status says if the value can be quoted."""
    out = None
    for name, df, num, den in parts:
        row = df.agg(num.cast("bigint").alias("value"), (den if den is not None else F.lit(None)).cast("bigint").alias("denominator"))
        row = row.select(F.lit(name).alias("metric"), "value", "denominator",
                         F.when(F.col("denominator") == 0, "NO_DENOMINATOR").otherwise("OK").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def first_form(df: DataFrame, text: str, order: str) -> DataFrame:
    """First-seen spelling of each case-folded value."""
    return df.groupBy(F.lower(text).alias("folded")).agg(F.min_by(text, order).alias("display"), F.count(F.lit(1)).alias("n"))


def fill_report(df: DataFrame, source: str, route: str) -> DataFrame:
    """Filled and still missing rows per source and route."""
    return df.groupBy(source, F.coalesce(F.when(F.col(route) != "", F.col(route)), F.lit("still_missing")).alias(route)).agg(
        F.count(F.lit(1)).alias("n"))
