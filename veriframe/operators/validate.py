"""Record, batch and referential validation. Bad rows are reported with reasons, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import problems


def schema_checks(required: list[str] = (), enums: dict[str, list[str]] | None = None,
                  max_length: dict[str, int] | None = None, types: dict[str, str] | None = None) -> list[tuple[Column, str]]:
    """Checks for :func:`problems`: required fields, allowed values, length limits, parseable types."""
    checks = []
    for f in required:
        checks.append((F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), f"{f}: missing"))
    for f, allowed in (enums or {}).items():
        checks.append((F.col(f).isNotNull() & ~F.col(f).isin(list(allowed)), f"{f}: not in list"))
    for f, n in (max_length or {}).items():
        checks.append((F.length(f) > n, f"{f}: longer than {n}"))
    for f, t in (types or {}).items():
        checks.append((F.col(f).isNotNull() & F.col(f).try_cast(t).isNull(), f"{f}: not {t}"))
    return checks


def validate(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """Add ``errors`` (array of messages) and ``valid``."""
    return df.withColumn("errors", problems(checks)).withColumn("valid", F.size("errors") == 0)


def batch_validation(expected: DataFrame, got: DataFrame, batch: str, key: str, checks: list[tuple[Column, str]]) -> DataFrame:
    """Per batch: expected, returned, missing, unexpected and duplicate ids, and rows that break a rule."""
    g = validate(got, checks).groupBy(batch, key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("bad"))
    e = expected.select(batch, key).withColumn("want", F.lit(1))
    j = e.join(g, [batch, key], "full_outer")
    return j.groupBy(batch).agg(
        F.count("want").alias("expected"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("returned"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("want").isNull()).alias("unexpected"),
        F.count_if(F.col("n") > 1).alias("duplicated"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("rule_breaks"),
    ).withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("duplicated") == 0)
                 & (F.col("rule_breaks") == 0))


def assert_empty(df: DataFrame, message: str) -> None:
    """Raise with a few examples if ``df`` has any row. Reads at most six rows."""
    rows = df.limit(6).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows[:5]]}{' ...' if len(rows) > 5 else ''}")


#: Rows of a table that one task counts by key. The tasks grow with the table, where shuffle partitions are a fixed number and adaptive
#: execution joins them by their bytes, which for keys are few.
ROWS_A_TASK = 2_000_000


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` dealt over ``tasks`` by its columns; a table for one task stays as it is."""
    return df.repartition(tasks, *df.columns) if tasks > 1 else df


def _tasks(df: DataFrame) -> int:
    return -(-df.count() // ROWS_A_TASK)


def foreign_key_gaps(child: DataFrame, fk: list[str], parent: DataFrame, pk: list[str], name: str) -> DataFrame:
    """One row per foreign-key value without a parent. Values are reduced before the join."""
    ks = [f"k{i}" for i in range(len(fk))]
    vals = child.select(*[F.col(c).alias(k) for c, k in zip(fk, ks, strict=True)]).dropna(subset=ks)
    tasks = max(_tasks(child), _tasks(parent))
    vals = _dealt(vals, tasks).groupBy(*ks).agg(F.count(F.lit(1)).alias("rows"))
    keys = _dealt(parent.select(*[F.col(c).alias(k) for c, k in zip(pk, ks, strict=True)]), tasks)
    gaps = vals.join(keys, ks, "left_anti")
    return gaps.select(F.lit(name).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in ks]).alias("key"), "rows")


def duplicate_keys(df: DataFrame, pk: list[str], name: str) -> DataFrame:
    """One row per key that stands several times."""
    return (_dealt(df.select(*pk), _tasks(df)).groupBy(*pk).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
            .select(F.lit(name).alias("check"), F.concat_ws("|", *[F.col(c).cast("string") for c in pk]).alias("key"), "rows"))


def nested_identity_errors(root_ids: list[Column], child_ids: Column, known_ids: Column) -> Column:
    """Problems of a nested document: root ids disagree, a child id is unknown or repeated."""
    same = F.lit(True)
    for other in root_ids[1:]:
        same = same & root_ids[0].eqNullSafe(other)
    return problems([
        (~same, "root ids differ"),
        (F.size(F.array_except(child_ids, known_ids)) > 0, "unknown child id"),
        (F.size(F.array_distinct(child_ids)) < F.size(child_ids), "repeated child id"),
    ])
