"""Nested rows to flat columns, locator lists, and schema versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaf_fields(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of the leaves; fields that start with ``_`` are metadata and left out."""
    out = []
    for f in schema.fields:
        if f.name.startswith("_"):
            continue
        name = f"{prefix}{f.name}"
        out += leaf_fields(f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [name]
    return out


def flatten(df: DataFrame) -> DataFrame:
    """One column per leaf, named by its dotted path."""
    def path(name: str) -> Column:
        parts = name.split(".")
        c = F.col(f"`{parts[0]}`")
        for p in parts[1:]:
            c = c[p]
        return c.alias(name)
    return df.select(*[path(n) for n in leaf_fields(df.schema)])


def explode_tables(runs: DataFrame, key: str, tables: str = "tables") -> dict[str, DataFrame]:
    """One flat DataFrame per array of rows in a nested document, keyed by the document's id."""
    struct = runs.schema[tables].dataType
    return {f.name: flatten(runs.select(F.col(key).alias("doc"), F.explode(F.col(f"{tables}.{f.name}")).alias("r")).select("doc", "r.*"))
            for f in struct.fields}


def locators_to_map(locators: Column, missing: str = "NR") -> Column:
    """``[{field, page, quote}]`` to ``field -> 'p. <page>: "<quote>"'``; the last entry of a field wins."""
    part = lambda c: F.coalesce(F.when(c != "", c), F.lit(missing))
    entries = F.transform(locators, lambda x: F.struct(x["field"], F.concat(
        F.lit("p. "), part(x["page"].cast("string")), F.lit(': "'), part(x["quote"]), F.lit('"'))))
    names = F.transform(locators, lambda x: x["field"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["field"]))
    return F.map_from_entries(last)


def map_to_locators(m: Column) -> Column:
    """Back to an array of ``{field, page, quote}``, in field order."""
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("field"), F.regexp_extract(e["value"], r'^p\. (.*?): "', 1).alias("page"),
        F.regexp_extract(e["value"], r'(?s)^p\. .*?: "(.*)"$', 1).alias("quote"))))


def schema_version(schema: T.StructType, marks: dict[str, set[str]], default: str) -> str:
    """Version whose distinctive leaf occurs in the schema (metadata only)."""
    leaves = {n.split(".")[-1] for n in leaf_fields(schema)}
    return next((v for v, fields in marks.items() if leaves & fields), default)


def missing_destinations(schema: T.StructType, aliases: dict[str, list[str]], available: set[str]) -> list[str]:
    """Leaves that have no destination column, after aliases."""
    return sorted(n for n in leaf_fields(schema) if any(t not in available for t in aliases.get(n, [n])))


def migrate(df: DataFrame, renames: dict[str, str], constants: dict[str, Column] | None = None, available: set[str] | None = None) -> DataFrame:
    """Rename flat columns of a newer version to their older destinations; refuse to lose a column."""
    targets = {c: renames.get(c, c) for c in df.columns}
    if available is not None:
        lost = sorted(c for c, t in targets.items() if t not in available)
        if lost:
            raise ValueError(f"no destination for {lost}")
    return df.withColumnsRenamed(renames).withColumns(constants or {})
