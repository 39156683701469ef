"""Totals over the numeric leaves of JSON documents of any shape and depth."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import cut_lineage

NUMBERS = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def brackets(json: Column) -> Column:
    """The brackets of a JSON text in order; those inside strings do not count. Pairs that hold nothing stand once where several follow each other."""
    held = F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")
    return F.regexp_replace(held, r"(?:\{\}|\[\])+", "{}")


def nesting(held: Column) -> Column:
    """How deep the ``brackets`` of a text are nested."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.when(x.isin("[", "{"), 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(acc["most"], at).alias("most"))

    return F.reduce(F.filter(F.split(held, ""), lambda x: x != ""), zero, step, lambda acc: acc["most"])


def json_leaves(docs: DataFrame, key: list[str], json: str, objects: list[str] | None = None) -> DataFrame:
    """One row for every leaf: the key, ``top`` (the member of the outermost object it is under), ``in_object`` (whether that member is an
    object; with ``objects`` only members of these names are looked at, others count as none), ``name`` (the member it is, NULL for array elements) and ``leaf`` (a variant).

    The documents are opened level by level inside one plan: a leaf that is reached early stays as it is. The number of levels is that of the
    deepest document; they are parsed and written once. Text that is not JSON gives one row with a NULL leaf; so does an empty array or object an
    empty one.
    """
    names = [f"_k{i}" for i in range(len(key))]
    # Documents are made and parsed once; documents of one shape have the same brackets, whose characters are followed once a shape.
    parsed = F.try_parse_json(json)
    rows = cut_lineage(docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)], parsed.alias("_v"),
                                   F.when(parsed.isNotNull(), brackets(F.col(json))).alias("_b")))
    # A plain distinct below a maximum is taken out of the plan; the count keeps it.
    shapes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    deepest = shapes.agg(F.max(nesting(F.col("_b")))).first()[0] or 0
    out = rows.select(*names, "_v", *[F.lit(None).cast("string").alias(x) for x in ("_top", "_name")], F.lit(False).alias("_object"))
    tvf = docs.sparkSession.tvf
    for level in range(deepest):
        opened = out.lateralJoin(tvf.variant_explode_outer(F.col("_v").outer()))
        below = F.col("value").isNotNull()
        named = F.lit(True) if objects is None else F.col("key").isin(*objects)
        top = [F.col("key").alias("_top"), F.coalesce(F.when(named, F.schema_of_variant("value").startswith("OBJECT")), F.lit(False)).alias("_object")]
        out = opened.select(*names, F.coalesce("value", "_v").alias("_v"), *(["_top"] if level else top[:1]),
                            F.when(below, F.col("key")).otherwise(F.col("_name")).alias("_name"), *(["_object"] if level else top[1:]))
    return out.select(*[F.col(n).alias(k) for k, n in zip(key, names, strict=True)], F.col("_top").alias("top"), F.col("_object").alias("in_object"),
                      F.col("_name").alias("name"), F.col("_v").alias("leaf"))


def leaf_number(leaf: Column) -> Column:
    """A numeric leaf without its decimals; NULL for anything else, also for a number written as text."""
    number = F.coalesce(F.try_variant_get(leaf, "$", "decimal(38,6)"), F.try_variant_get(leaf, "$", "double").cast("decimal(38,6)"))
    return F.when(F.schema_of_variant(leaf).rlike(NUMBERS), number.cast("bigint"))


def json_class_totals(docs: DataFrame, key: list[str], json: str, classes: dict[str, list[str]] | None = None,
                      totals: list[str] = fv.TOTALS_BLOCKS, billable: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """Per document the sum of its numeric leaves by class of name, ``billable`` and ``method``.

    A leaf counts for the first class that has its name, or the end of its name after an underscore. If the document states totals of its own
    (an object under one of the ``totals`` names) that do not add up to zero, only they are summed, so that a document with totals and rows
    is not counted twice (``totals block``); else all its leaves (``summed per-record``). A document without such a leaf, and text that is
    not JSON, has zeros and a NULL method. ``key`` identifies a document.
    """
    classes = classes or fv.TOKEN_CLASSES
    ends = {name: r"(?:^|_)(?:" + "|".join(re.escape(x) for x in words) + ")$" for name, words in classes.items()}
    label = None
    for name, pattern in ends.items():
        hit = F.col("name").rlike(pattern)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    # Only a leaf whose name has a class is read as a number.
    leaves = (json_leaves(docs, key, json, totals)
              .select(*key, (F.col("in_object") & F.col("top").isin(*totals)).alias("_block"), F.when(F.col("name").isNotNull(), label).alias("_class"), "leaf")
              .select(*key, "_block", "_class", F.when(F.col("_class").isNotNull(), leaf_number(F.col("leaf"))).alias("_n")))
    counted = F.col("_n")
    sums = leaves.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("_block"), counted)), F.lit(0)).alias("_in_block"), F.coalesce(F.sum(counted), F.lit(0)).alias("_in_all"),
        *[F.coalesce(F.sum(F.when(F.col("_class") == c, F.col("_n"))), F.lit(0)).alias(f"_all_{c}") for c in classes],
        *[F.coalesce(F.sum(F.when(F.col("_block") & (F.col("_class") == c), F.col("_n"))), F.lit(0)).alias(f"_block_{c}") for c in classes])
    block = F.col("_in_block") != 0
    picked = {c: F.when(block, F.col(f"_block_{c}")).otherwise(F.col(f"_all_{c}")) for c in classes}
    method = F.when(block, "totals block").when(F.col("_in_all") != 0, "summed per-record")
    return sums.select(*key, *[v.alias(c) for c, v in picked.items()], sum((picked[c] for c in billable[1:]), picked[billable[0]]).alias("billable"),
                       method.alias("method"))
