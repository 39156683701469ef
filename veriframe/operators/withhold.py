"""Withhold fields of nested rows: paths compiled to one rewrite of each column.

A path names a column and the fields below it: ``tables.reports[].authors``, where ``[]`` stands for every element of an array and ``{}`` for
every value of a map, at any depth. Every withheld field gets a replacement; a list of locators beside it (structs that name a field and cite
where its value comes from) loses the entries of that field.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCATORS, LOCATOR_FIELD = "_locators", "field"


def compile_paths(rules: dict[str, str | None]) -> dict:
    """Paths to a tree: field, ``[]`` or ``{}`` -> subtree; a leaf is ``(replacement,)``. One path may not go through a withheld field."""
    tree: dict = {}
    for path, value in rules.items():
        steps = re.findall(r"\[\]|\{\}|[^.\[\]{}]+", path)
        if not steps or steps[-1] in ("[]", "{}") or "".join(steps) != path.replace(".", ""):
            raise ValueError(f"not a path to a field: {path!r}")
        node = tree
        for s in steps[:-1]:
            node = node.setdefault(s, {})
            if isinstance(node, tuple):
                raise ValueError(f"{path!r} goes through a withheld field")
        if steps[-1] in node:
            raise ValueError(f"{path!r} is withheld twice or holds a withheld field")
        node[steps[-1]] = (value,)
    return tree


def _leaves(tree: dict) -> list[str]:
    return [k for k, v in tree.items() if isinstance(v, tuple)]


def _named(tree: dict) -> Column:
    return lambda loc: F.coalesce(loc[LOCATOR_FIELD].isin(_leaves(tree)), F.lit(False))


def _check(dtype: T.StructType, tree: dict, where: str) -> None:
    lost = [k for k in tree if k not in dtype.names]
    if lost:
        raise ValueError(f"no field {', '.join(lost)} in {where}")


def _inner(dtype: T.DataType, tree: dict, where: str):
    """The subtree for the elements of an array or the values of a map."""
    step = "[]" if isinstance(dtype, T.ArrayType) else "{}" if isinstance(dtype, T.MapType) else None
    if step is None or set(tree) != {step}:
        raise ValueError(f"{where} is {dtype.simpleString()}, which {', '.join(tree)} does not lead into")
    return tree[step]


def _rewrite(c: Column, dtype: T.DataType, tree: dict, where: str) -> Column:
    if isinstance(dtype, T.StructType):
        _check(dtype, tree, where)
        fields = []
        for f in dtype.fields:
            node = tree.get(f.name)
            if isinstance(node, tuple):
                out = F.lit(node[0]).cast(f.dataType)
            elif node:
                out = _rewrite(c[f.name], f.dataType, node, f"{where}.{f.name}")
            elif f.name == LOCATORS and _leaves(tree):
                out = F.filter(c[f.name], lambda loc: ~_named(tree)(loc))
            else:
                out = c[f.name]
            fields.append(out.alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields))
    inner = _inner(dtype, tree, where)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _rewrite(x, dtype.elementType, inner, f"{where}[]"))
    return F.transform_values(c, lambda k, v: _rewrite(v, dtype.valueType, inner, f"{where}{{}}"))


def _counts(c: Column, dtype: T.DataType, tree: dict) -> tuple[Column, Column]:
    """How many values differ from their replacement, and how many locators go."""
    zero = F.lit(0).cast("bigint")
    if isinstance(dtype, T.StructType):
        values, locators = zero, zero
        for f in dtype.fields:
            node = tree.get(f.name)
            if isinstance(node, tuple):
                values = values + (c.isNotNull() & ~c[f.name].eqNullSafe(F.lit(node[0]).cast(f.dataType))).cast("bigint")
            elif node:
                v, n = _counts(c[f.name], f.dataType, node)
                values, locators = values + v, locators + n
            elif f.name == LOCATORS and _leaves(tree):
                locators = locators + F.greatest(F.coalesce(F.size(F.filter(c[f.name], _named(tree))), F.lit(0)), F.lit(0)).cast("bigint")
        return values, locators
    items, inner = (c, dtype.elementType) if isinstance(dtype, T.ArrayType) else (F.map_values(c), dtype.valueType)
    below = next(iter(tree.values()))
    total = lambda i: F.coalesce(F.reduce(F.transform(items, lambda x: _counts(x, inner, below)[i]), zero, lambda a, b: a + b), zero)
    return total(0), total(1)


def withhold_fields(df: DataFrame, rules: dict[str, str | None], values: str = "withheld_values", locators: str = "withheld_locators") -> DataFrame:
    """``df`` with the fields of ``rules`` (path -> replacement, cast to the field's type) withheld, plus how many values changed and how many
    locators were dropped in each row.

    A NULL struct, array or map stays NULL; a NULL field under a struct that is there is replaced like any other. A path that the schema does
    not have is an error. Nothing is exploded: the rewrite is one projection.
    """
    tree = compile_paths(rules)
    _check(df.schema, tree, "the table")
    zero = F.lit(0).cast("bigint")
    out, n_values, n_locators = [], zero, zero
    for f in df.schema.fields:
        node, c = tree.get(f.name), F.col(f"`{f.name}`")
        if isinstance(node, tuple):
            out.append(F.lit(node[0]).cast(f.dataType).alias(f.name))
            n_values = n_values + (~c.eqNullSafe(F.lit(node[0]).cast(f.dataType))).cast("bigint")
        elif node:
            out.append(_rewrite(c, f.dataType, node, f.name).alias(f.name))
            v, n = _counts(c, f.dataType, node)
            n_values, n_locators = n_values + v, n_locators + n
        else:
            out.append(c)
    return df.select(*out, n_values.alias(values), n_locators.alias(locators))


def note_once(note: Column, clause: str) -> Column:
    """The note with ``clause`` added behind ``; ``, unless it has it; a note that says nothing is replaced."""
    n = F.coalesce(note, F.lit(""))
    nothing = (n == "") | n.isin("NR", "NA")
    return F.when(F.contains(n, F.lit(clause)), n).when(nothing, clause).otherwise(F.concat(n, F.lit("; "), F.lit(clause)))
