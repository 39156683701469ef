"""Ordered rule lists compiled to column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(c: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """Label of the first ``(label, pattern)`` whose pattern occurs in the lower-cased text."""
    s = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for label, pattern in rules:
        hit = s.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def classify_terms(c: Column, rules: list[tuple[str, str]], sep: str = ";", default: str = "other",
                   empty: str = "NR") -> Column:
    """Sorted distinct labels of every term in a separated cell; ``[empty]`` if it has none."""
    terms = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), F.trim), lambda t: t != "")
    labels = F.array_sort(F.array_distinct(F.transform(terms, lambda t: classify(t, rules, default))))
    return F.when(F.size(terms) == 0, F.array(F.lit(empty))).otherwise(labels)


def recode(c: Column, mapping: dict[str, str], default: str | None = "unclear") -> Column:
    """Value recode by a literal map; values outside it get ``default``."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(m, c)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def term_pattern(term: str) -> str:
    """A wildcard phrase as a word-bounded pattern; ``*`` stands for any word characters."""
    parts = [re.escape(w).replace(r"\*", r"[\p{L}\p{N}_]*") for w in term.lower().split()]
    return r"(?<![\p{L}\p{N}_])" + r"[\s-]+".join(parts) + r"(?![\p{L}\p{N}_])"


def group_pattern(terms: list[str]) -> str:
    return "(?:" + "|".join(term_pattern(t) for t in terms) + ")"


def matches_all_groups(c: Column, groups: list[list[str]]) -> Column:
    """True when every term group has at least one phrase in the text."""
    s = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(True)
    for g in groups:
        out = out & s.rlike(group_pattern(g))
    return out


def fill_not_applicable(cols: dict[str, tuple[str, list[str]]], blank_as: str = "NA") -> dict[str, Column]:
    """For each target, ``(condition column, values)``: fill a blank target where the condition holds.

    A blank condition column never triggers a fill.
    """
    out = {}
    for target, (cond, values) in cols.items():
        t, k = F.col(target), F.col(cond)
        empty = t.isNull() | (F.trim(t.cast("string")) == "")
        out[target] = F.when(empty & k.isNotNull() & k.isin(values), F.lit(blank_as)).otherwise(t)
    return out


def first_verdict(cases: list[tuple[Column, str]], default: str) -> Column:
    """Verdict of the first condition that holds (a NULL condition does not hold)."""
    out = None
    for cond, label in cases:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def problems(checks: list[tuple[Column, str]]) -> Column:
    """Messages of the checks that hold, in order; empty array means valid."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]))
