"""Many search routes over the same records: one pass through a term index.

A route is a list of term groups; a record is on a route if every group has at least one term in its text. A term is one or more words; a
space or hyphen between two of them may also be missing in the text, and ``*`` at the end stands for any further word characters. Terms
become surface forms (the ways their words can be written together), and the forms of all routes make one table. A record is read once,
however many routes there are: its word sequences meet that table by equality. Equal groups of several routes are one group, and a route is
looked up by its rarest group only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage

#: Stands between two words of a form. The text has one white space or hyphen there.
GLUE = "\u0001"


def term_forms(term: str) -> list[tuple[str, bool]]:
    """The surface forms of a term, and whether the last word is only the beginning of one."""
    bare = term.strip().strip('"').strip()
    open_end = bare.endswith("*")
    words = re.findall(r"[a-z0-9]+", bare.lower())
    if not words:
        raise ValueError(f"a term needs a letter or digit: {term!r}")
    forms = [words[0]]
    for w in words[1:]:
        forms = [f + g + w for f in forms for g in (GLUE, "")]
    return [(f, open_end) for f in forms]


def route_tables(spark: SparkSession, routes: dict[str, list[list[str]]]) -> tuple[DataFrame, dict[str, list[int]]]:
    """``form, open_end, group`` of all terms, and the groups that each route needs. Equal groups have one number."""
    number: dict[frozenset, int] = {}
    needs = {r: sorted({number.setdefault(frozenset(f for t in g for f in term_forms(t)), len(number)) for g in groups}) for r, groups in routes.items()}
    forms = [(f, o, n) for g, n in number.items() for f, o in sorted(g)]
    # Written, so that its size is known to the planner: a list from the driver counts as too large to be sent.
    return cut_lineage(spark.createDataFrame(forms, "form string, open_end boolean, `group` int")), needs


class Heads:
    """The first words of the forms, by how many words a form has: a sequence that begins with none of them is no form and makes no row."""

    def __init__(self, forms: DataFrame):
        w = F.split("form", GLUE)
        found = forms.select(F.size(w).alias("n"), F.get(w, F.lit(0)).alias("first"), ((F.size(w) == 1) & F.col("open_end")).alias("cut")).distinct().collect()
        self.longest = max((r["n"] for r in found), default=1)
        self.whole = {n: sorted({r["first"] for r in found if r["n"] == n and not r["cut"]}) for n in range(1, self.longest + 1)}
        cut = {r["first"] for r in found if r["cut"]}
        self.cut = {n: sorted(x for x in cut if len(x) == n) for n in sorted(map(len, cut))}

    def begin(self, word: Column, n: int) -> Column:
        """Whether ``word`` can be the first of a form of ``n`` words."""
        hit = word.isin(self.whole[n])
        for size, words in (self.cut if n == 1 else {}).items():
            hit = hit | F.substring(word, 1, size).isin(words)
        return hit


def _spans(n: int, heads: Heads) -> Callable[[Column], Column]:
    """The runs of ``n`` words of a glued part that can be forms."""
    def spans(w: Column) -> Column:
        last = F.size(w) - (n - 1)
        starts = F.filter(F.sequence(F.lit(1), last), lambda i: heads.begin(F.get(w, i - 1), n))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), GLUE))
        return F.when(last > 0, runs).otherwise(F.array().cast("array<string>"))
    return lambda p: tx.bound(F.split(p, GLUE), spans)


def word_sequences(text: Column, heads: Heads) -> Column:
    """Distinct sequences of words with one white space or hyphen between them, joined by ``GLUE``, as long as forms are and with one of
    their first words."""
    word = r"\p{L}\p{N}\p{M}_"
    joined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?<=[{word}])[\p{{IsWhite_Space}}-](?=[{word}])", GLUE)
    parts = F.filter(F.split(joined, rf"[^{word}{GLUE}]+"), lambda x: x != "")

    def sequences(ps: Column) -> Column:
        single = F.filter(F.array_distinct(F.flatten(F.transform(ps, lambda p: F.split(p, GLUE)))), lambda w: heads.begin(w, 1))
        longer = [F.flatten(F.transform(ps, _spans(n, heads))) for n in range(2, heads.longest + 1) if heads.whole[n]]
        return F.array_distinct(F.concat(single, *longer))

    return tx.bound(parts, sequences)


def full_groups(records: DataFrame, key: str, text: str, forms: DataFrame) -> DataFrame:
    """``(key, group)`` for every group that has a term in the record."""
    lengths = forms.agg(F.array_sort(F.collect_set(F.when(F.col("open_end"), F.length("form"))))).first()[0]
    seqs = records.select(F.col(key).alias("_k"), F.explode(word_sequences(F.col(text), Heads(forms))).alias("_s"))
    # A sequence also stands for its own beginnings, of the lengths that open-ended forms have; the words after the cut are not needed.
    cuts = F.array(*[F.when(F.length("_s") >= n, F.struct(F.substring("_s", 1, n).alias("form"), F.lit(True).alias("open_end"))) for n in lengths],
                   F.struct(F.col("_s").alias("form"), F.lit(False).alias("open_end")))
    probes = seqs.select("_k", F.explode(F.array_compact(cuts)).alias("c")).select("_k", "c.form", "c.open_end")
    return probes.join(forms, ["form", "open_end"]).select("_k", "group").distinct().select(F.col("_k").alias(key), "group")


def records_on_routes(records: DataFrame, key: str, text: str, routes: dict[str, list[list[str]]]) -> DataFrame:
    """``(key, route)`` for every record and route it is on, in order of no importance.

    The records' words are looked up once; only records with a full group go on. A NULL text is empty; ``key`` identifies a record. A route
    without groups holds every record.
    """
    spark = records.sparkSession
    forms, needs = route_tables(spark, routes)
    hits = cut_lineage(full_groups(records, key, text, forms))
    sizes = {r["group"]: r["n"] for r in hits.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a group
    # A route is filed under the group that the fewest records have.
    filed = [(r, min(gs, key=lambda g: (sizes.get(g, 0), g)), gs) for r, gs in needs.items() if gs]
    lead = cut_lineage(spark.createDataFrame(filed, "route string, `group` int, groups array<int>"))
    held = hits.groupBy(key).agg(F.collect_list("group").alias("_held"))
    out = hits.join(lead, "group").join(held, key).where(F.size(F.array_except("groups", "_held")) == 0).select(key, "route")
    free = spark.createDataFrame([(r,) for r, gs in needs.items() if not gs], "route string")
    return out.unionByName(records.select(key).join(F.broadcast(free), F.lit(True)))
