"""Aligning two versions of a table and comparing them cell by cell."""

from __future__ import annotations

from functools import reduce

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stats import ratio
from ..session import cut_lineage
from .ordered import row_numbers

#: A parent with more rows is not put into one task.
HOT_PARENT = 100_000

KINDS = ("identifier", "count", "coded", "free_text")


# --- column metadata ------------------------------------------------------------------------------

def slot_pairs(names: list[str], a: str = "A", b: str = "B") -> dict[str, str]:
    """Columns that differ only by an upper-case slot token: ``{slot A column: slot B column}``."""
    out = {}
    for name in names:
        parts = re.split(r"([_.])", name)
        for i, part in enumerate(parts):
            other = "".join([*parts[:i], b, *parts[i + 1:]])
            if part == a and other in names:
                out[name] = other
    return out


def unscored(name: str) -> bool:
    """Locator and notes columns are read, not scored."""
    return "locator" in name or name.endswith("notes")


def compared_columns(kinds: dict[str, str], families: dict[str, str] | None = None, lists: set[str] = frozenset(),
                     skip: set[str] = frozenset(), pair_slots: bool = True) -> list[dict]:
    """What to compare: a name, the column on each side, kind, family and whether it is a list.

    With ``pair_slots`` rater a's own slot is compared with rater b's own slot.
    """
    slots = slot_pairs(list(kinds)) if pair_slots else {}
    out = []
    for name, kind in kinds.items():
        if kind not in KINDS:
            raise ValueError(f"{name}: kind {kind!r} not in {KINDS}")
        if name in skip or unscored(name) or name in slots.values():
            continue
        out.append({"name": name, "a": name, "b": slots.get(name, name), "kind": kind,
                    "family": (families or {}).get(name, "other"), "is_list": name in lists})
    return out


def slot_warnings(df: DataFrame, key: str, own: str, names: list[str]) -> DataFrame:
    """Cells a rater filled in the other rater's slot."""
    pairs = slot_pairs(names)
    other = [b if own == "A" else a for a, b in pairs.items()]
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in other])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.*").where("value IS NOT NULL AND value <> ''")


# --- alignment ------------------------------------------------------------------------------------

def content_key(cols: list[str]) -> Column:
    """Lower-case alphanumerics of the content columns; ``a|b`` takes the first filled one."""
    parts = [tx.first_filled(*[F.col(x).cast("string") for x in c.split("|")]) for c in cols]
    return F.concat_ws("|", *[F.regexp_replace(F.lower(p), "[^0-9a-z]+", "") for p in parts])


def _numbered(df: DataFrame, group: list[str], order: list[str], bucket: Column) -> DataFrame:
    return row_numbers(df, order, bucket, group, "_n")


def _outer(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    left = a.select(*on, F.struct(*[c for c in a.columns if not c.startswith("_")]).alias("a"))
    right = b.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(on)], F.struct(*[c for c in b.columns if not c.startswith("_")]).alias("b"))
    # NULL keys pair with NULL keys, as they do in the numbering.
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(on)])
    j = left.join(right, same, "full_outer").select(*[F.coalesce(c, f"_b{i}").alias(c) for i, c in enumerate(on)], "a", "b")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.select(*on, F.when(both, how).when(F.col("a").isNotNull(), "only_a").otherwise("only_b").alias("how"), "a", "b")


def align_by_key(a: DataFrame, b: DataFrame, key: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """Pair rows by key. Of repeated keys the first (or last) row by order is used."""
    pick = {"first": F.min_by, "last": F.max_by}[keep]

    def one(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        g = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
        return g.select(*key, *[F.col("_r")[c].alias(c) for c in rest])
    return _outer(one(a), one(b), key, "key").select("how", "a", "b")


def align_by_ordinal(a: DataFrame, b: DataFrame, parent: str, order: list[str], bucket: Column) -> DataFrame:
    """Pair the n-th row of a parent with the n-th row of the same parent."""
    na, nb = (_numbered(x.withColumn("_p", F.col(parent)), ["_p"], order, bucket) for x in (a, b))
    return _outer(na, nb, ["_p", "_n"], "ordinal").select("how", "a", "b")


def align_by_content(a: DataFrame, b: DataFrame, parent: str, content: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Pair by parent, content key and occurrence number; what is left over is paired by ordinal.

    The rows of a parent meet in one task, with one shuffle of both versions; those of parents with over ``HOT_PARENT`` rows are numbered in
    buckets and joined."""
    if not _same_fields(a, b):
        return _content_in_buckets(a, b, parent, content, order, bucket)
    counts = a.select(parent).unionByName(b.select(parent)).groupBy(F.col(parent).alias("_hot")).agg(F.count(F.lit(1)).alias("_c"))
    hot = cut_lineage(counts.where(F.col("_c") > HOT_PARENT).select("_hot"))
    if hot.isEmpty():
        return _content_in_parents(a, b, parent, content, order)
    split = lambda x, how: x.join(hot, F.col(parent).eqNullSafe(F.col("_hot")), how)
    few = _content_in_parents(split(a, "left_anti"), split(b, "left_anti"), parent, content, order)
    return few.unionByName(_content_in_buckets(split(a, "left_semi"), split(b, "left_semi"), parent, content, order, bucket))


def _same_fields(a: DataFrame, b: DataFrame) -> bool:
    return {f.name: f.dataType for f in a.schema} == {f.name: f.dataType for f in b.schema}


def _content_in_parents(a: DataFrame, b: DataFrame, parent: str, content: list[str], order: list[str]) -> DataFrame:
    rows = a.withColumn("_in_a", F.lit(True)).unionByName(b.withColumn("_in_a", F.lit(False))).withColumn("_p", F.col(parent))
    # Every step below groups by the parent and more, so Spark shuffles here only.
    rows = rows.repartition("_p").withColumn("_k", content_key(content))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_p", "_k", "_in_a").orderBy(*order)))
    paired = F.count(F.lit(1)).over(W.partitionBy("_p", "_k", "_n")) == 2
    rows = rows.withColumn("_paired", paired).withColumn("_rest", F.row_number().over(W.partitionBy("_p", "_in_a", "_paired").orderBy(*order)))
    # A pair by content is known by its key and number, a pair by ordinal by its number among the rest.
    rows = rows.select("_p", "_paired", F.when(F.col("_paired"), F.col("_k")).alias("_k"), F.when(F.col("_paired"), F.col("_n")).otherwise(F.col("_rest")).alias("_n"),
                       F.when(F.col("_in_a"), F.struct(*a.columns)).alias("a"), F.when(~F.col("_in_a"), F.struct(*b.columns)).alias("b"))
    pairs = rows.groupBy("_p", "_paired", "_k", "_n").agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    return pairs.select(F.when(F.col("_paired"), "content").when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("ordinal").alias("how"), "a", "b")


def _content_in_buckets(a: DataFrame, b: DataFrame, parent: str, content: list[str], order: list[str], bucket: Column) -> DataFrame:
    def side(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("_p", F.col(parent)).withColumn("_k", content_key(content))
        return _numbered(keyed, ["_p", "_k"], order, bucket)
    # Read three times below, so it is computed once and written.
    first = cut_lineage(_outer(side(a), side(b), ["_p", "_k", "_n"], "content").select("how", "a", "b"))
    rest_a = first.where("how = 'only_a'").select("a.*")
    rest_b = first.where("how = 'only_b'").select("b.*")
    return (first.where("how = 'content'").select("how", "a", "b")
            .unionByName(align_by_ordinal(rest_a, rest_b, parent, order, bucket)))


def key_overlap(a: DataFrame, b: DataFrame, key: list[str]) -> float:
    """Shared keys over the smaller side's distinct keys: one aggregate, one number."""
    t = (a.select(*key, F.lit(1).alias("s")).unionByName(b.select(*key, F.lit(2).alias("s")))
         .groupBy(*key).agg(F.bit_or("s").alias("s")))
    r = t.agg(F.count_if(F.col("s") == 3).alias("both"), F.count_if(F.col("s").bitwiseAND(1) > 0).alias("a"),
              F.count_if(F.col("s").bitwiseAND(2) > 0).alias("b")).first()
    return r.both / max(1, min(r.a, r.b))


def align(a: DataFrame, b: DataFrame, key: list[str], parent: str, order: list[str], bucket: Column,
          content: list[str] | None = None, mode: str = "auto", least_overlap: float = 0.5) -> DataFrame:
    """Content keys where given; else keys, unless under half of them are shared, then ordinals."""
    if mode not in ("auto", "content", "key", "ordinal"):
        raise ValueError(f"unknown mode {mode!r}")
    if content and mode in ("auto", "content"):
        return align_by_content(a, b, parent, content, order, bucket)
    if mode == "ordinal" or (mode != "key" and key_overlap(a, b, key) < least_overlap):
        return align_by_ordinal(a, b, parent, order, bucket)
    return align_by_key(a, b, key, order)


# --- cells ----------------------------------------------------------------------------------------

def _value(c: Column, kind: str, is_list: bool) -> Column:
    s = F.coalesce(tx.squeeze(c.cast("string")), F.lit(""))
    if is_list:
        return tx.set_cell(s)
    return F.when(s == "", "").otherwise(tx.count_cell(s)) if kind == "count" else s


def cells(aligned: DataFrame, columns: list[dict], table: str, keep: list[str] = ()) -> DataFrame:
    """One row per compared cell of the matched rows, with both values and a category.

    Both versions are in the aligned row already, so the cells come from one explode, not a join.
    """
    pairs = F.array(*[F.struct(
        F.lit(m["name"]).alias("field"), F.lit(m["family"]).alias("family"), F.lit(m["kind"]).alias("kind"),
        _value(F.col(f"a.{m['a']}"), m["kind"], m["is_list"]).alias("value_a"),
        _value(F.col(f"b.{m['b']}"), m["kind"], m["is_list"]).alias("value_b")) for m in columns])
    long = (aligned.where("how NOT IN ('only_a', 'only_b')")
            .select(F.lit(table).alias("table"), *[F.col(f"a.{k}").alias(k) for k in keep], F.explode(pairs).alias("c"))
            .select("table", *keep, "c.*"))
    a, b = F.col("value_a"), F.col("value_b")
    cat = (F.when((a == "") & (b == ""), "both_empty").when(a == b, "agree").when((a != "") & (b != ""), "disagree")
           .when(a != "", "only_a").otherwise("only_b"))
    return long.withColumn("category", cat)


def _metrics(coded_only: bool = False) -> list[Column]:
    cond = F.col("kind").isin("coded", "count") if coded_only else F.lit(True)
    n = {k: F.coalesce(F.sum(F.when(cond & (F.col("category") == k), F.col("_n"))), F.lit(0)) for k in ("agree", "disagree", "only_a", "only_b")}
    both, any_ = n["agree"] + n["disagree"], n["agree"] + n["disagree"] + n["only_a"] + n["only_b"]
    p = "coded_" if coded_only else ""
    return [any_.alias(f"{p}cells"), *[v.alias(p + k) for k, v in n.items()],
            F.round(ratio(n["agree"], both), 4).alias(f"{p}both_filled"), F.round(ratio(n["agree"], any_), 4).alias(f"{p}any_filled")]


def diff_rollup(cell_rows: DataFrame, total: str = "ALL") -> DataFrame:
    """Agreement by table, by family, by table and field, and overall; all cells and coded cells only.

    Cells are counted by field and category first; the grouping sets expand that small table only.
    """
    dims = ["table", "family", "field"]
    counts = cell_rows.groupBy(*dims, "kind", "category").agg(F.count(F.lit(1)).alias("_n"))
    sets = [["table"], ["family"], ["table", "field"], []]
    g = counts.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        *[F.grouping(c).alias(f"_g{c}") for c in dims], *_metrics(), *_metrics(True),
        F.coalesce(F.sum(F.when(F.col("category") == "both_empty", F.col("_n"))), F.lit(0)).alias("both_empty"))
    return g.select(*[F.when(F.col(f"_g{c}") == 1, total).otherwise(F.col(c)).alias(c) for c in dims],
                    *[c for c in g.columns if c not in dims and not c.startswith("_g")])


def row_coverage(a: DataFrame, b: DataFrame, parent: str, table: str) -> DataFrame:
    """Rows per parent on each side."""
    both = a.select(parent, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(parent, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy(parent).agg(F.sum("x").alias("rows_a"), F.sum("y").alias("rows_b")).withColumn("table", F.lit(table))


def only_rows(aligned: DataFrame) -> DataFrame:
    """Rows of one side only, as JSON."""
    return (aligned.where("how IN ('only_a', 'only_b')")
            .select("how", F.coalesce(F.to_json("a"), F.to_json("b")).alias("row")))


def empty_by_both(cell_rows: DataFrame, parent: str, notes: DataFrame) -> DataFrame:
    """Cells empty on both sides, per field and parent, with the reason a note gives for them.

    ``notes``: table, field, parent (NULL for any), issue.
    """
    e = cell_rows.where("category = 'both_empty'").groupBy("table", "field", parent).agg(F.count(F.lit(1)).alias("n"))
    n = notes.groupBy("table", "field", parent).agg(F.collect_set("issue").alias("issues"))
    own = n.where(F.col(parent).isNotNull())
    any_ = n.where(F.col(parent).isNull()).drop(parent).withColumnRenamed("issues", "_any")
    j = e.join(own, ["table", "field", parent], "left").join(any_, ["table", "field"], "left")
    empty = F.array().cast("array<string>")
    issues = F.array_sort(F.array_union(F.coalesce("issues", empty), F.coalesce("_any", empty)))
    reason = (F.when(F.array_contains(issues, "not_extractable_from_text"), "not_extractable_from_text")
              .when(F.size(issues) > 0, F.concat(F.lit("flagged: "), F.array_join(issues, ", "))).otherwise("unflagged"))
    return j.select("table", "field", parent, "n", reason.alias("reason"))


def _rounded(x: Column, scale: Column) -> Column:
    """``x * scale`` rounded to an integer, half to even, as if the product were exact.

    A product that comes out halfway between integers may have been a little less or more; its rounding error, from the products of
    the factors' halves (27 bits each), tells which.
    """
    half = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    xh, sh = half(x), half(scale)
    xl, sl = x - xh, scale - sh
    p = x * scale
    error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    low = F.floor(p).cast("double")
    return F.when((p - low == 0.5) & (error < 0), low).when((p - low == 0.5) & (error > 0), low + 1).otherwise(F.rint(p))


def within_rounding(a: Column, b: Column) -> Column:
    """Do two numeric cells agree at the coarser of their precisions? NULL if either is not a number.

    The binary value is rounded, half to even, at any number of decimals: 2.675 is a little less than it is written, and agrees with 2.67.
    """
    x, y = tx.parse_number(a).cast("double"), tx.parse_number(b).cast("double")
    scale = F.pow(F.lit(10.0), F.least(tx.decimals_of(a), tx.decimals_of(b)).cast("double"))
    # Beyond 2^52 a double has no fraction left to round.
    small = (F.abs(x * scale) < 2.0 ** 52) & (F.abs(y * scale) < 2.0 ** 52)
    return F.when(x.isNotNull() & y.isNotNull(), (x == y) | (small & (_rounded(x, scale) == _rounded(y, scale))))


def numeric_rescore(cell_rows: DataFrame) -> DataFrame:
    """Disagreements that are only a matter of rounding become ``agree_within_rounding``."""
    hit = (F.col("category") == "disagree") & F.coalesce(within_rounding(F.col("value_a"), F.col("value_b")), F.lit(False))
    return cell_rows.withColumn("category", F.when(hit, "agree_within_rounding").otherwise(F.col("category")))


def run_comparison(a: DataFrame, b: DataFrame, aligned: DataFrame, cell_rows: DataFrame, by: str) -> DataFrame:
    """Row recall and precision of run b against run a, and cell agreement on the matched rows, per group.

    Run a is the reference of the comparison, not the truth.
    """
    rows = (a.select(by, F.lit(1).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("m"))
            .unionByName(b.select(by, F.lit(0).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("m")))
            .unionByName(aligned.where("how NOT IN ('only_a', 'only_b')")
                         .select(F.col(f"a.{by}").alias(by), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("m"))))
    r = rows.groupBy(by).agg(F.sum("x").alias("rows_a"), F.sum("y").alias("rows_b"), F.sum("m").alias("matched"))
    good = F.count_if(F.col("category").isin("agree", "agree_within_rounding"))
    k = cell_rows.where("category <> 'both_empty'").groupBy(by).agg(good.alias("agree"), F.count(F.lit(1)).alias("cells"))
    j = r.join(k, by, "left")
    return j.select(by, "rows_a", "rows_b", "matched", F.round(ratio(F.col("matched"), F.col("rows_a")), 3).alias("recall"),
                    F.round(ratio(F.col("matched"), F.col("rows_b")), 3).alias("precision"),
                    F.round(ratio(F.col("agree"), F.col("cells")), 3).alias("cell_agreement"))
