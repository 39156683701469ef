"""Lookup, match and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.rules import first_verdict
from ..functions.stats import ratio
from .fuzzy import first_token, similar_titles
from .ranges import sort_key


def lookup(rows: DataFrame, dim: DataFrame, key: str, fields: list[str], missing: str = "") -> DataFrame:
    """Left enrichment by key; a missing row or value becomes ``missing``."""
    d = dim.select(key, *[F.col(f).cast("string").alias(f"_d_{f}") for f in fields])
    return rows.join(d, key, "left").select(*rows.columns, *[F.coalesce(f"_d_{f}", F.lit(missing)).alias(f) for f in fields])


def scope_split(items: DataFrame, other: DataFrame, key: str, reason: str) -> DataFrame:
    """Every item with ``missing_reason`` set where the other side lacks its id."""
    seen = other.select(key).distinct().withColumn("_seen", F.lit(True))
    return items.join(seen, key, "left").withColumn(
        "missing_reason", F.when(F.col("_seen").isNull(), reason).otherwise("")).drop("_seen")


def match_waterfall(incoming: DataFrame, pool: DataFrame, key: str, pool_key: str,
                    rules: list[tuple[str, str, str]]) -> DataFrame:
    """First rule that finds a pool row wins: ``(key, matched, rule)``.

    ``rules`` are ``(name, incoming column, pool column)``, strongest first. Blank keys never match
    and never travel. Each rule is one inner join against one row per pool key; the strongest hit is a
    partial aggregate, so no stage re-reads the remainder of an earlier one.
    """
    hits = None
    for rank, (_, mine, theirs) in enumerate(rules):
        one = pool.where(F.col(theirs) != "").groupBy(F.col(theirs).alias("_k")).agg(F.min(pool_key).alias("_p"))
        h = (incoming.where(F.col(mine) != "").select(key, F.col(mine).alias("_k")).join(one, "_k")
             .select(key, F.struct(F.lit(rank).alias("rank"), F.col("_p").alias("p")).alias("hit")))
        hits = h if hits is None else hits.unionByName(h)
    best = hits.groupBy(key).agg(F.min("hit").alias("hit"))
    names = F.array(*[F.lit(n) for n, _, _ in rules])
    return incoming.select(key).join(best, key, "left").select(
        key, F.col("hit.p").alias("matched"), F.coalesce(F.get(names, F.col("hit.rank")), F.lit("none")).alias("rule"))


def attach_children(parents: DataFrame, key: str, ids: str, children: DataFrame, child_key: str) -> DataFrame:
    """Replace a row's array of child ids by the child rows, in id order.

    The collected list is never longer than the array the row already held.
    """
    links = parents.select(key, F.explode(F.array_distinct(ids)).alias(child_key))
    got = links.join(children, child_key).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(child_key, *[c for c in children.columns if c != child_key]))).alias("children"))
    return parents.join(got, key, "left")


def link_status(rows: DataFrame, targets: DataFrame, keys: list[str], link: str, sentinels: list[str]) -> DataFrame:
    """``matched``, ``unmatched`` or ``parent_level`` (a sentinel link) per row, by composite key."""
    t = targets.select(*keys, F.col(link).alias("_t")).distinct()
    none = F.col(link).isNull() | F.col(link).isin(sentinels)
    linked = rows.where(~none).join(t, [rows[k] == t[k] for k in keys] + [rows[link] == t["_t"]], "left")
    got = linked.select(*[rows[c] for c in rows.columns], F.when(F.col("_t").isNotNull(), "matched").otherwise("unmatched").alias("link_status"))
    return got.unionByName(rows.where(none).withColumn("link_status", F.lit("parent_level")))


def bridge_parents(children: DataFrame, child_key: str, parent: str, bridges: list[DataFrame]) -> DataFrame:
    """Parent of a child that has none of its own, through link tables from either side, joined by '; '."""
    links = bridges[0].select(child_key, parent)
    for b in bridges[1:]:
        links = links.unionByName(b.select(child_key, parent))
    links = links.where(F.col(parent).isNotNull()).distinct()
    via = links.groupBy(child_key).agg(
        F.array_join(F.array_sort(F.collect_set(F.col(parent).cast("string"))), "; ").alias("_via"))
    own = F.when(F.col(parent).cast("string") != "", F.col(parent).cast("string"))
    return children.join(via, child_key, "left").select(
        *[c for c in children.columns if c != parent], F.coalesce(own, "_via", F.lit("")).alias(parent))


def interval_join(points: DataFrame, windows: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points inside ``[start, end]`` windows of the same group; numbers, dates and times.

    A dyadic index: a window of a length up to 2**L stands in the one or two cells of that width it touches, so a long window is no more rows
    than a short one. A point looks once into its cell of every width that some window has (fewer than 64). The join is an equi-join on
    group, width and cell, always a sort-merge join: the rows that both sides are exploded to are many more than their files let Spark expect,
    which would have it send one side through the driver. A window that ends before it starts, or has an open end, holds nothing.
    """
    lo, hi = (sort_key(F.col(c), windows.schema[c].dataType) for c in (start, end))
    length = F.try_subtract("_hi", "_lo")
    width = F.when(length.isNull(), 63).otherwise(F.ceil(F.log2(length.cast("double") + 1)).cast("int") + 1)  # one more, against rounding
    w = windows.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("_width", F.least(width, F.lit(63)))
    widths = sorted(r[0] for r in w.select("_width").distinct().collect())  # small numbers, at most 64
    cell = lambda c: F.call_function("shiftright", F.col(c), F.col("_width"))
    w = w.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("_lo"), cell("_hi"))))).drop("_lo", "_hi")
    p = (points.withColumn("_at", sort_key(F.col(at), points.schema[at].dataType)).where("_at IS NOT NULL")
         .withColumn("_width", F.explode(F.array(*[F.lit(x) for x in widths]).cast("array<int>"))).withColumn("_cell", cell("_at")).drop("_at"))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    return p.join(w.hint("merge"), [*by, "_width", "_cell"]).where(inside).drop("_width", "_cell")


def recall(seeds: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Each seed with whether the pool holds it."""
    hit = pool.select(key).distinct().withColumn("_hit", F.lit(True))
    return seeds.join(hit, key, "left").select(*seeds.columns, F.coalesce("_hit", F.lit(False)).alias("found"))


def reconcile_counts(expected: DataFrame, observed: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Expected against observed counts: difference in percent, and whether it is within tolerance."""
    j = expected.select(key, F.col("n").alias("expected")).join(observed.select(key, F.col("n").alias("observed")), key, "full_outer")
    j = j.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))
    pct = ratio(F.col("observed") - F.col("expected"), F.col("expected")) * 100
    return j.withColumn("diff_pct", pct).withColumn("within", F.coalesce(F.abs(F.col("diff_pct")) <= tolerance * 100, F.lit(False)))


def best_candidate(items: DataFrame, candidates: DataFrame, on: list[str], item_key: str, cand_key: str, text: str,
                   year: str, threshold: float, year_tol: int, metric: str = "levenshtein") -> DataFrame:
    """Best candidate per item among those that share ``on`` and the first word of the title, are within the year
    tolerance and reach the threshold; ties go to the lower candidate id.

    Similar titles come from the exact segment index over the distinct titles of both sides, so no item is
    compared with all candidates of its block. Of candidates with the same title, year and ``on`` only
    the lowest id can win, so copies are reduced before they are joined.
    """
    a = items.select(*on, item_key, F.col(year).alias("_ya"), F.col(text).alias("_t"), F.md5(text).alias("_a")).where("_t <> ''")
    b = candidates.select(*on, cand_key, F.col(year).alias("_yb"), F.col(text).alias("_t"), F.md5(text).alias("_b")).where("_t <> ''")
    heads = b.groupBy(*on, "_yb", "_b").agg(F.min(cand_key).alias(cand_key))
    titles = (a.select(F.col("_a").alias("title_id"), F.col("_t").alias("title"))
              .unionByName(b.select(F.col("_b").alias("title_id"), F.col("_t").alias("title"))).distinct()
              .withColumn("block", first_token(F.col("title"))))
    found = similar_titles(titles, metric, threshold).select("id_a", "id_b", "score")
    pairs = (found.toDF("_a", "_b", "score").unionByName(found.toDF("_b", "_a", "score").select("_a", "_b", "score"))
             .unionByName(titles.select(F.col("title_id").alias("_a"), F.col("title_id").alias("_b"), F.lit(1.0).alias("score"))))
    j = a.join(pairs, "_a").join(heads, [*on, "_b"]).where(F.abs(F.col("_ya") - F.col("_yb")) <= year_tol)
    return (j.groupBy(item_key).agg(F.max(F.struct("score", (-F.col(cand_key)).alias("neg"))).alias("m"))
            .select(item_key, (-F.col("m.neg")).alias(cand_key), F.col("m.score").alias("score")))


def verify_document(title: Column, doi: Column, text: Column, min_words: int = 3, min_len: int = 5,
                    min_chars: int = 500) -> Column:
    """Does a text belong to a title: DOI present, or enough distinctive title words, and long enough."""
    body = tx.normalize_title(text)
    ws = tx.distinctive_words(title, min_len)
    n = F.size(F.filter(ws, lambda w: F.contains(body, w)))
    need = F.least(F.lit(min_words), F.size(ws))
    by_doi = (doi != "") & F.contains(F.lower(text), doi)
    return first_verdict([(F.length(text) < min_chars, "too_short"), (by_doi, "doi"), ((need > 0) & (n >= need), "title_words")], "mismatch")


def spine_with_defaults(spine: DataFrame, results: DataFrame, key: str, valid: Column, defaults: dict[str, str],
                        omit: bool = False) -> DataFrame:
    """Every spine id with its valid result, or defaults where it is missing or invalid (or left out if ``omit``)."""
    r = results.where(valid).select(key, *defaults, F.lit(True).alias("_ok"))
    j = spine.select(key).join(r, key, "left")
    if omit:
        return j.where("_ok").select(key, *defaults, F.lit(False).alias("defaulted"))
    return j.select(key, *[F.when(F.col("_ok"), F.col(c)).otherwise(F.lit(d)).alias(c) for c, d in defaults.items()],
                    F.col("_ok").isNull().alias("defaulted"))


def identity_check(claims: DataFrame, registry: DataFrame, key: str, title: str, threshold: float = 0.8,
                   metric: str = "levenshtein") -> DataFrame:
    """Claimed title against the registry's title under the same id."""
    r = registry.select(key, F.col(title).alias("_rt"))
    j = claims.join(r, key, "left")
    a, b = tx.normalize_title(F.col(title)), tx.normalize_title(F.col("_rt"))
    s = sim.similarity(metric, a, b)
    verdict = first_verdict([(F.col(key).isNull() | (F.col(key) == ""), "no_id"), (F.col("_rt").isNull(), "lookup_failed"),
                             (s > threshold, "identity_match")], "title_review_needed")
    return j.select(*claims.columns, F.when(F.col("_rt").isNotNull(), s).alias("score"), verdict.alias("verdict"))
