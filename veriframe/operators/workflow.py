"""Enrichment, recodes, queues and work selection between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.rules import first_verdict
from .ordered import latest


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def fill_blank(rows: DataFrame, target: str, source: str, id_col: str, alt_id: str, by_id: DataFrame, id_map: DataFrame) -> DataFrame:
    """Fill only blank targets: by id, else through a map from the alternative id, which also backfills the id.

    ``by_id``: id, value. ``id_map``: alt, id. Adds ``route`` (how it was filled) and ``reason`` (why not).
    Only the rows that need a lookup are joined, and rows with a blank key never travel.
    """
    have = rows.where(~_blank(target)).select("*", F.lit("already_filled").alias("route"), F.lit("").alias("reason"))
    todo = rows.where(_blank(target))
    v = by_id.select(F.col("id").alias("_id"), F.col("value").alias("_v"))
    m = id_map.select(F.col("alt").alias("_alt"), F.col("id").alias("_mid"))
    has_id = todo.where(~_blank(id_col)).withColumn("_key", F.col(id_col)).withColumn("_by", F.lit("id"))
    has_alt = (todo.where(_blank(id_col) & ~_blank(alt_id)).join(m, F.col(alt_id) == F.col("_alt"), "left")
               .withColumn("_key", F.col("_mid")).withColumn("_by", F.lit("alt")).drop("_alt", "_mid"))
    none = todo.where(_blank(id_col) & _blank(alt_id)).select("*", F.lit("").alias("route"), F.lit("no_identifier").alias("reason"))
    j = has_id.unionByName(has_alt).join(v, F.col("_key") == F.col("_id"), "left")
    hit = F.col("_v").isNotNull()
    filled = j.withColumns({
        "route": F.when(hit, F.concat(F.lit("filled_by_"), F.col("_by"))).otherwise(""),
        "reason": F.when(hit, "").when(F.col("_by") == "id", "id_without_value").when(F.col("_key").isNotNull(), "mapped_id_without_value")
        .otherwise("alternative_id_not_mapped"),
        source: F.when(hit & _blank(source), F.concat(F.lit("lookup by "), F.col("_by"))).otherwise(F.col(source)),
        target: F.coalesce("_v", F.col(target)),
        id_col: F.when(hit & _blank(id_col), F.col("_key")).otherwise(F.col(id_col))})
    cols = [*rows.columns, "route", "reason"]
    return have.select(*cols).unionByName(filled.select(*cols)).unionByName(none.select(*cols))


def backfill_ids(rows: DataFrame, found: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Fill blank identifiers from a completion table; ``n_changed`` counts the cells filled per row."""
    f = found.select(key, *[F.col(i).alias(f"_f_{i}") for i in ids])
    j = rows.join(f, key, "left")
    new = {i: F.when(_blank(i) & (F.coalesce(F.col(f"_f_{i}"), F.lit("")) != ""), F.col(f"_f_{i}")).otherwise(F.col(i)) for i in ids}
    changed = sum(((_blank(i) & (F.coalesce(F.col(f"_f_{i}"), F.lit("")) != "")).cast("int") for i in ids), F.lit(0))
    return j.select(*[new[c].alias(c) if c in ids else F.col(c) for c in rows.columns], changed.alias("n_changed"))


def recode_by_table(rows: DataFrame, decisions: DataFrame, key: str, field: str, in_scope: Column) -> tuple[DataFrame, DataFrame]:
    """Apply a decision table that must cover the rows in scope exactly.

    Returns the audit rows ``(key, old, new, branch)`` and the coverage gaps ``(key, gap)``.
    """
    scope = rows.where(in_scope).select(key, F.col(field).alias("old"))
    d = decisions.select(key, "new", "branch", F.lit(True).alias("_d"))
    j = scope.withColumn("_s", F.lit(True)).join(d, key, "full_outer")
    gaps = j.where(F.col("_s").isNull() | F.col("_d").isNull()).select(key, F.when(F.col("_d").isNull(), "no decision").otherwise("not in scope").alias("gap"))
    audit = j.where(F.col("_s") & F.col("_d")).select(key, "old", "new", "branch")
    return audit, gaps


def queue_status(queue: DataFrame, log: DataFrame, key: str, order: list[str], outcome: str, statuses: dict[str, str],
                 default: str = "pending") -> DataFrame:
    """Status of every queue item from its latest log entry."""
    last = latest(log.select(key, *order, outcome), [key], order).select(key, F.col(outcome).alias("_o"))
    j = queue.join(last, key, "left")
    return j.select(*queue.columns, first_verdict([(F.col("_o") == k, v) for k, v in statuses.items()], default).alias("status"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Base rows with the latest change per key put in their place, and new keys added."""
    last = latest(changes, keys, order).select(*base.columns)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def intake(arrivals: DataFrame, scope: DataFrame, held: DataFrame, item: str, digest: str) -> DataFrame:
    """Accept or reject arrivals: not in scope, already held, or the same bytes under another id."""
    s = scope.select(item).distinct().withColumn("_s", F.lit(True))
    h = held.select(item).distinct().withColumn("_h", F.lit(True))
    # Who has these bytes first: a held item before an arriving one, then the lower id.
    all_ = (held.select(item, digest, F.lit(0).alias("_new")).unionByName(arrivals.select(item, digest, F.lit(1).alias("_new"))))
    owner = all_.groupBy(digest).agg(F.min_by(item, F.struct("_new", item)).alias("_o"))
    j = arrivals.join(s, item, "left").join(h, item, "left").join(owner, digest)
    return j.select(*arrivals.columns, first_verdict([
        (F.col("_s").isNull(), "not_in_scope"), (F.col("_h"), "already_held"), (F.col("_o") != F.col(item), "same_bytes_other_id")],
        "accepted").alias("verdict"))


def open_work(items: DataFrame, done: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Items without a valid result; ``has_input`` reports the ones that cannot start yet."""
    i = inputs.select(key).distinct().withColumn("_i", F.lit(True))
    return (items.join(done.select(key), key, "left_anti").join(i, key, "left")
            .select(*items.columns, F.coalesce("_i", F.lit(False)).alias("has_input")))


def override_kind(prefill: Column, current: Column, free_text: bool, least: float = 0.7) -> Column:
    """``agree`` or ``override``: exact for codes, token overlap for free text; ``blank`` without a current value."""
    p, c = F.coalesce(prefill, F.lit("")), F.coalesce(current, F.lit(""))
    if free_text:
        same = F.coalesce(sim.token_jaccard(F.array_distinct(tx.words(p)), F.array_distinct(tx.words(c))), F.lit(0.0)) >= least
    else:
        same = p == c
    return first_verdict([(c == "", "blank"), (same, "agree")], "override")


def append_scope(new_scope: DataFrame, completion: DataFrame, ledger: DataFrame, key: str, ids: list[str], status: str = "pending") -> DataFrame:
    """Manifest rows for ids newly in scope: identifiers completed, ids already in the ledger left out."""
    f = completion.select(key, *[F.col(i).alias(f"_f_{i}") for i in ids])
    fresh = new_scope.join(ledger.select(key), key, "left_anti").join(f, key, "left")
    return fresh.select(*[tx.first_filled(F.col(c), F.col(f"_f_{c}")).alias(c) if c in ids else F.col(c) for c in new_scope.columns],
                        F.lit(status).alias("status"))


def map_layer(base: DataFrame, later: DataFrame, order: list[str], human: DataFrame, key: str, layer: str, keep: str) -> DataFrame:
    """Rows of one layer after later decisions have superseded first ones and people have overridden both."""
    s = latest(later, [key], order).select(key, F.col(layer).alias("_s"))
    h = human.select(key, F.col(layer).alias("_h"))
    j = base.join(s, key, "left").join(h, key, "left")
    out = j.select(*[c for c in base.columns if c != layer], F.coalesce("_h", "_s", layer).alias(layer),
                   F.when(F.col("_h").isNotNull(), "human").when(F.col("_s").isNotNull(), "superseded").otherwise("first_pass").alias("provenance"))
    return out.where(F.col(layer) == keep)


def paired_quality(old: DataFrame, new: DataFrame, parent: str, by: list[str], value: str) -> DataFrame:
    """Rows and share of blank values per group in two versions, over the parents both versions have."""
    rows = old.select(parent, *by, value, F.lit(True).alias("_old")).unionByName(new.select(parent, *by, value, F.lit(False).alias("_old")))
    is_old, blank = F.col("_old"), F.col(value).isNull()
    # A parent is one row a group before it is asked which versions have it, so nothing is joined.
    per = rows.where(F.col(parent).isNotNull()).groupBy(parent, *by).agg(
        F.count_if(is_old).alias("_n_old"), F.count_if(is_old & blank).alias("_b_old"), F.count_if(~is_old).alias("_n_new"), F.count_if(~is_old & blank).alias("_b_new"))
    mine = W.partitionBy(parent)
    shared = per.withColumns({"_o": F.sum("_n_old").over(mine), "_n": F.sum("_n_new").over(mine)}).where("_o > 0 AND _n > 0")
    pct = lambda v: F.try_divide(F.sum(f"_b_{v}") * 100.0, F.sum(f"_n_{v}"))
    return shared.groupBy(*by).agg(F.sum("_n_new").alias("n_rows"), pct("old").alias("pct_blank_old"), pct("new").alias("pct_blank_new"))
