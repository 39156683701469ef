"""Guarded sparse patches: typed updates and added rows, all or nothing per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import reachable

VALUE_SLOTS = ["value_text", "value_integer", "value_list"]


def fingerprint(cols: list[str]) -> Column:
    """Digest of the values of a row, in a fixed column order; identity and audit columns are left out by the caller."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}), 256)


def update_value() -> Column:
    """The one value an update carries, as text; NULL for ``set_null``."""
    return F.coalesce(F.col("value_text"), F.col("value_integer").cast("string"), F.array_join("value_list", "; "))


def update_errors(updates: DataFrame, base: DataFrame, record: str, row: str) -> DataFrame:
    """``(record, error)`` for updates that may not be applied.

    ``updates``: record, row, field, value_text, value_integer, value_list, set_null, supported.
    """
    known = base.select(row, F.col(record).alias("_owner"))
    j = updates.join(known, row, "left")
    slots = sum((F.col(s).isNotNull().cast("int") for s in VALUE_SLOTS), F.col("set_null").cast("int"))
    where = F.concat_ws("/", F.col(row).cast("string"), "field")
    msg = F.array_compact(F.array(
        F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col(record)), F.concat(F.lit("unknown row: "), F.col(row).cast("string"))),
        F.when(slots != 1, F.concat(F.lit("exactly one typed value required: "), where)),
        F.when(~F.col("supported"), F.concat(F.lit("quote not found: "), where))))
    twice = (updates.groupBy(record, row, "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(record, F.concat(F.lit("duplicate update: "), where).alias("error")))
    return j.select(record, F.explode(msg).alias("error")).unionByName(twice)


def addition_errors(adds: DataFrame, base: DataFrame, record: str, row: str, number: str, values: list[str]) -> DataFrame:
    """``(record, error)`` for added rows: taken id, id that does not continue, repeated values, no evidence.

    ``number`` is the running part of the row id; it must exceed the record's largest so far.
    """
    top = base.groupBy(record).agg(F.max(number).alias("_top"))
    fp = adds.withColumn("_fp", fingerprint(values))
    old = base.select(record, fingerprint(values).alias("_fp")).distinct().withColumn("_same", F.lit(True))
    taken = base.select(row).withColumn("_taken", F.lit(True))
    same_new = fp.groupBy(record, "_fp").agg(F.count(F.lit(1)).alias("_k"))
    j = (fp.join(top, record, "left").join(old, [record, "_fp"], "left").join(taken, row, "left").join(same_new, [record, "_fp"]))
    rid = F.col(row).cast("string")
    msg = F.array_compact(F.array(
        F.when(F.col("_taken"), F.concat(F.lit("duplicate row id: "), rid)),
        F.when(F.col(number) <= F.coalesce("_top", F.lit(0)), F.concat(F.lit("id does not continue: "), rid)),
        F.when(F.col("_same") | (F.col("_k") > 1), F.concat(F.lit("exact duplicate values: "), rid)),
        F.when(~F.col("supported"), F.concat(F.lit("no supported locator: "), rid))))
    return j.select(record, F.explode(msg).alias("error"))


def rejects(errors: list[DataFrame], record: str) -> DataFrame:
    """One row per rejected record with its distinct errors in order."""
    e = errors[0]
    for x in errors[1:]:
        e = e.unionByName(x)
    e = e.groupBy(record, "error").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy(record).agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"))


def apply_patch(base: DataFrame, updates: DataFrame, adds: DataFrame | None, rejected: DataFrame, record: str, row: str,
                fields: list[str]) -> DataFrame:
    """Apply the patches of every record that has no error. Rows never disappear.

    The updates of a row are few (one per field) and become one map; the base is joined once.
    """
    good = updates.join(rejected.select(record), record, "left_anti")
    per_row = good.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("field", update_value().alias("v")))).alias("_u"))
    j = base.join(per_row, row, "left")
    types = dict(base.dtypes)
    out = j.select(*[
        F.when(F.map_contains_key("_u", F.lit(c)), F.try_element_at("_u", F.lit(c)).cast(types[c])).otherwise(F.col(c)).alias(c)
        if c in fields else F.col(c) for c in base.columns])
    if adds is not None:
        out = out.unionByName(adds.join(rejected.select(record), record, "left_anti").select(*base.columns))
    return out


def isolate(ops: DataFrame, op_id: str, depends_on: str, bad_reason: str, dependent_reason: str) -> DataFrame:
    """Keep supported operations; set aside unsupported ones and those that depend on them, with a reason."""
    bad = ops.where(~F.col("supported")).select(F.col(op_id).alias(depends_on), F.lit(True).alias("_dep"))
    j = ops.join(bad, depends_on, "left")
    reason = F.when(~F.col("supported"), bad_reason).when(F.col("_dep"), dependent_reason).otherwise("")
    return j.select(*ops.columns, reason.alias("isolated"))


def isolate_unsupported(ops: DataFrame, depends: DataFrame, op: str, kind: str, reasons: dict[str, str], dependent_reason: str) -> DataFrame:
    """``ops`` (with ``supported``) plus ``isolated`` and ``hops``: an unsupported operation is set aside with the reason of its kind, and
    everything that depends on one, over any number of steps, with ``dependent_reason``; ``isolated`` is '' for what may be applied.

    ``depends``: ``(op, depends_on)``, any number of rows for an operation. An operation that is unsupported itself keeps that reason.
    ``hops`` is the least number of dependencies to an unsupported operation.
    """
    bad = ops.where(~F.coalesce(F.col("supported"), F.lit(False))).select(F.col(op).alias("node"))
    lost = reachable(depends, bad, src="depends_on", dst=op)
    own = None
    for name, reason in reasons.items():
        own = F.when(F.col(kind) == name, reason) if own is None else own.when(F.col(kind) == name, reason)
    j = ops.join(lost.withColumnRenamed("node", op), op, "left")
    reason = F.when(F.col("hops").isNull(), "").when(F.col("hops") == 0, F.coalesce(own, F.lit("unsupported"))).otherwise(dependent_reason)
    return j.select(*ops.columns, reason.alias("isolated"), "hops")


def partial_records(isolated: DataFrame, record: str, op: str, kind: str) -> DataFrame:
    """One row for every record with an operation set aside: how many were, what still is applied, the mark ``partial`` and what a person
    has to look at, one line an operation."""
    line = F.concat(F.lit("Manual review required: "), F.col(kind), F.lit(" "), F.col(op).cast("string"), F.lit(" ("), F.col("isolated"), F.lit(")."))
    gone = F.col("isolated") != ""
    return (isolated.groupBy(record).agg(F.count_if(gone).alias("n_isolated"), F.count_if(~gone).alias("n_applied"),
                                         F.array_sort(F.collect_list(F.when(gone, line))).alias("remaining"))
            .where("n_isolated > 0").select(record, "n_isolated", "n_applied", F.lit("partial").alias("completion"), "remaining"))


def replacement_guard(old: DataFrame, new: DataFrame, parent: str, row: str, link_ok: Column) -> DataFrame:
    """May a replacement set of rows stand in for the old one: no lost ids, not fewer rows, links valid."""
    o = old.select(parent, row, F.lit(True).alias("_o"))
    n = new.select(parent, row, F.lit(True).alias("_n"), link_ok.alias("_ok"))
    j = o.join(n, [parent, row], "full_outer")
    g = j.groupBy(parent).agg(F.count_if(F.col("_n").isNull()).alias("lost"), F.count("_o").alias("rows_old"),
                              F.count("_n").alias("rows_new"), F.count_if(~F.col("_ok")).alias("bad_links"))
    return g.withColumn("reason", F.when(F.col("lost") > 0, "missing_existing_ids").when(F.col("rows_new") < F.col("rows_old"), "fewer_rows")
                        .when(F.col("bad_links") > 0, "invalid_linkage").otherwise(""))


# --- guarded load ---------------------------------------------------------------------------------

def load_actions(current: DataFrame, incoming: DataFrame, key: str, known: list[str], locked: list[str], refused: list[str],
                 vocab: dict[str, list[str]] | None = None) -> DataFrame:
    """What happens to every incoming cell: ``(key, field, old, new, action)``.

    Actions: write, write_out_of_vocabulary, locked_kept, locked_mismatch, refused, unknown_field, blank.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in known])
    old = current.select(key, F.explode(cells).alias("c")).select(key, "c.field", F.col("c.value").alias("old"))
    fields = [c for c in incoming.columns if c != key]
    inc = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    new = incoming.select(key, F.explode(inc).alias("c")).select(key, "c.field", F.col("c.value").alias("new"))
    j = new.join(old, [key, "field"], "left")
    f, o, n = F.col("field"), F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    outside = F.lit(False)
    for name, allowed in (vocab or {}).items():
        parts = F.filter(F.transform(F.split(n, ";"), F.trim), lambda x: x != "")
        outside = outside | ((f == name) & (F.size(F.array_except(parts, F.array(*[F.lit(v) for v in allowed]))) > 0))
    action = (F.when(~f.isin(known), "unknown_field").when(n == "", "blank").when(f.isin(refused), "refused")
              .when(f.isin(locked) & (o != "") & (o != n), "locked_mismatch").when(f.isin(locked), "locked_kept")
              .when(outside, "write_out_of_vocabulary").otherwise("write"))
    return j.select(key, "field", "old", "new", action.alias("action"))


def apply_load(current: DataFrame, actions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Write the cells whose action is a write."""
    w = actions.where(F.col("action").startswith("write") & F.col("field").isin(fields))
    per = w.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "new"))).alias("_w"))
    j = current.join(per, key, "left")
    types = dict(current.dtypes)
    return j.select(*[F.coalesce(F.try_element_at("_w", F.lit(c)).cast(types[c]), F.col(c)).alias(c) if c in fields else F.col(c)
                      for c in current.columns])


def overwrite_guard(proposed: DataFrame, audit: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A filled cell may change only if it still holds the last value a machine recorded for it.

    ``proposed``: keys, current, new. ``audit``: keys, value and order columns.
    """
    last = audit.groupBy(*keys).agg(F.max_by("value", F.struct(*order)).alias("recorded"))
    j = proposed.join(last, keys, "left")
    free = F.col("current").isNull() | (F.col("current") == "")
    return j.withColumn("allowed", free | F.coalesce(F.col("recorded") == F.col("current"), F.lit(False)))
