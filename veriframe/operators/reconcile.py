"""Merging independent raters: pairing, consensus policies, overrides, layers and review scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_verdict, recode
from .validate import assert_empty, duplicate_keys


def pair_raters(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer pairing. Columns other than the key get ``_a`` / ``_b``; ``raters`` says who answered."""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(key, F.lit(True).alias(f"has_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != key])
    j = side(a, "a").join(side(b, "b"), key, "full_outer")
    who = F.when(F.col("has_a") & F.col("has_b"), "both").when(F.col("has_a"), "a").otherwise("b")
    return j.withColumn("raters", who).drop("has_a", "has_b")


def pair_raters_strict(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner pairing that fails on a repeated id or on ids only one rater has."""
    assert_empty(duplicate_keys(a, [key], "a"), "repeated id, rater a")
    assert_empty(duplicate_keys(b, [key], "b"), "repeated id, rater b")
    assert_empty(a.join(b, key, "left_anti").select(key), "ids only in a")
    assert_empty(b.join(a, key, "left_anti").select(key), "ids only in b")
    return pair_raters(a, b, key).drop("raters")


def id_set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, in one pass over both: ``(key, side)``."""
    both = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s")))
    g = both.groupBy(key).agg(F.bit_or("s").alias("s"))
    return g.where("s <> 3").select(key, F.when(F.col("s") == 1, "only_a").otherwise("only_b").alias("side"))


# --- consensus policies: (decision a, decision b) to a final decision -----------------------------

def advance_wins(da: Column, db: Column, ca: Column, cb: Column, advance: str, exclude: str, fallback: str,
                 codes: list[str]) -> tuple[Column, Column]:
    """Final decision and code. Both exclude: excluded with the earlier code of the list; any advance
    wins; anything else falls back. NULL while a decision is missing."""
    both = da.isNotNull() & db.isNotNull()
    out_ex = (da == exclude) & (db == exclude)
    final = F.when(both & out_ex, exclude).when(both & ((da == advance) | (db == advance)), advance).when(both, fallback)
    order = F.array(*[F.lit(x) for x in codes])
    pos = [F.nullif(F.array_position(order, c), F.lit(0).cast("bigint")) for c in (ca, cb)]
    best = F.try_element_at(order, F.least(*pos).cast("int"))
    return final, F.when(both & out_ex, best)


def strict_agreement(da: Column, db: Column) -> Column:
    return F.when(da == db, da)


def labelled_disagreement(da: Column, db: Column, label: str = "DISAGREE") -> Column:
    """Shared value, ``label`` where the raters differ, the only value where one rater answered."""
    return F.when(da.isNull(), db).when(db.isNull(), da).when(da == db, da).otherwise(label)


def tiered(da: Column, db: Column, order: list[str]) -> Column:
    """The first tier of ``order`` that either rater gave; a single rater's value passes through."""
    given = F.array(da, db)
    both = da.isNotNull() & db.isNotNull()
    return F.when(~both, F.coalesce(da, db)).otherwise(
        first_verdict([(F.array_contains(given, t), t) for t in order[:-1]], order[-1]))


def dual_merge(paired: DataFrame, group_map: dict[str, str], coded: list[str], resolved: DataFrame | None = None,
               key: str = "id") -> DataFrame:
    """Exact, group and code agreement, conflict flag, final decision and where it came from.

    ``paired`` has ``decision_a, decision_b, code_a, code_b``; codes are compared where both decisions
    are in ``coded``. ``resolved`` (key, final, final_code) overrides.
    """
    da, db, ca, cb = (F.col(x) for x in ("decision_a", "decision_b", "code_a", "code_b"))
    both = da.isNotNull() & db.isNotNull()
    df = paired
    if resolved is not None:
        df = df.join(resolved.select(key, F.col("final").alias("_rf"), F.col("final_code").alias("_rc")), key, "left")
    else:
        df = df.withColumn("_rf", F.lit(None).cast("string")).withColumn("_rc", F.lit(None).cast("string"))
    ga, gb = recode(da, group_map, None), recode(db, group_map, None)
    exact = F.when(both, (da == db).cast("int"))
    code_agree = F.when(both & da.isin(coded) & db.isin(coded), ca.eqNullSafe(cb).cast("int"))
    df = df.select("*", both.alias("both_decided"), exact.alias("exact_agree"), ga.alias("group_a"), gb.alias("group_b"),
                   F.when(both, (ga == gb).cast("int")).alias("group_agree"), code_agree.alias("code_agree"))
    df = df.withColumn("conflict", F.coalesce((F.col("exact_agree") == 0) | (F.col("code_agree") == 0),
                                              F.col("exact_agree") == 0, F.lit(False)))
    settled = F.col("both_decided") & ~F.col("conflict")
    return df.select(
        *[c for c in df.columns if c not in ("_rf", "_rc")],
        F.coalesce("_rf", F.when(settled, da)).alias("final"),
        F.when(F.col("_rf").isNotNull(), F.col("_rc")).when(settled & da.isin(coded), ca).alias("final_code"),
        first_verdict([(F.col("_rf").isNotNull(), "reconciled"), (settled, "agreement"),
                       (F.col("both_decided"), "unresolved_conflict"),
                       (da.isNotNull() | db.isNotNull(), "awaiting_second_decision")], "not_decided").alias("final_source"))


def third_read(df: DataFrame, reads: DataFrame, key: str) -> DataFrame:
    """A third read overrides the merged decision on conflicts only. Adds ``final, final_code, third``."""
    r = reads.select(key, F.col("decision").alias("_d"), F.col("code").alias("_c"))
    j = df.join(r, key, "left")
    use = F.col("conflict") & F.col("_d").isNotNull()
    return j.select(*df.columns, F.when(use, F.col("_d")).otherwise(F.col("merged")).alias("final"),
                    F.when(use, F.col("_c")).otherwise(F.col("merged_code")).alias("final_code"),
                    F.when(F.col("conflict"), F.col("_d")).alias("third"))


def overturn(df: DataFrame, cond: Column, final: str, note: str, final_col: str = "final", code_col: str = "final_code",
             note_col: str = "note") -> DataFrame:
    """Safeguard: where ``cond`` holds, replace the decision, clear the code and append to the note."""
    hit = F.coalesce(cond, F.lit(False))
    return df.withColumns({
        note_col: F.when(hit, F.concat_ws(" | ", F.when(F.col(note_col) != "", F.col(note_col)), F.lit(note))).otherwise(F.col(note_col)),
        code_col: F.when(hit, F.lit("")).otherwise(F.col(code_col)),
        final_col: F.when(hit, F.lit(final)).otherwise(F.col(final_col))})


# --- layers ---------------------------------------------------------------------------------------

def two_model_layer(flags_a: dict[str, Column], flags_b: dict[str, Column], key_a: Column, key_b: Column) -> Column:
    """D when the raters differ on the key element or any flag, or leave it unclear; X when the same
    element is absent for both; then V or M by the key element."""
    differ = (key_a == "unclear") | (key_b == "unclear") | ~key_a.eqNullSafe(key_b)
    absent = F.lit(False)
    for k, a in flags_a.items():
        differ = differ | (a != flags_b[k])
        absent = absent | (a & flags_b[k])
    return first_verdict([(differ, "D"), (absent, "X"), (key_a == "present", "V")], "M")


def final_layer(flags: list[Column], key: Column, known: Column) -> Column:
    """X when any core element is absent, V/M by the key element, U when unknown or unclear."""
    any_absent = F.lit(False)
    for f in flags:
        any_absent = any_absent | f
    return first_verdict([(~known, "U"), (any_absent, "X"), (key == "present", "V"), (key == "absent", "M")], "U")


def human_layer(key: Column, core_absent: Column) -> Column:
    """Layer from a person's answers; an answer other than present/absent is U."""
    k, a = F.lower(F.trim(F.coalesce(key, F.lit("")))), F.trim(F.coalesce(core_absent, F.lit("")))
    return first_verdict([(~k.isin("present", "absent"), "U"), (~a.isin("", "none"), "X"), (k == "present", "V")], "M")


def pick_adjudicated(first_pass: DataFrame, adjudicated: DataFrame, key: str, value: str) -> DataFrame:
    """The adjudicated value where there is one, else the first pass; ``source`` says which."""
    adj = adjudicated.select(key, F.col(value).alias("_adj"), F.lit(True).alias("_has"))
    j = first_pass.join(adj, key, "left")
    return j.select(*[c for c in first_pass.columns if c != value],
                    F.when(F.col("_has"), F.col("_adj")).otherwise(F.col(value)).alias(value),
                    F.when(F.col("_has"), "adjudicated").otherwise("first_pass").alias("source"))


def review_scope(df: DataFrame, sample: DataFrame, key: str, cases) -> DataFrame:
    """Ordered scope rules; ``cases(in_sample)`` returns ``[(condition, scope)]`` and the default."""
    j = df.join(sample.select(key, F.lit(True).alias("_in")), key, "left")
    rules, default = cases(F.coalesce(F.col("_in"), F.lit(False)))
    return j.withColumn("scope", first_verdict(rules, default)).drop("_in")


# --- full-text stage ------------------------------------------------------------------------------

def decision_key(disposition: Column, code: Column, exclude: str) -> Column:
    """A decision is its disposition, with the code where it excludes."""
    return F.when(disposition == exclude, F.concat_ws("|", disposition, F.coalesce(code, F.lit("")))).otherwise(disposition)


def check_resolutions(res: DataFrame, merged: DataFrame, key: str, dispositions: list[str], codes: list[str],
                      exclude: str) -> DataFrame:
    """Adjudicator resolutions that break a rule, with the reason; empty means all are usable."""
    code = F.coalesce(F.col("final_code"), F.lit(""))
    many = res.groupBy(key).agg(F.count_distinct(F.struct("final", code.alias("code"))).alias("_n"))
    j = res.join(many, key).join(merged.select(key, F.col("conflict").alias("_conflict"), F.lit(True).alias("_known")), key, "left")
    reason = first_verdict([
        (F.col("_known").isNull(), "unknown record"), (~F.col("final").isin(dispositions), "unknown disposition"),
        ((F.col("final") == exclude) != (code != ""), "code and disposition disagree"),
        ((code != "") & ~code.isin(codes), "unknown code"), (F.col("_n") > 1, "conflicting resolutions"),
        (~F.col("_conflict"), "not a conflict")], "")
    return j.select(key, "final", "final_code", reason.alias("reason")).where("reason <> ''")


def staged_merge(paired: DataFrame, resolved: DataFrame, key: str, exclude: str, problems_a: Column, problems_b: Column,
                 ) -> DataFrame:
    """Full-text merge: a rule problem on either side blocks agreement; a resolution settles a conflict."""
    da, db = F.col("decision_a"), F.col("decision_b")
    ka, kb = decision_key(da, F.col("code_a"), exclude), decision_key(db, F.col("code_b"), exclude)
    complete = da.isNotNull() & db.isNotNull()
    df = paired.select("*", complete.alias("complete"), F.coalesce(ka == kb, F.lit(False)).alias("same"),
                       problems_a.alias("problems_a"), problems_b.alias("problems_b"))
    # Problems are only looked for where both raters have decided.
    flawed = F.col("complete") & ((F.size("problems_a") > 0) | (F.size("problems_b") > 0))
    df = df.withColumn("conflict", F.col("complete") & (~F.col("same") | flawed))
    r = resolved.select(key, F.col("final").alias("_rf"), F.col("final_code").alias("_rc"))
    j = df.join(r, key, "left")
    agreed = F.col("same") & ~flawed
    return j.select(
        *df.columns, F.coalesce("_rf", F.when(agreed, da)).alias("final"),
        F.when(F.col("_rf").isNotNull(), F.col("_rc")).when(agreed & (da == exclude), F.col("code_a")).alias("final_code"),
        first_verdict([(F.col("_rf").isNotNull(), "adjudicated"), (agreed, "agreed")], "").alias("final_source"))


def conflict_list(merged: DataFrame, key: str, blind: list[str], done: DataFrame | None = None) -> DataFrame:
    """Open conflicts for adjudication: only the blind columns, without ids already handled."""
    out = merged.where("conflict")
    if done is not None:
        out = out.join(done.select(key), key, "left_anti")
    return out.select(key, *blind)


def conflict_type(da: Column, db: Column, ca: Column, cb: Column, include: list[str], exclude: str) -> Column:
    return first_verdict([
        (da.isin(include) & db.isin(include) & (da != db), "which_inclusion"),
        ((da == exclude) & (db == exclude) & ~ca.eqNullSafe(cb), "which_code"),
        ((da.isin(include) & (db == exclude)) | (db.isin(include) & (da == exclude)), "include_vs_exclude"),
        (da != db, "other_status")], "none")


def scope_audit(items: DataFrame, scope: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Accept an item only if it is in scope and agrees with the scope table; otherwise hold it with a reason."""
    s = scope.select(key, F.lit(True).alias("_in"), *[F.col(c).alias(f"_s_{c}") for c in same])
    j = items.join(s, key, "left")
    bad = [(F.col("_in").isNull(), "not in scope")]
    bad += [(~F.col(c).eqNullSafe(F.col(f"_s_{c}")), f"{c} differs") for c in same]
    return j.select(*items.columns, first_verdict(bad, "").alias("held")).withColumn(
        "status", F.when(F.col("held") == "", "accepted").otherwise("held"))


# --- funnel ---------------------------------------------------------------------------------------

def stage_metrics(df: DataFrame, section: str, final: str, items: dict[str, Column]) -> DataFrame:
    """Counts of one stage as ``(section, item, value, status, note)``.

    A value is shown only when every row of the stage has a final decision; otherwise it is NULL, not 0.
    """
    open_ = F.col(final).isNull() | (F.col(final) == "")
    wide = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(open_).alias("_open"),
                  *[F.count_if(cond).alias(name) for name, cond in items.items()])
    long = wide.unpivot(["_n", "_open"], list(items), "item", "count")
    status = first_verdict([(F.col("_n") == 0, "NOT_YET_PERFORMED"), (F.col("_open") > 0, "INCOMPLETE")], "COMPLETE")
    return long.select(F.lit(section).alias("section"), "item",
                       F.when(status == "COMPLETE", F.col("count")).alias("value"), status.alias("status"),
                       F.when(F.col("_open") > 0, F.format_string("%d of %d records without a final decision", "_open", "_n"))
                       .otherwise("").alias("note"))


def stage_check(metrics: DataFrame, name: str, upstream: tuple[str, str], downstream: tuple[str, str]) -> DataFrame:
    """A CHECK row when two complete stages disagree on the count they share."""
    def one(at: tuple[str, str]) -> Column:
        return F.max(F.when((F.col("section") == at[0]) & (F.col("item") == at[1]) & (F.col("status") == "COMPLETE"), F.col("value")))
    j = metrics.agg(one(upstream).alias("up"), one(downstream).alias("down"))
    return j.where("up <> down").select(
        F.lit("checks").alias("section"), F.lit(name).alias("item"), F.lit(None).cast("bigint").alias("value"),
        F.lit("CHECK").alias("status"), F.format_string("%d upstream but %d downstream", "up", "down").alias("note"))


