"""Aggregation, window and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as ru
from ..operators import json_totals as jt
from ..operators import ledger as lg
from ..operators import ordered as od
from ..operators import ranges as rg
from ..operators import tables as tb
from .registry import query
from .text import FAMILY_RULES, FAMILY_SQL

c = F.col
FAMILIES = ["fastener", "ring", "flat", "bar", "other"]


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE event_type END AS kind, count(*) AS n, count(*) FILTER (WHERE value > 50) AS with_big FROM events GROUP BY 1""")
def grouped_counts(t):
    e = t.events.select(F.when(c("event_type") == "error", "").otherwise(c("event_type")).alias("kind"), F.when(c("value") > 50, c("value")).alias("big"))
    return tb.grouped_counts(e, {"kind": "UNKNOWN"}, ["big"])


@query("""
WITH v AS (SELECT p_partkey, unnest(list_distinct(list_filter(string_split(replace(p_name, ' ', ';') || ';' || CASE WHEN p_size > 25 THEN p_type ELSE '' END, ';'), lambda x: x <> ''))) AS value FROM part)
SELECT value, count(*) AS n FROM v GROUP BY 1""")
def multi_value_counts(t):
    cell = F.concat_ws(";", F.replace(c("p_name"), F.lit(" "), F.lit(";")), F.when(c("p_size") > 25, c("p_type")).otherwise(""))
    return tb.multi_value_counts(t.part, cell)


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1, 2""")
def two_unit_counts(t):
    return tb.two_unit_counts(t.lineitem, ["l_returnflag", "l_linestatus"], {"n_orders": "l_orderkey", "n_suppliers": "l_suppkey"})


@query(f"""
WITH r AS (SELECT {FAMILY_SQL.format('p_name')} AS family, p_type, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey),
x AS (SELECT family, p_type, l_suppkey FROM r UNION ALL SELECT CASE WHEN family IN ('fastener', 'ring') THEN 'ALL_ROUND' ELSE 'ALL_LONG' END, p_type, l_suppkey FROM r UNION ALL SELECT 'ALL', p_type, l_suppkey FROM r),
s AS (SELECT unnest(['fastener', 'ring', 'flat', 'bar', 'other', 'never', 'ALL_ROUND', 'ALL_LONG', 'ALL']) AS family)
SELECT s.family, count(DISTINCT l_suppkey) FILTER (WHERE p_type = 'PROMO') AS "PROMO", count(DISTINCT l_suppkey) FILTER (WHERE p_type = 'SMALL') AS "SMALL", count(DISTINCT l_suppkey) FILTER (WHERE p_type = 'ABSENT') AS "ABSENT"
FROM s LEFT JOIN x USING (family) GROUP BY 1""")
def coverage_matrix(t):
    part = t.part.select(c("p_partkey").alias("l_partkey"), ru.classify(c("p_name"), FAMILY_RULES).alias("family"), "p_type")
    r = t.lineitem.select("l_partkey", "l_suppkey").join(part, "l_partkey")
    sub = F.when(c("family").isin("fastener", "ring"), "ALL_ROUND").otherwise("ALL_LONG")
    return tb.coverage_matrix(r, "family", "p_type", [*FAMILIES, "never", "ALL_ROUND", "ALL_LONG", "ALL"], ["PROMO", "SMALL", "ABSENT"], "l_suppkey", sub)


@query("""
WITH s AS (SELECT a AS status, b AS urgent FROM (SELECT unnest(['O', 'F', 'P', 'X']) AS a), (SELECT unnest(['yes', 'no']) AS b)),
o AS (SELECT o_orderstatus AS status, CASE WHEN o_orderpriority < '3' THEN 'yes' ELSE 'no' END AS urgent, o_custkey, o_totalprice FROM orders)
SELECT s.status, s.urgent, count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 400000) AS n_large FROM s LEFT JOIN o USING (status, urgent) GROUP BY 1, 2""")
def strata_table(t):
    o = t.orders.select(c("o_orderstatus").alias("status"), F.when(c("o_orderpriority") < "3", "yes").otherwise("no").alias("urgent"), "o_custkey", "o_totalprice")
    return tb.strata_table(o, {"status": ["O", "F", "P", "X"], "urgent": ["yes", "no"]}, "o_custkey", {"n_large": c("o_totalprice") > 400000})


@query(f"""
WITH p AS (SELECT {FAMILY_SQL.format('p_name')} AS family, p_type, p_brand, p_name FROM part)
SELECT family, p_type, count(*) AS n_rows, count(DISTINCT p_name) AS n_variants, array_to_string(list_sort(list_distinct(list(p_name))), ';') AS variants, count(DISTINCT p_brand) AS n_units FROM p GROUP BY 1, 2""")
def top_inventory(t):
    p = t.part.select(ru.classify(c("p_name"), FAMILY_RULES).alias("family"), "p_type", "p_brand", "p_name")
    return tb.inventory(p, ["family", "p_type"], "p_brand", "p_name")


@query("""
WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT user_id, arg_min(props, (ts, event_id)) AS example FROM events GROUP BY 1)
SELECT user_id, string_agg(event_type || '(' || n || ')', ';' ORDER BY event_type) AS tally, sum(n)::BIGINT AS n_rows, any_value(example) AS example FROM k JOIN e USING (user_id) GROUP BY 1""")
def type_tally(t):
    return tb.type_tally(t.events, "user_id", "event_type", c("props"), ["ts", "event_id"])


@query(f"""
WITH a AS (SELECT p_partkey, {FAMILY_SQL.format('p_name')} AS f FROM part), b AS (SELECT DISTINCT l_orderkey, f FROM lineitem JOIN a ON p_partkey = l_partkey WHERE l_quantity > 40),
l AS (SELECT unnest(['fastener', 'ring', 'flat', 'bar', 'other', 'NR']) AS family), da AS (SELECT count(*) AS d FROM part), db AS (SELECT count(DISTINCT l_orderkey) AS d FROM b)
SELECT family, (SELECT count(*) FROM a WHERE f = family) AS parts, round(100 * (SELECT count(*) FROM a WHERE f = family) / (SELECT d FROM da), 1) AS parts_pct,
  (SELECT count(*) FROM b WHERE f = family) AS large_orders, round(100 * (SELECT count(*) FROM b WHERE f = family) / (SELECT d FROM db), 1) AS large_orders_pct FROM l
UNION ALL SELECT 'DENOMINATOR', (SELECT d FROM da), NULL, (SELECT d FROM db), NULL""")
def share_table(t):
    part = t.part.select(c("p_partkey").alias("l_partkey"), ru.classify(c("p_name"), FAMILY_RULES).alias("f"))
    big = t.lineitem.where("l_quantity > 40").select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy("l_orderkey").agg(F.collect_set("f").alias("fs"))
    return tb.share_table(t.spark, "family", [*FAMILIES, "NR"], {"parts": (part, F.array("f")), "large_orders": (big, c("fs"))})


@query("""
WITH p AS (SELECT p_type, CASE WHEN p_size < 5 THEN 'NR' WHEN p_size > 45 THEN 'UNCLEAR' ELSE CAST(p_size AS VARCHAR) END AS size, p_brand FROM part),
u AS (SELECT 'p_type' AS field, p_type AS v FROM p UNION ALL SELECT 'size', size FROM p UNION ALL SELECT 'words', unnest(string_split(p_name, ' ')) FROM part)
SELECT field, count(*) AS n_cells, count(DISTINCT v) AS n_distinct, round(100 * count(*) FILTER (WHERE v = 'NR') / count(*), 1) AS pct_nr, round(100 * count(*) FILTER (WHERE v = 'NA') / count(*), 1) AS pct_na,
  round(100 * count(*) FILTER (WHERE v = 'UNCLEAR') / count(*), 1) AS pct_unclear, round(100 * count(*) FILTER (WHERE regexp_matches(v, '^-?\\d+(\\.\\d+)?$')) / count(*), 1) AS pct_numeric,
  CASE field WHEN 'p_type' THEN round(100 * count(*) FILTER (WHERE v NOT IN ('SMALL', 'LARGE', 'PROMO')) / count(*), 1) END AS pct_outside FROM u GROUP BY 1""")
def field_profile(t):
    size = F.when(c("p_size") < 5, "NR").when(c("p_size") > 45, "UNCLEAR").otherwise(c("p_size").cast("string"))
    p = t.part.select("p_type", size.alias("size"), F.split("p_name", " ").alias("words"))
    return tb.field_profile(p, ["p_type", "size", "words"], {"p_type": ["SMALL", "LARGE", "PROMO"]})


@query("""
WITH k AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1)
SELECT CASE WHEN k <= 10 THEN '1-10' WHEN k <= 20 THEN '11-20' WHEN k <= 30 THEN '21-30' ELSE '>30' END AS band, count(*) AS n_groups FROM k GROUP BY 1""")
def cardinality_histogram(t):
    return tb.cardinality_histogram(t.lineitem, "l_partkey", "l_suppkey", [(1, 10, "1-10"), (11, 20, "11-20"), (21, 30, "21-30"), (31, None, ">30")])


@query("""
WITH k AS (SELECT event_type, user_id, count(DISTINCT CASE WHEN value < 1 THEN 'a' WHEN value < 5 THEN 'b' ELSE 'c' END) AS k FROM events GROUP BY 1, 2)
SELECT event_type, count(*) FILTER (WHERE k >= 3) AS n_groups FROM k GROUP BY 1""")
def groups_with_several(t):
    e = t.events.withColumn("bin", F.when(c("value") < 1, "a").when(c("value") < 5, "b").otherwise("c"))
    return tb.groups_with_several(e, "event_type", "user_id", "bin", 3)


@query("""
WITH f AS (SELECT l_suppkey, bool_or(l_quantity = 50 AND l_discount > 0.09) AS bulk, bool_or(l_extendedprice > 99900) AS dear, bool_or(l_tax = 0 AND l_discount = 0 AND l_quantity < 3) AS plain FROM lineitem GROUP BY 1)
SELECT * FROM f WHERE bulk::INT + dear::INT + plain::INT >= 2""")
def flag_matrix(t):
    return tb.flag_matrix(t.lineitem, "l_suppkey", {
        "bulk": (c("l_quantity") == 50) & (c("l_discount") > 0.09), "dear": c("l_extendedprice") > 99900,
        "plain": (c("l_tax") == 0) & (c("l_discount") == 0) & (c("l_quantity") < 3)}, 2)


@query("""
SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1""")
def duration_percentiles(t):
    return tb.percentiles(t.events, "value", ["event_type"]).withColumns({x: F.round(x, 6) for x in ("median", "p90")})


@query("""
SELECT 'orders_urgent' AS metric, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS value, count(*) AS denominator, 'OK' AS status FROM orders
UNION ALL SELECT 'parts_large', count(*) FILTER (WHERE p_size > 40), count(*) FILTER (WHERE p_size > 100), 'NO_DENOMINATOR' FROM part
UNION ALL SELECT 'events', count(*), NULL, 'OK' FROM events""")
def report_metrics(t):
    return tb.metric_rows([
        ("orders_urgent", t.orders, F.count_if(c("o_orderpriority").startswith("1")), F.count(F.lit(1))),
        ("parts_large", t.part, F.count_if(c("p_size") > 40), F.count_if(c("p_size") > 100)),
        ("events", t.events, F.count(F.lit(1)), None)])


@query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name FROM part)
SELECT lower(name) AS folded, arg_min(name, p_partkey) AS display, count(*) AS n FROM n GROUP BY 1""")
def first_form(t):
    n = t.part.select("p_partkey", F.when(c("p_size") > 25, F.upper("p_name")).otherwise(c("p_name")).alias("name"))
    return tb.first_form(n, "name", "p_partkey")


@query("""
WITH o AS (SELECT CASE WHEN o_totalprice > 300000 THEN 'large' ELSE 'small' END AS verdict, o_orderpriority AS pr, year(o_orderdate) // 5 * 5 AS y FROM orders)
SELECT coalesce(verdict, 'ALL') AS verdict, coalesce(pr, 'ALL') AS pr, coalesce(CAST(y AS VARCHAR), 'ALL') AS y, count(*) AS n FROM o GROUP BY GROUPING SETS ((verdict, pr), (verdict, y), (verdict))""")
def verdict_tables(t):
    o = t.orders.select(F.when(c("o_totalprice") > 300000, "large").otherwise("small").alias("verdict"), c("o_orderpriority").alias("pr"), (F.floor(F.year("o_orderdate") / 5) * 5).cast("string").alias("y"))
    g = lg.usage_totals(o, F.lit(1), [["verdict", "pr"], ["verdict", "y"], ["verdict"]], ["verdict", "pr", "y"])
    return g.select("verdict", "pr", "y", c("rows").alias("n"))


# --- windows and ledgers --------------------------------------------------------------------------

@query("""
SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_write_wins(t):
    return od.latest(t.events.select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("""
WITH m AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS by_event FROM events)
SELECT event_id, by_event AS superseded_by FROM m WHERE event_id <> by_event""")
def superseded_log(t):
    e = t.events.select("user_id", "event_type", "ts", "event_id")
    return od.superseded(e, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", c("superseded_by.event_id").alias("superseded_by"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS ordinal FROM lineitem""")
def ordinal_in_parent(t):
    cols = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    out = od.row_numbers(t.lineitem.select("l_orderkey", *cols), cols, F.date_trunc("year", "l_shipdate"), ["l_orderkey"], "ordinal")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "ordinal")


@query("""
WITH g AS (SELECT l_partkey AS k, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1)
SELECT k, 'FS-' || lpad(CAST(row_number() OVER (ORDER BY first_order, k) AS VARCHAR), 6, '0') AS record_id FROM g""")
def dense_ids(t):
    g = t.lineitem.groupBy(c("l_partkey").alias("k")).agg(F.min("l_orderkey").alias("first_order"))
    out = rg.number_rows(g, ["first_order", "k"], name="n")
    return out.select("k", F.format_string("FS-%06d", "n").alias("record_id"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN sum(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey)::BIGINT END AS seq FROM orders""")
def conflict_sequence(t):
    flag = (c("o_totalprice") > 450000).cast("bigint")
    out = rg.running_total(t.orders.select("o_orderkey", "o_totalprice"), flag, ["o_orderkey"], name="seq")
    return out.select("o_orderkey", F.when(c("o_totalprice") > 450000, c("seq")).alias("seq"))


@query("""
SELECT event_id, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) AS delta FROM events""")
def reading_deltas(t):
    out = lg.reading_deltas(t.events.select("event_type", "ts", "event_id", "value"), ["event_type"], "ts", "value", "event_id")
    return out.select("event_id", F.round("delta", 6).alias("delta"))


@query("""
WITH w AS (SELECT user_id, event_id, value AS v1, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v0 FROM events WHERE event_type = 'signup')
SELECT event_id, round(CASE WHEN v1 - v0 <> 0 THEN 100 / (v1 - v0) END, 6) AS per_point FROM w WHERE v0 IS NOT NULL""")
def units_per_point(t):
    r = lg.reading_deltas(t.events.where("event_type = 'signup'").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "value", "event_id")
    out = lg.units_per_point(r.where("previous IS NOT NULL").withColumn("amount", F.lit(100.0)), "previous", "value", "amount")
    return out.select("event_id", F.round("per_point", 6).alias("per_point"))


@query("""
SELECT user_id, count(*) AS n_attempts, string_agg(event_type || '->' || CASE WHEN value > 60 THEN 'ok' WHEN value > 10 THEN 'blocked' ELSE 'empty' END, '; ' ORDER BY ts, event_id) AS attempts,
  arg_max(CASE WHEN value > 60 THEN 'ok' WHEN value > 10 THEN 'blocked' ELSE 'empty' END, (ts, event_id)) AS last_outcome, CASE WHEN bool_or(value > 60) THEN 'obtained' ELSE 'not_obtained' END AS verdict FROM events GROUP BY 1""")
def attempt_rollup(t):
    e = t.events.withColumn("outcome", F.when(c("value") > 60, "ok").when(c("value") > 10, "blocked").otherwise("empty"))
    return lg.attempt_rollup(e, "user_id", ["ts", "event_id"], "event_type", "outcome", ["ok"])


@query("""
WITH e AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN value < 5 THEN NULL ELSE CAST(regexp_extract(props, '\\d+') AS BIGINT) END AS a FROM events)
SELECT coalesce(event_type, 'ALL') AS event_type, coalesce(user_id, 'ALL') AS user_id, sum(a)::BIGINT AS known, count(*) FILTER (WHERE a IS NULL) AS unknown, count(*) AS rows FROM e GROUP BY GROUPING SETS ((event_type), (user_id), ())""")
def usage_totals_unknown(t):
    amount = F.when(c("value") < 5, F.lit(None)).otherwise(F.regexp_extract("props", r"\d+", 0).try_cast("bigint"))
    return lg.usage_totals(t.events, amount, [["event_type"], ["user_id"], []], ["event_type", "user_id"])


@query("""
SELECT event_type, 'k' AS name, sum(CAST(regexp_extract(props, '\\d+') AS DOUBLE)) AS total, 0 AS not_numeric, count(*) AS n FROM events GROUP BY 1""")
def json_leaf_totals(t):
    return lg.json_number_totals(t.events, "props", "^(k|.*tokens)$", ["event_type"])


# Every order is one run record: its lines as nested entries, a name that is no count, text with brackets, and for a third of the orders totals of its own.
@query("""
WITH l AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q, sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS p, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 7 * n ELSE q END AS BIGINT) AS input, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 5 * n ELSE n END AS BIGINT) AS reasoning,
  CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE p END AS BIGINT) AS output, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 7 * n ELSE q + p END AS BIGINT) AS billable,
  CASE WHEN l_orderkey % 3 = 0 THEN 'totals block' ELSE 'summed per-record' END AS method FROM l""")
def json_nested_totals(t):
    usage = F.struct(c("l_quantity").cast("bigint").alias("prompt_tokens"), F.array(F.struct(c("l_extendedprice").alias("sum_tokens_out"), F.lit("9").alias("input"))).alias("parts"))
    entry = F.struct(c("l_linenumber").alias("line"), F.lit('a "{[" b').alias("note"), usage.alias("usage"), F.struct(F.lit(1).alias("reasoning")).alias("deep"))
    n = F.count(F.lit(1))
    own = F.when(c("l_orderkey") % 3 == 0, F.struct((7 * n).alias("total_input_tokens"), F.array(F.struct((5 * n).alias("reasoning_tokens"))).alias("by_model")))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(entry).alias("records"), own.alias("totals"), F.lit(3).alias("tokens"))).alias("doc"))
    return jt.json_class_totals(docs, ["l_orderkey"], "doc")
