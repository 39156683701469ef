"""Diff, patch, guarded load, enrichment and workflow queries on tables and perturbed copies of them.

The copies are derived from the given tables by rules on a hash of the key, so the expected result can
be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as ru
from ..operators import diff as df_
from ..operators import evidence as ev
from ..operators import patch as pt
from ..operators import redact as rd
from ..operators import tables as tb
from ..operators import workflow as wf
from ..session import cut_lineage
from .registry import query
from .text import FAMILY_RULES, FAMILY_SQL

c = F.col


def md5(tag: str, *cols: str):
    return F.md5(F.concat_ws("|", F.lit(tag), *[c(x).cast("string") for x in cols]))


# --- two versions of lineitem ---------------------------------------------------------------------

LINES_SQL = """v AS (SELECT *, row_number() OVER () AS rid, md5(concat_ws('|', 'd', l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS h FROM lineitem),
a AS (SELECT rid, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, l_tax, l_discount, l_extendedprice AS o_price, h, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty,
  printf('%.2f', l_extendedprice) AS price, CASE WHEN h > 'f8' THEN '' ELSE l_returnflag END AS flag, l_linestatus AS status FROM v),
b AS (SELECT rid, l_orderkey, CASE WHEN h < '10' THEN l_partkey + 100000 ELSE l_partkey END AS l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, l_tax, l_discount, l_extendedprice AS o_price, h, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty,
  CASE WHEN h >= '10' AND h < '18' THEN printf('%.3f', l_extendedprice + 0.004) WHEN h >= '18' AND h < '20' THEN printf('%.2f', l_extendedprice + 5) ELSE printf('%.2f', l_extendedprice) END AS price,
  CASE WHEN h >= '20' AND h < '28' OR h > 'fc' THEN '' WHEN h >= '28' AND h < '30' THEN 'Z' ELSE l_returnflag END AS flag, l_linestatus AS status FROM v WHERE h >= '08'),
na AS (SELECT *, l_partkey || '|' || l_suppkey AS k, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey ORDER BY l_shipdate, l_linenumber, l_quantity, l_tax, l_discount, o_price, h) AS n FROM a),
nb AS (SELECT *, l_partkey || '|' || l_suppkey AS k, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey ORDER BY l_shipdate, l_linenumber, l_quantity, l_tax, l_discount, o_price, h) AS n FROM b),
m1 AS (SELECT na.rid AS ra, nb.rid AS rb FROM na JOIN nb USING (l_orderkey, k, n)),
la AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_quantity, l_tax, l_discount, o_price, h) AS n FROM a WHERE rid NOT IN (SELECT ra FROM m1)),
lb AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_quantity, l_tax, l_discount, o_price, h) AS n FROM b WHERE rid NOT IN (SELECT rb FROM m1)),
m AS (SELECT 'content' AS how, ra, rb FROM m1 UNION ALL SELECT CASE WHEN la.rid IS NOT NULL AND lb.rid IS NOT NULL THEN 'ordinal' WHEN la.rid IS NOT NULL THEN 'only_a' ELSE 'only_b' END, la.rid, lb.rid FROM la FULL JOIN lb USING (l_orderkey, n)),
cells AS (SELECT a.l_linenumber, f.* FROM m JOIN a ON a.rid = ra JOIN b ON b.rid = rb, LATERAL (SELECT unnest(['qty', 'price', 'flag', 'status']) AS field, unnest(['amount', 'amount', 'state', 'state']) AS family, unnest(['count', 'free_text', 'coded', 'coded']) AS kind,
  unnest([a.qty, a.price, a.flag, a.status]) AS va, unnest([b.qty, b.price, b.flag, b.status]) AS vb) f),
cat AS (SELECT *, CASE WHEN va = '' AND vb = '' THEN 'both_empty' WHEN va = vb THEN 'agree' WHEN va <> '' AND vb <> '' THEN 'disagree' WHEN va <> '' THEN 'only_a' ELSE 'only_b' END AS category FROM cells)"""
ORDER = ["l_shipdate", "l_linenumber", "l_quantity", "l_tax", "l_discount", "o_price", "h"]
COLUMNS = df_.compared_columns({"qty": "count", "price": "free_text", "flag": "coded", "status": "coded"},
                               {"qty": "amount", "price": "amount", "flag": "state", "status": "state"})


def line_versions(t):
    h = md5("d", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    v = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "l_tax", "l_discount",
                          c("l_extendedprice").alias("o_price"), h.alias("h"), c("l_quantity").cast("string").alias("qty"),
                          "l_returnflag", c("l_linestatus").alias("status"))
    two = lambda x: F.format_string("%.2f", x)
    a = v.select("*", two(c("o_price")).alias("price"), F.when(c("h") > "f8", "").otherwise(c("l_returnflag")).alias("flag"))
    h = c("h")
    b = v.where("h >= '08'").select(
        *[x if x != "l_partkey" else F.when(h < "10", c("l_partkey") + 100000).otherwise(c("l_partkey")).alias("l_partkey") for x in v.columns],
        F.when((h >= "10") & (h < "18"), F.format_string("%.3f", c("o_price") + 0.004)).when((h >= "18") & (h < "20"), two(c("o_price") + 5))
        .otherwise(two(c("o_price"))).alias("price"),
        F.when(((h >= "20") & (h < "28")) | (h > "fc"), "").when((h >= "28") & (h < "30"), "Z").otherwise(c("l_returnflag")).alias("flag"))
    return a, b


def line_alignment(t):
    a, b = line_versions(t)
    return a, b, df_.align(a, b, ["l_orderkey", "l_linenumber"], "l_orderkey", ORDER, F.date_trunc("year", "l_shipdate"), ["l_partkey", "l_suppkey"])


@query(f"WITH {LINES_SQL} SELECT how, count(*) AS n FROM m GROUP BY 1")
def table_align(t):
    return line_alignment(t)[2].groupBy("how").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES_SQL} SELECT field, category, count(*) AS n FROM cat GROUP BY 1, 2")
def cell_diff(t):
    return df_.cells(line_alignment(t)[2], COLUMNS, "lines").groupBy("field", "category").agg(F.count(F.lit(1)).alias("n"))


def _metric_sql(p: str, cond: str) -> str:
    k = {x: f"count(*) FILTER (WHERE {cond} AND category = '{x}')" for x in ("agree", "disagree", "only_a", "only_b")}
    any_ = " + ".join(k.values())
    return (f"{any_} AS {p}cells, " + ", ".join(f"{v} AS {p}{x}" for x, v in k.items())
            + f", round(CASE WHEN {k['agree']} + {k['disagree']} > 0 THEN {k['agree']} / ({k['agree']} + {k['disagree']}) END, 4) AS {p}both_filled"
            + f", round(CASE WHEN {any_} > 0 THEN {k['agree']} / ({any_}) END, 4) AS {p}any_filled")


@query(f"""WITH {LINES_SQL}, ct AS (SELECT 'lines' AS tab, * FROM cat)
SELECT coalesce(tab, 'ALL') AS "table", coalesce(family, 'ALL') AS family, coalesce(field, 'ALL') AS field, {_metric_sql('', 'true')}, {_metric_sql('coded_', "kind IN ('coded', 'count')")},
  count(*) FILTER (WHERE category = 'both_empty') AS both_empty FROM ct GROUP BY GROUPING SETS ((tab), (family), (tab, field), ())""")
def diff_rollup(t):
    return df_.diff_rollup(df_.cells(line_alignment(t)[2], COLUMNS, "lines"))


@query(f"""WITH {LINES_SQL}, p AS (SELECT CASE WHEN category = 'disagree' AND field = 'price' AND round(TRY_CAST(va AS DOUBLE), 2) = round(TRY_CAST(vb AS DOUBLE), 2) THEN 'agree_within_rounding' ELSE category END AS category, field FROM cat)
SELECT field, category, count(*) AS n FROM p GROUP BY 1, 2""")
def numeric_rescore(t):
    cells = df_.numeric_rescore(df_.cells(line_alignment(t)[2], COLUMNS, "lines"))
    return cells.groupBy("field", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES_SQL}, x AS (SELECT l_linenumber AS g, count(*) AS rows_a FROM a GROUP BY 1), y AS (SELECT l_linenumber AS g, count(*) AS rows_b FROM b GROUP BY 1),
z AS (SELECT a.l_linenumber AS g, count(*) AS matched FROM m JOIN a ON a.rid = ra WHERE rb IS NOT NULL GROUP BY 1), w AS (SELECT l_linenumber AS g, count(*) FILTER (WHERE category = 'agree') AS agree, count(*) AS cells FROM cat WHERE category <> 'both_empty' GROUP BY 1)
SELECT g AS l_linenumber, rows_a, rows_b, matched, round(matched / rows_a, 3) AS recall, round(matched / rows_b, 3) AS precision, round(agree / cells, 3) AS cell_agreement FROM x JOIN y USING (g) JOIN z USING (g) JOIN w USING (g)""")
def run_comparison(t):
    a, b, al = line_alignment(t)
    # Read by the rows and by the cells, so it is written once, with no more than they need.
    side = lambda x: F.when(c(x).isNotNull(), F.struct(*[c(f"{x}.{k}") for k in ("l_linenumber", "qty", "price", "flag", "status")])).alias(x)
    al = cut_lineage(al.select("how", side("a"), side("b")))
    return df_.run_comparison(a, b, al, df_.cells(al, COLUMNS, "lines", ["l_linenumber"]), "l_linenumber")


@query(f"""WITH {LINES_SQL} SELECT coalesce(x.k, y.k) AS l_orderkey, coalesce(rows_a, 0) AS rows_a, coalesce(rows_b, 0) AS rows_b, 'lines' AS "table"
FROM (SELECT l_orderkey AS k, count(*) AS rows_a FROM a GROUP BY 1) x FULL JOIN (SELECT l_orderkey AS k, count(*) AS rows_b FROM b GROUP BY 1) y ON x.k = y.k""")
def row_coverage(t):
    a, b = line_versions(t)
    return df_.row_coverage(a, b, "l_orderkey", "lines")


@query(f"""WITH {LINES_SQL} SELECT m.how, a.l_orderkey AS orderkey, a.l_partkey AS partkey, a.price FROM m JOIN a ON a.rid = m.ra WHERE m.how = 'only_a'
UNION ALL SELECT m.how, b.l_orderkey, b.l_partkey, b.price FROM m JOIN b ON b.rid = m.rb WHERE m.how = 'only_b'""")
def rows_on_one_side(t):
    o = df_.only_rows(line_alignment(t)[2])
    j = lambda k: F.get_json_object("row", f"$.{k}")
    return o.select("how", j("l_orderkey").cast("bigint").alias("orderkey"), j("l_partkey").cast("bigint").alias("partkey"), j("price").alias("price"))


@query(f"""WITH {LINES_SQL}, e AS (SELECT field, l_linenumber, count(*) AS n FROM cat WHERE category = 'both_empty' GROUP BY 1, 2)
SELECT 'lines' AS "table", field, l_linenumber, n, CASE WHEN l_linenumber = 1 THEN 'not_extractable_from_text' WHEN l_linenumber = 2 THEN 'flagged: manual_unclear, other' ELSE 'flagged: other' END AS reason FROM e""")
def empty_by_both(t):
    # Notes derive from the table: line numbers that occur are flagged by a rule.
    lines = t.lineitem.select("l_linenumber").distinct()
    notes = (lines.where("l_linenumber <= 2").select(F.lit("lines").alias("table"), F.lit("flag").alias("field"), "l_linenumber",
                                                   F.when(c("l_linenumber") == 1, "not_extractable_from_text").otherwise("manual_unclear").alias("issue"))
             .unionByName(t.lineitem.groupBy().agg(F.count(F.lit(1)).alias("n")).select(
                 F.lit("lines").alias("table"), F.lit("flag").alias("field"), F.lit(None).cast("int").alias("l_linenumber"), F.lit("other").alias("issue"))))
    cells = df_.cells(line_alignment(t)[2], COLUMNS, "lines", ["l_linenumber"])
    return df_.empty_by_both(cells, "l_linenumber", notes)


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey AS parent, o_orderdate, o_orderstatus AS s FROM orders),
b AS (SELECT id + 10000000 AS id, parent, o_orderdate, CASE WHEN s = 'P' THEN 'O' ELSE s END AS s FROM o WHERE md5(concat_ws('|', 'o', id)) >= '1'),
na AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY o_orderdate, id) AS n FROM o), nb AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY o_orderdate, id) AS n FROM b)
SELECT CASE WHEN na.id IS NOT NULL AND nb.id IS NOT NULL THEN 'ordinal' WHEN na.id IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS how, na.s = nb.s AS same, count(*) AS n FROM na FULL JOIN nb USING (parent, n) GROUP BY 1, 2""")
def align_auto_ordinal(t):
    a = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("parent"), "o_orderdate", c("o_orderstatus").alias("s"))
    b = a.where(md5("o", "id") >= "1").select((c("id") + 10000000).alias("id"), "parent", "o_orderdate", F.when(c("s") == "P", "O").otherwise(c("s")).alias("s"))
    al = df_.align(a, b, ["id"], "parent", ["o_orderdate", "id"], F.date_trunc("year", "o_orderdate"))
    return al.groupBy("how", (c("a.s") == c("b.s")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH a AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_shipdate, l_partkey)) AS p FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_shipdate, l_partkey)) AS p FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
SELECT CASE WHEN b.l_orderkey IS NULL THEN 'only_a' ELSE 'key' END AS how, a.p = b.p AS same, count(*) AS n FROM a LEFT JOIN b USING (l_orderkey) GROUP BY 1, 2""")
def align_by_key(t):
    a = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity")
    al = df_.align(a, a.where("l_quantity > 20"), ["l_orderkey"], "l_orderkey", ["l_linenumber", "l_shipdate", "l_partkey"], F.lit(0))
    return al.groupBy("how", (c("a.l_partkey") == c("b.l_partkey")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT o_orderkey, CASE WHEN md5(concat_ws('|', 'g', o_orderkey)) < '3' THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN md5(concat_ws('|', 'g', o_orderkey)) < '1' THEN NULL ELSE o_totalprice END AS p FROM orders)
SELECT 'o_orderstatus' AS field, count(*) FILTER (WHERE s IS DISTINCT FROM o_orderstatus) AS changed FROM n JOIN orders USING (o_orderkey)
UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE p IS DISTINCT FROM o_totalprice) FROM n JOIN orders USING (o_orderkey)""")
def changed_fields(t):
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    h = md5("g", "o_orderkey")
    new = old.select("o_orderkey", F.when(h < "3", "X").otherwise(c("o_orderstatus")).alias("o_orderstatus"), F.when(h >= "1", c("o_totalprice")).alias("o_totalprice"))
    return rd.changed_counts(old, new, "o_orderkey")


# --- patches on orders ----------------------------------------------------------------------------

PATCH_SQL = """o AS (SELECT o_orderkey AS id, o_custkey AS rec, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS pr, md5(concat_ws('|', 'u', o_orderkey)) AS hu, md5(concat_ws('|', 'a', o_orderkey)) AS ha, md5(concat_ws('|', 's', o_orderkey)) >= '02' AS supported FROM orders),
u AS (SELECT rec, CASE WHEN hu < '008' THEN id + 1000000000 ELSE id END AS id, 'pr' AS field, 'PATCHED' AS val, hu >= '10' AND hu < '104' AS set_null, supported FROM o WHERE hu < '11' UNION ALL SELECT rec, id, 'pr', 'PATCHED', false, supported FROM o WHERE hu >= '0f8' AND hu < '1'),
ad AS (SELECT CASE WHEN ha < '002' THEN id ELSE id + 1000000 END AS id, rec, s, CASE WHEN ha >= '002' AND ha < '006' THEN p ELSE p + 1 END AS p, pr, supported FROM o WHERE ha < '04'),
err AS (SELECT u.rec, 'unknown row: ' || u.id AS e FROM u LEFT JOIN o ON o.id = u.id WHERE o.id IS NULL
  UNION SELECT rec, 'exactly one typed value required: ' || id || '/pr' FROM u WHERE set_null UNION SELECT rec, 'quote not found: ' || id || '/pr' FROM u WHERE NOT supported
  UNION SELECT rec, 'duplicate update: ' || id || '/pr' FROM u GROUP BY rec, id HAVING count(*) > 1
  UNION SELECT ad.rec, 'duplicate row id: ' || ad.id FROM ad JOIN o ON o.id = ad.id UNION SELECT ad.rec, 'id does not continue: ' || ad.id FROM ad WHERE ad.id <= (SELECT max(id) FROM o WHERE o.rec = ad.rec)
  UNION SELECT ad.rec, 'exact duplicate values: ' || ad.id FROM ad WHERE EXISTS (SELECT 1 FROM o WHERE o.rec = ad.rec AND o.s = ad.s AND o.p = ad.p AND o.pr = ad.pr)
  UNION SELECT rec, 'no supported locator: ' || id FROM ad WHERE NOT supported),
bad AS (SELECT rec, string_agg(e, '; ' ORDER BY e) AS errors FROM err GROUP BY 1)"""


def patch_parts(t):
    o = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("rec"), c("o_orderstatus").alias("s"), c("o_totalprice").alias("p"), c("o_orderpriority").alias("pr"))
    h = o.select("*", md5("u", "id").alias("hu"), md5("a", "id").alias("ha"), (md5("s", "id") >= "02").alias("supported"))
    hu, ha = c("hu"), c("ha")
    shared = [F.lit("pr").alias("field"), F.lit("PATCHED").alias("value_text"), F.lit(None).cast("bigint").alias("value_integer"), F.lit(None).cast("array<string>").alias("value_list")]
    up = h.where("hu < '11'").select("rec", F.when(hu < "008", c("id") + 1000000000).otherwise(c("id")).alias("id"), *shared, ((hu >= "10") & (hu < "104")).alias("set_null"), "supported")
    up = up.unionByName(h.where("hu >= '0f8' AND hu < '1'").select("rec", "id", *shared, F.lit(False).alias("set_null"), "supported"))
    ad = h.where("ha < '04'").select(F.when(ha < "002", c("id")).otherwise(c("id") + 1000000).alias("id"), "rec", "s",
                                     F.when((ha >= "002") & (ha < "006"), c("p")).otherwise(c("p") + 1).alias("p"), "pr", "supported")
    bad = pt.rejects([pt.update_errors(up, o, "rec", "id"), pt.addition_errors(ad.withColumn("num", c("id")), o.withColumn("num", c("id")), "rec", "id", "num", ["s", "p", "pr"])], "rec")
    return o, up, ad, bad


@query(f"WITH {PATCH_SQL} SELECT rec, errors FROM bad")
def patch_rejects(t):
    return patch_parts(t)[3]


@query(f"""WITH {PATCH_SQL} SELECT o.id, o.rec, s, p, CASE WHEN u.id IS NOT NULL THEN 'PATCHED' ELSE pr END AS pr FROM o LEFT JOIN (SELECT DISTINCT id FROM u WHERE rec NOT IN (SELECT rec FROM bad)) u ON u.id = o.id
UNION ALL SELECT id, rec, s, p, pr FROM ad WHERE rec NOT IN (SELECT rec FROM bad)""")
def patch_apply(t):
    o, up, ad, bad = patch_parts(t)
    return pt.apply_patch(o, up, ad.drop("supported"), bad, "rec", "id", ["pr", "p", "s"])


@query("""
WITH o AS (SELECT o_orderkey AS op, o_orderkey - 1 AS dep, md5(concat_ws('|', 'i', o_orderkey)) >= '1' AS ok FROM orders)
SELECT CASE WHEN NOT o.ok THEN 'unsupported_quote' WHEN NOT d.ok THEN 'depends_on_isolated' ELSE '' END AS isolated, count(*) AS n FROM o LEFT JOIN o d ON d.op = o.dep GROUP BY 1""")
def isolate_operations(t):
    ops = t.orders.select(c("o_orderkey").alias("op"), (c("o_orderkey") - 1).alias("dep"), (md5("i", "o_orderkey") >= "1").alias("supported"))
    return pt.isolate(ops, "op", "dep", "unsupported_quote", "depends_on_isolated").groupBy("isolated").agg(F.count(F.lit(1)).alias("n"))


# --- cited evidence: every line of a document is a page, in either notation --------------------------

EVIDENCE_SQL = r"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n FROM documents),
w AS (SELECT *, list_filter(string_split(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '"', '', 'g'), ' '), lambda x: x <> '') AS w, md5(doc_id || '|' || page) AS h FROM l),
q AS (SELECT *, doc_id * 100000 + page AS op, contains(line, '"') AS quoted, array_to_string(w[1:5], ' ') AS five FROM w WHERE len(w) >= 5)"""
OPS_SQL = f"""{EVIDENCE_SQL}, ops AS (SELECT doc_id, op, CASE WHEN page % 3 = 0 THEN 'new_row' ELSE 'update' END AS kind, CASE WHEN page % 8 <> 0 THEN op - 1 END AS dep,
  h >= '2' AND NOT (h < '28' AND len(w) > 25) AND contains(trim(regexp_replace(line, '\\s+', ' ', 'g')), CASE WHEN h < '28' THEN array_to_string(w[1:30], ' ') ELSE five END) AND NOT contains(five, '...') AND NOT contains(five, '…')
  AND five NOT IN ('NA', 'NR', 'UNCLEAR') AS ok FROM q)"""


def evidence_parts(t):
    """Documents with pages (form feeds in even ones, markers in odd ones) and, for every page of five words, quotes of its first words."""
    lines = F.split("text", "\n")
    marked = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("[[page "), (i + 1).cast("string"), F.lit("]]\n"), x)), "\n")
    docs = t.documents.select("doc_id", F.when((c("doc_id") % 2 == 0) & (F.size(lines) > 1), F.array_join(lines, "\f")).otherwise(marked).alias("text"))
    words = F.filter(F.split(F.replace(F.trim(F.regexp_replace("line", r"\s+", " ")), F.lit('"'), F.lit("")), " "), lambda x: x != "")
    q = (t.documents.select("doc_id", F.posexplode(lines).alias("i", "line")).select("doc_id", (c("i") + 1).alias("page"), words.alias("w"))
         .withColumn("h", F.md5(F.concat_ws("|", "doc_id", "page"))).where(F.size("w") >= 5))
    return docs, q.withColumns({"op": c("doc_id") * 100000 + c("page"), "five": F.array_join(F.slice("w", 1, 5), " ")})


def patch_operations(t):
    docs, q = evidence_parts(t)
    h = c("h")
    quote = (F.when(h < "08", F.concat("five", F.lit(" ... unseen"))).when(h < "1", F.concat("five", F.lit(" unseen"))).when(h < "18", "").when(h < "2", c("five"))
             .when(h < "28", F.array_join(F.slice("w", 1, 30), " ")).otherwise(c("five")))
    page = F.when((h >= "18") & (h < "2"), F.when(h < "1c", "900000").otherwise("UNCLEAR")).otherwise(c("page").cast("string"))
    ops = q.select("doc_id", "op", F.when(c("page") % 3 == 0, "new_row").otherwise("update").alias("kind"), F.when(c("page") % 8 != 0, c("op") - 1).alias("depends_on"),
                   page.alias("page"), quote.alias("quote"))
    # Read three times below: as operations, as dependencies and for those that fail.
    done = cut_lineage(ev.quote_supported(ops, docs, "doc_id", "text", "page", "quote").drop("page", "quote"))
    return pt.isolate_unsupported(done, done.select("op", "depends_on"), "op", "kind",
                                  {"update": "unsupported_update_quote_page", "new_row": "unsupported_new_row_locator"}, "depends_on_isolated_operation")


@query(f"""WITH RECURSIVE {OPS_SQL}, r AS (SELECT op FROM ops WHERE NOT ok UNION SELECT ops.op FROM ops JOIN r ON ops.dep = r.op)
SELECT doc_id, op, CASE WHEN NOT ok AND kind = 'update' THEN 'unsupported_update_quote_page' WHEN NOT ok THEN 'unsupported_new_row_locator'
  WHEN op IN (SELECT op FROM r) THEN 'depends_on_isolated_operation' ELSE '' END AS isolated FROM ops""")
def patch_isolated(t):
    return patch_operations(t).select("doc_id", "op", "isolated")


@query(f"""WITH RECURSIVE {OPS_SQL}, r AS (SELECT op FROM ops WHERE NOT ok UNION SELECT ops.op FROM ops JOIN r ON ops.dep = r.op),
i AS (SELECT doc_id, op, kind, CASE WHEN NOT ok AND kind = 'update' THEN 'unsupported_update_quote_page' WHEN NOT ok THEN 'unsupported_new_row_locator'
  WHEN op IN (SELECT op FROM r) THEN 'depends_on_isolated_operation' END AS reason FROM ops)
SELECT doc_id, count(reason) AS n_isolated, count(*) - count(reason) AS n_applied, 'partial' AS completion,
  string_agg('Manual review required: ' || kind || ' ' || op || ' (' || reason || ').', chr(10) ORDER BY 'Manual review required: ' || kind || ' ' || op || ' (' || reason || ').') AS remaining
FROM i GROUP BY 1 HAVING count(reason) > 0""")
def patch_partial(t):
    p = pt.partial_records(patch_operations(t), "doc_id", "op", "kind")
    return p.withColumn("remaining", F.array_join("remaining", "\n"))


# Two cells a record: one that has to be filled, with all kinds of faults, and one that may be blank. One record in sixteen has no text.
@query(rf"""WITH {EVIDENCE_SQL}, s AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h) = 1),
c AS (SELECT *, md5('src|' || doc_id) < '1' AS lost, trim(regexp_replace(line, '\s+', ' ', 'g')) AS flat FROM s),
a AS (SELECT doc_id, 'decisive' AS field, unnest(CASE WHEN h < '02' THEN ['missing_evidence'] WHEN h < '04' THEN ['format'] ELSE
    list_filter([CASE WHEN h < '08' AND len(w) > 20 THEN 'word_limit' END, CASE WHEN h >= '08' AND h < '0c' THEN 'missing_page'
      WHEN NOT contains(flat, CASE WHEN h < '08' THEN array_to_string(w, ' ') WHEN h >= '0c' AND h < '1' THEN five || ' unseen' ELSE five END) THEN 'not_verbatim_on_page' END], lambda x: x IS NOT NULL) END) AS issue FROM c WHERE NOT lost),
b AS (SELECT doc_id, 'comment' AS field, CASE WHEN page > 1 AND h[2] < '4' THEN 'missing_page' WHEN h[2] < '8' AND NOT contains(flat, five) THEN 'not_verbatim_on_page' END AS issue FROM c WHERE NOT lost)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE issue IS NOT NULL UNION ALL SELECT doc_id, 'full_text', 'missing_source' FROM c WHERE lost""")
def evidence_audit(t):
    docs, q = evidence_parts(t)
    s = q.groupBy("doc_id").agg(F.min_by(F.struct("page", "w", "five", "h"), "h").alias("s")).select("doc_id", "s.*")
    h = c("h")
    cell = lambda page, words: F.concat(F.lit("p."), page.cast("string"), F.lit(': "'), words, F.lit('"'))
    decisive = (F.when(h < "02", "").when(h < "04", c("five")).when(h < "08", cell(c("page"), F.array_join("w", " "))).when(h < "0c", cell(c("page") + 500000, c("five")))
                .when(h < "1", cell(c("page"), F.concat("five", F.lit(" unseen")))).otherwise(cell(c("page"), c("five"))))
    second = F.substring("h", 2, 1)
    comment = F.when((second < "4") & (c("page") > 1), cell(c("page") + 400000, c("five"))).when(second < "8", cell(c("page"), c("five"))).otherwise(F.lit(None))
    records = s.select("doc_id", decisive.alias("decisive"), comment.alias("comment"))
    have = docs.where(F.md5(F.concat(F.lit("src|"), c("doc_id").cast("string"))) >= "1")
    return ev.audit_quotes(records, have, "doc_id", "text", ["decisive", "comment"], ["decisive"])


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, md5(concat_ws('|', 'r', o_orderkey)) AS h FROM orders), n AS (SELECT k, CASE WHEN h < '01' THEN id + 1000000 ELSE id END AS id, h >= '02' AS ok FROM o WHERE h < 'ff8'),
j AS (SELECT coalesce(o.k, n.k) AS k, o.id AS oi, n.id AS ni, n.ok FROM o FULL JOIN n ON o.k = n.k AND o.id = n.id),
g AS (SELECT k, count(*) FILTER (WHERE ni IS NULL) AS lost, count(oi) AS a, count(ni) AS b, count(*) FILTER (WHERE NOT ok) AS badl FROM j GROUP BY 1)
SELECT CASE WHEN lost > 0 THEN 'missing_existing_ids' WHEN b < a THEN 'fewer_rows' WHEN badl > 0 THEN 'invalid_linkage' ELSE '' END AS reason, count(*) AS n FROM g GROUP BY 1""")
def replacement_guard(t):
    o = t.orders.select(c("o_custkey").alias("k"), c("o_orderkey").alias("id"), md5("r", "o_orderkey").alias("h"))
    n = o.where("h < 'ff8'").select("k", F.when(c("h") < "01", c("id") + 1000000).otherwise(c("id")).alias("id"), (c("h") >= "02").alias("ok"))
    return pt.replacement_guard(o, n, "k", "id", c("ok")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- guarded load on customer ---------------------------------------------------------------------

LOAD_SQL = """cu AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nat, md5(concat_ws('|', 'l', c_custkey)) AS h FROM customer),
inc AS (SELECT k, CASE WHEN h < '2' THEN 'Other' ELSE name END AS name, CASE WHEN h < '4' THEN 'MACHINERY; SPACE' WHEN h < '5' THEN '' ELSE 'BUILDING' END AS seg, '99' AS nat, CASE WHEN h > 'e' THEN 'x' END AS extra FROM cu),
act AS (SELECT inc.k, f.field, f.o AS old, f.n AS new, CASE WHEN f.field = 'extra' THEN 'unknown_field' WHEN coalesce(f.n, '') = '' THEN 'blank' WHEN f.field = 'nat' THEN 'refused' WHEN f.field = 'name' AND f.o <> '' AND f.o <> f.n THEN 'locked_mismatch' WHEN f.field = 'name' THEN 'locked_kept'
  WHEN f.field = 'seg' AND contains(f.n, 'SPACE') THEN 'write_out_of_vocabulary' ELSE 'write' END AS action FROM inc JOIN cu USING (k), LATERAL (SELECT unnest(['name', 'seg', 'nat', 'extra']) AS field, unnest([cu.name, cu.seg, cu.nat, NULL]) AS o, unnest([inc.name, inc.seg, inc.nat, inc.extra]) AS n) f)"""


def load_parts(t):
    cu = t.customer.select(c("c_custkey").alias("k"), c("c_name").alias("name"), c("c_mktsegment").alias("seg"), c("c_nationkey").cast("string").alias("nat"))
    h = md5("l", "k")
    inc = cu.select("k", F.when(h < "2", "Other").otherwise(c("name")).alias("name"), F.when(h < "4", "MACHINERY; SPACE").when(h < "5", "").otherwise("BUILDING").alias("seg"),
                    F.lit("99").alias("nat"), F.when(h > "e", "x").alias("extra"))
    act = pt.load_actions(cu, inc, "k", ["name", "seg", "nat"], ["name"], ["nat"], {"seg": ["MACHINERY", "BUILDING"]})
    return cu, act


@query(f"WITH {LOAD_SQL} SELECT k, field, old, new, action FROM act")
def guarded_load_actions(t):
    return load_parts(t)[1]


@query(f"WITH {LOAD_SQL} SELECT cu.k, cu.name, coalesce(w.new, cu.seg) AS seg, cu.nat FROM cu LEFT JOIN (SELECT k, new FROM act WHERE field = 'seg' AND action LIKE 'write%') w ON w.k = cu.k")
def guarded_load_apply(t):
    cu, act = load_parts(t)
    return pt.apply_load(cu, act, "k", ["name", "seg", "nat"])


@query("""
WITH au AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS recorded FROM events GROUP BY 1), p AS (SELECT user_id AS k, event_type AS f, arg_min(event_type, event_id) AS cur FROM events GROUP BY 1, 2)
SELECT p.k, f, CASE WHEN f = 'view' THEN '' ELSE cur END AS current, f = 'view' OR cur = recorded AS allowed FROM p JOIN au ON au.k = p.k""")
def overwrite_guard(t):
    audit = t.events.select(c("user_id").alias("k"), c("event_type").alias("value"), "ts", "event_id")
    prop = t.events.groupBy(c("user_id").alias("k"), c("event_type").alias("f")).agg(F.min_by("event_type", "event_id").alias("cur"))
    prop = prop.select("k", "f", F.when(c("f") == "view", "").otherwise(c("cur")).alias("current"))
    return pt.overwrite_guard(prop, audit, ["k"], ["ts", "event_id"]).select("k", "f", "current", "allowed")


# --- enrichment and queues ------------------------------------------------------------------------

FILL_SQL = """d AS (SELECT doc_id, md5(concat_ws('|', 'f', doc_id)) AS h, lang, source FROM documents),
r AS (SELECT doc_id, CASE WHEN h < '4' THEN 'has text' ELSE '' END AS abstract, '' AS abstract_source, CASE WHEN h > '8' THEN CAST(doc_id AS VARCHAR) ELSE '' END AS pmid, CASE WHEN h > '5' OR h < '2' THEN 'doi-' || doc_id ELSE '' END AS doi, source FROM d),
val AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'q' || quality AS value FROM labels), map AS (SELECT 'doi-' || doc_id AS alt, CAST(doc_id AS VARCHAR) AS id FROM d WHERE lang = 'en'),
x AS (SELECT r.*, CASE WHEN abstract = '' AND pmid <> '' THEN pmid WHEN abstract = '' AND doi <> '' THEN map.id END AS key, CASE WHEN pmid <> '' THEN 'id' ELSE 'alt' END AS by_ FROM r LEFT JOIN map ON map.alt = r.doi),
y AS (SELECT x.*, val.value AS v FROM x LEFT JOIN val ON val.id = x.key),
f AS (SELECT doc_id, source, CASE WHEN abstract <> '' THEN abstract ELSE coalesce(v, '') END AS abstract, CASE WHEN abstract = '' AND v IS NOT NULL THEN 'lookup by ' || by_ ELSE '' END AS abstract_source, CASE WHEN abstract = '' AND v IS NOT NULL AND pmid = '' THEN key ELSE pmid END AS pmid,
  CASE WHEN abstract <> '' THEN 'already_filled' WHEN v IS NOT NULL THEN 'filled_by_' || by_ ELSE '' END AS route,
  CASE WHEN abstract <> '' OR v IS NOT NULL THEN '' WHEN pmid = '' AND doi = '' THEN 'no_identifier' WHEN pmid <> '' THEN 'id_without_value' WHEN key IS NOT NULL THEN 'mapped_id_without_value' ELSE 'alternative_id_not_mapped' END AS reason FROM y)"""


def filled(t):
    h = md5("f", "doc_id")
    key = c("doc_id").cast("string")
    r = t.documents.select("doc_id", F.when(h < "4", "has text").otherwise("").alias("abstract"), F.lit("").alias("abstract_source"), F.when(h > "8", key).otherwise("").alias("pmid"),
                           F.when((h > "5") | (h < "2"), F.concat(F.lit("doi-"), key)).otherwise("").alias("doi"), "source")
    val = t.labels.select(key.alias("id"), F.concat(F.lit("q"), c("quality").cast("string")).alias("value"))
    m = t.documents.where("lang = 'en'").select(F.concat(F.lit("doi-"), key).alias("alt"), key.alias("id"))
    return wf.fill_blank(r, "abstract", "abstract_source", "pmid", "doi", val, m)


@query(f"WITH {FILL_SQL} SELECT doc_id, abstract, abstract_source, pmid, route, reason FROM f")
def fill_blank_enrich(t):
    return filled(t).select("doc_id", "abstract", "abstract_source", "pmid", "route", "reason")


@query(f"WITH {FILL_SQL} SELECT source, CASE WHEN route = '' THEN 'still_missing' ELSE route END AS route, count(*) AS n FROM f GROUP BY 1, 2")
def fill_report(t):
    return tb.fill_report(filled(t), "source", "route")


@query("""
WITH r AS (SELECT o_orderkey AS id, CASE WHEN md5(concat_ws('|', 'p', o_orderkey)) < '6' THEN '' ELSE 'P' || o_orderkey END AS pmid, CASE WHEN md5(concat_ws('|', 'q', o_orderkey)) < '6' THEN '' ELSE 'D' || o_orderkey END AS doi FROM orders),
f AS (SELECT o_orderkey AS id, 'P' || o_orderkey AS pf, CASE WHEN o_orderstatus = 'O' THEN 'D' || o_orderkey ELSE '' END AS dx FROM orders WHERE o_totalprice > 200000)
SELECT CAST((r.pmid = '' AND pf IS NOT NULL) AS INTEGER) + CAST((r.doi = '' AND coalesce(dx, '') <> '') AS INTEGER) AS n_changed, count(*) AS n, count(*) FILTER (WHERE pmid = '' AND pf IS NULL) AS no_pmid FROM r LEFT JOIN f USING (id) GROUP BY 1""")
def identifier_backfill(t):
    key = c("o_orderkey").cast("string")
    r = t.orders.select(c("o_orderkey").alias("id"), F.when(md5("p", "o_orderkey") < "6", "").otherwise(F.concat(F.lit("P"), key)).alias("pmid"),
                        F.when(md5("q", "o_orderkey") < "6", "").otherwise(F.concat(F.lit("D"), key)).alias("doi"))
    f = t.orders.where("o_totalprice > 200000").select(c("o_orderkey").alias("id"), F.concat(F.lit("P"), key).alias("pmid"),
                                                     F.when(c("o_orderstatus") == "O", F.concat(F.lit("D"), key)).otherwise("").alias("doi"))
    out = wf.backfill_ids(r, f, "id", ["pmid", "doi"])
    return out.groupBy("n_changed").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("pmid") == "").alias("no_pmid"))


@query("""
WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS old FROM orders WHERE o_orderpriority = '1-URGENT'), d AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 250000 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS new FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 51000 OR o_totalprice > 499000)
SELECT 'audit' AS part, old || '->' || new AS item, count(*) AS n FROM s JOIN d USING (k) GROUP BY 2
UNION ALL SELECT 'gap', CASE WHEN d.k IS NULL THEN 'no decision' ELSE 'not in scope' END, count(*) FROM s FULL JOIN d USING (k) WHERE s.k IS NULL OR d.k IS NULL GROUP BY 2""")
def recode_coverage(t):
    rows = t.orders.select(c("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    dec = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 51000 OR o_totalprice > 499000").select(
        c("o_orderkey").alias("k"), F.when(c("o_totalprice") > 250000, "INCLUDE").otherwise("EXCLUDE").alias("new"), F.lit("price").alias("branch"))
    audit, gaps = wf.recode_by_table(rows, dec, "k", "o_orderstatus", c("o_orderpriority") == "1-URGENT")
    a = audit.groupBy(F.concat_ws("->", "old", "new").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("audit").alias("part"), "item", "n")
    return a.unionByName(gaps.groupBy(c("gap").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("gap").alias("part"), "item", "n"))


@query("""
WITH l AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS o FROM events WHERE value > 20 GROUP BY 1)
SELECT c_custkey AS k, CASE l.o WHEN 'purchase' THEN 'obtained' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM customer LEFT JOIN l ON l.k = c_custkey""")
def queue_status(t):
    log = t.events.where("value > 20").select(c("user_id").alias("k"), "ts", "event_id", "event_type")
    return wf.queue_status(t.customer.select(c("c_custkey").alias("k")), log, "k", ["ts", "event_id"], "event_type", {"purchase": "obtained", "error": "failed"})


@query("""
WITH b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer), ch AS (SELECT user_id * 20 AS k, arg_max(event_type, (ts, event_id)) AS v FROM events GROUP BY 1)
SELECT coalesce(b.k, ch.k) AS k, coalesce(ch.v, b.v) AS v FROM b FULL JOIN ch ON b.k = ch.k""")
def keyed_upsert(t):
    base = t.customer.select(c("c_custkey").alias("k"), c("c_mktsegment").alias("v"))
    ch = t.events.select((c("user_id") * 20).alias("k"), c("event_type").alias("v"), "ts", "event_id")
    return wf.upsert(base, ch, ["k"], ["ts", "event_id"])


@query("""
WITH a AS (SELECT doc_id AS k, md5(text) AS digest FROM documents), sc AS (SELECT doc_id AS k FROM documents WHERE lang <> 'de'), he AS (SELECT doc_id AS k FROM labels WHERE toxic = 1),
al AS (SELECT k, digest, CASE WHEN he.k IS NOT NULL THEN 0 ELSE 1 END AS nw FROM a LEFT JOIN he USING (k)), ow AS (SELECT digest, arg_min(k, (nw, k)) AS o FROM al GROUP BY 1)
SELECT a.k, CASE WHEN sc.k IS NULL THEN 'not_in_scope' WHEN he.k IS NOT NULL THEN 'already_held' WHEN ow.o <> a.k THEN 'same_bytes_other_id' ELSE 'accepted' END AS verdict FROM a LEFT JOIN sc ON sc.k = a.k LEFT JOIN he ON he.k = a.k JOIN ow USING (digest)""")
def intake_matching(t):
    a = t.documents.select(c("doc_id").alias("k"), F.md5("text").alias("digest"), "lang")
    held = a.join(t.labels.where("toxic = 1").select(c("doc_id").alias("k")), "k", "left_semi")
    return wf.intake(a.select("k", "digest"), a.where("lang <> 'de'"), held, "k", "digest").select("k", "verdict")


@query("""
SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_input FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)""")
def open_work(t):
    o = t.orders.select(c("o_custkey").alias("k"), "o_totalprice", "o_orderpriority")
    return wf.open_work(t.customer.select(c("c_custkey").alias("k")), o.where("o_totalprice > 490000"), o.where("o_orderpriority = '1-URGENT'"), "k")


@query(r"""
WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS g, text FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.role AS ra, b.role AS rb, a.g AS ga, b.g AS gb FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2)
SELECT conv_id, turn, CASE WHEN ra = rb THEN 'agree' ELSE 'override' END AS role_kind, CASE WHEN len(gb) = 0 AND len(ga) = 0 THEN 'override' WHEN coalesce(len(list_intersect(ga, gb)) / nullif(len(list_distinct(list_concat(ga, gb))), 0), 0) >= 0.3 THEN 'agree' ELSE 'override' END AS text_kind FROM p""")
def override_kinds(t):
    v = t.conversations
    a = v.select("conv_id", "turn", c("role").alias("ra"), c("text").alias("ta"))
    b = v.select("conv_id", (c("turn") - 2).alias("turn"), c("role").alias("rb"), c("text").alias("tb"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", wf.override_kind(c("ra"), c("rb"), False).alias("role_kind"), wf.override_kind(c("ta"), c("tb"), True, 0.3).alias("text_kind"))


@query(f"""
WITH base AS (SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'X' WHEN p_size < 20 THEN 'V' ELSE 'M' END AS layer, p_name FROM part),
sup AS (SELECT l_partkey AS k, arg_max(CASE WHEN l_returnflag = 'R' THEN 'X' ELSE 'M' END, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS layer FROM lineitem WHERE l_quantity = 50 GROUP BY 1),
hum AS (SELECT p_partkey AS k, 'M' AS layer FROM part WHERE p_size = 5),
f AS (SELECT base.k, coalesce(hum.layer, sup.layer, base.layer) AS layer, CASE WHEN hum.k IS NOT NULL THEN 'human' WHEN sup.k IS NOT NULL THEN 'superseded' ELSE 'first_pass' END AS provenance, {FAMILY_SQL.format('p_name')} AS family FROM base LEFT JOIN sup USING (k) LEFT JOIN hum USING (k))
SELECT family, provenance, count(*) AS n FROM f WHERE layer = 'M' GROUP BY 1, 2""")
def map_layer(t):
    base = t.part.select(c("p_partkey").alias("k"), F.when(c("p_size") < 10, "X").when(c("p_size") < 20, "V").otherwise("M").alias("layer"), "p_name")
    sup = t.lineitem.where("l_quantity = 50").select(c("l_partkey").alias("k"), F.when(c("l_returnflag") == "R", "X").otherwise("M").alias("layer"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    out = wf.map_layer(base, sup, ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"], t.part.where("p_size = 5").select(c("p_partkey").alias("k"), F.lit("M").alias("layer")), "k", "layer", "M")
    return out.groupBy(ru.classify(c("p_name"), FAMILY_RULES).alias("family"), "provenance").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'found-' || c_custkey ELSE c_name END AS doi, 'pending' AS status FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT user_id FROM events)""")
def rescope_append(t):
    scope = t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("k"), F.when(c("c_acctbal") < 0, "").otherwise(c("c_name")).alias("doi"))
    comp = t.customer.select(c("c_custkey").alias("k"), F.concat(F.lit("found-"), c("c_custkey").cast("string")).alias("doi"))
    return wf.append_scope(scope, comp, t.events.select(c("user_id").alias("k")), "k", ["doi"])


@query("SELECT CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'manual' ELSE 'waiting' END AS request_status, count(*) AS n FROM events GROUP BY 1")
def request_status(t):
    return t.events.groupBy(ru.recode(c("event_type"), {"purchase": "done", "error": "manual"}, "waiting").alias("request_status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(100 * count(*) FILTER (WHERE l_discount = 0) / count(*), 4) AS pct_blank_new, round(100 * count(*) FILTER (WHERE l_tax = 0) / count(*), 4) AS pct_blank_old FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) GROUP BY 1, 2""")
def paired_quality(t):
    old = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", F.when(c("l_tax") != 0, c("l_tax")).alias("v"))
    new = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", F.when(c("l_discount") != 0, c("l_discount")).alias("v"))
    common = t.lineitem.where("l_quantity = 50").select("l_orderkey")
    out = wf.paired_quality(old.join(common, "l_orderkey", "left_semi"), new.join(common, "l_orderkey", "left_semi"), "l_orderkey", ["l_returnflag", "l_linestatus"], "v")
    return out.withColumns({x: F.round(x, 4) for x in ("pct_blank_old", "pct_blank_new")})


